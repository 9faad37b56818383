"""What a search pattern looks for, as columns: the pattern is cut into tokens once, and rules look at neighbouring tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import bind

# Type keywords with their kinds, modifiers.
KINDS = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "record", "partial": "class"}
MODIFIERS = ("public", "private", "protected", "internal", "static", "virtual", "override", "abstract", "sealed", "async")
SPECIAL = ".*+?[](){}|^$\\"

#: An escape, a wildcard with its repetition, white space, a name, or any other character.
_TOKEN = r"(?s)\\[sSwWdD][*+?]?|\\.|\.[*+?]|\s+|[A-Za-z_][A-Za-z0-9_]*|."
_GAP = r"(?s)\\[sSwWdD].?|\.[*+?]|\s+"
_NAME = "[A-Za-z_][A-Za-z0-9_]*"


def plain(pattern: Column) -> Column:
    """Without word borders, which searches for whole words imply."""
    return F.replace(pattern, F.lit("\\b"), F.lit(""))


def has_regex(pattern: Column) -> Column:
    return F.translate(plain(pattern), SPECIAL, "") != plain(pattern)


def is_name(pattern: Column) -> Column:
    return pattern.rlike(f"\\A{_NAME}\\z")


def tokens(pattern: Column) -> Column:
    """Classes, wildcards and white space are gaps (a space), one between two tokens at most."""
    raw = F.transform(F.regexp_extract_all(plain(pattern), F.lit(_TOKEN), F.lit(0)), lambda x: F.when(x.rlike(f"^(?:{_GAP})$"), " ").otherwise(x))
    return bind(raw, lambda r: F.filter(r, lambda x, i: (x != " ") | F.coalesce(F.get(r, i - 1) != " ", F.lit(True))))


def _named(x: Column) -> Column:
    return x.rlike(f"^{_NAME}$")


def _after(t: Column, i: Column) -> Column:
    """Place of what comes at i or later, behind a gap and an open bracket."""
    gap = i + F.when(F.get(t, i) == " ", 1).otherwise(0)
    return gap + F.when(F.get(t, gap) == "(", 1).otherwise(0)


def _name_at(t: Column, i: Column) -> Column:
    return F.when(_named(F.get(t, i)), F.get(t, i))


def _first(found: Column) -> Column:
    """First element that isn't null."""
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _base(t: Column) -> Column:
    """The name behind the first colon that has one; of names with | between them the last."""

    def at(x: Column, i: Column) -> Column:
        rest = F.slice(t, _after(t, i + 1) + 1, F.size(t) + 1)
        run = F.coalesce(F.array_position(F.transform(rest, lambda y, k: F.when(k % 2 == 0, _named(y)).otherwise(y == "|")), False), F.lit(0))
        length = F.when(run > 0, run - 1).otherwise(F.size(rest)).cast("int")
        name = F.get(rest, length - F.when(length % 2 == 0, 2).otherwise(1))
        asked = F.exists(F.slice(t, 1, i), lambda y: F.contains(y, F.lit("?")))
        single = F.coalesce(F.get(t, i - 1), F.lit("")) != ":"
        return F.when((x == ":") & single & (length > 0), F.struct(name.alias("name"), asked.alias("asked")))

    return bind(_first(F.transform(t, at)), lambda f: F.when(~f["asked"] & ~F.contains(F.array_join(t, ""), F.lit("::")), f["name"]))


def _keyword(t: Column) -> Column:
    """The first type keyword, with the name behind it."""

    def at(x: Column, i: Column) -> Column:
        behind = i + 1
        # `partial class Name`: the second keyword belongs to the first
        behind = behind + F.when((F.get(t, behind) == " ") & (F.get(t, behind + 1) == "class"), 2).otherwise(0)
        name = _name_at(t, _after(t, behind))
        free = ~F.coalesce(F.get(t, i - 1), F.lit("")).rlike("^[.0-9]$")
        return F.when(x.isin(*KINDS) & free, F.struct(x.alias("word"), name.alias("name")))

    return _first(F.transform(t, at))


def classify(pattern: Column) -> Column:
    """filter (attribute, base, name, kind), value and kind of the declaration that a pattern looks for; null if it looks for none. The order of the
    rules: attribute, base, type by name, method by a modifier, type keyword alone."""

    def of(t: Column) -> Column:
        answer = lambda by, value, kind: F.struct(F.lit(by).alias("by"), value.alias("value"), kind.alias("kind"))
        attribute = _first(F.transform(t, lambda x, i: F.when(x == "\\[", _name_at(t, _after(t, i + 1)))))
        method = _first(F.transform(t, lambda x, i: F.when(_named(x) & ((F.get(t, i + 1) == "\\(") | (F.get(t, i + 1) == " ") & (F.get(t, i + 2) == "\\(")), x)))
        modified = F.arrays_overlap(t, F.array(*map(F.lit, MODIFIERS)))
        found = F.struct(attribute.alias("attribute"), _base(t).alias("base"), _keyword(t).alias("keyword"), F.when(modified, method).alias("method"))
        kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
        return bind(
            found,
            lambda f: F.when(f["attribute"].isNotNull(), answer("attribute", f["attribute"], F.lit("")))
            .when(f["base"].isNotNull(), answer("base", f["base"], F.lit("class")))
            .when(f["keyword"]["name"].isNotNull() & ~f["keyword"]["name"].isin(*KINDS), answer("name", f["keyword"]["name"], F.element_at(kinds, f["keyword"]["word"])))
            .when(f["method"].isNotNull(), answer("name", f["method"], F.lit("method,ctor")))
            .when(f["keyword"].isNotNull(), answer("kind", F.lit(""), F.element_at(kinds, f["keyword"]["word"]))),
        )

    return bind(tokens(pattern), of)
