"""Queries over the declaration table: kind, name, container, modifiers, attributes, bases, signature, line, file, project, ord."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("class", "interface", "struct", "record")
GROUPS = ("container", "file", "project", "kind", "name")


def _quoted(x: str) -> str:
    return "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def type_key() -> Column:
    return F.when(F.col("container") == "", F.col("name")).otherwise(F.concat_ws(".", "container", "name"))


def simple_name(name: Column | str = "name") -> Column:
    return F.substring_index(name, "`", 1)


def base_names(bases: Column) -> Column:
    """Simple names of a base list: arguments cut off, however deep, last part of dotted names."""
    tokens = F.regexp_extract_all(bases, F.lit(r"[<>()\[\]]|[^<>()\[\]]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    opens, closes = (lambda x: x.isin("<", "(", "[")), (lambda x: x.isin(">", ")", "]"))
    step = lambda a, x: F.struct(
        F.when(opens(x), a["depth"] + 1).when(closes(x), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"]).alias("depth"),
        F.when((a["depth"] == 0) & ~opens(x) & ~closes(x), F.concat(a["out"], x)).otherwise(a["out"]).alias("out"),
    )
    parts = F.transform(F.split(F.aggregate(tokens, start, step, lambda a: a["out"]), ","), lambda x: F.substring_index(F.trim(x), ".", -1))
    return F.filter(parts, lambda x: x != "")


def listed(column: str, value: str, suffix: str = "") -> Column:
    """An element of a delimited list, bare or as the last part of a dotted name, with arguments or none."""
    return F.col(column).rlike(f"(?:^|[,.]){_quoted(value)}{suffix}(?:<|,|$)")


#: The columns of a declaration in the order of a row.
COLUMNS = ("kind", "name", "container", "modifiers", "attributes", "bases", "signature", "line", "file", "project")


def generated() -> Column:
    """The mark as an element of any column, or a file name of generated code; in any case of letters."""
    f = F.lower("file")
    row = F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS])
    return row.rlike(r"(?i)(?:^|[\t,.])GeneratedCode(?:Attribute)?(?:[,\t]|$)") | f.rlike(r"\.designer\.cs$|\.g\.(?:i\.)?cs$|/reference\.cs$")


def find(decl: DataFrame, *, name: str | None = None, container: str | None = None, file: str | None = None, project: str | None = None, kind: str | list[str] | None = None, base: str | None = None, attribute: str | None = None, include_generated: bool = False) -> DataFrame:
    """Rows that meet all filters; at least one is needed."""
    tests: list[Column] = []
    if name:
        if re.search(r"[*?]", name):
            body = "".join({"*": r"[^\t]*", "?": "."}.get(c) or _quoted(c) for c in name)
            tests.append(F.col("name").rlike(rf"^{body}(?:`\d+)?$"))
        else:
            tests.append((F.col("name") == name) | F.col("name").rlike(rf"^{_quoted(name)}`\d+$"))
    if container:
        tests.append(F.col("container").rlike(rf"^(?:.*\.)?{_quoted(container)}(?:`\d+)?$"))
    if file:
        tests.append(F.contains(F.col("file"), F.lit(file.replace("\\", "/"))))
    if project:
        tests.append(F.col("project") == project)
    if kind:
        tests.append(F.col("kind").isin([k for k in (re.split(r"[,\s]+", kind) if isinstance(kind, str) else kind) if k]))
    if base:
        tests.append(listed("bases", base))
    if attribute:
        tests.append(listed("attributes", attribute, "(?:Attribute)?"))
    if not tests:
        raise ValueError("at least one filter is needed")
    for t in tests:
        decl = decl.filter(t)
    return decl if include_generated else decl.filter(~generated())


def group(decl: DataFrame, by: str, ignore_case: bool = False) -> DataFrame:
    """Key and n, most first; of equal counts the later key first. With ignore_case, keys that differ in case alone are one (the least of them)."""
    if by not in GROUPS:
        raise ValueError(f"one of {GROUPS}")
    if ignore_case:
        counted = decl.groupBy(F.lower(by).alias("low")).agg(F.min(by).alias("key"), F.count("*").alias("n")).select("key", "n")
    else:
        counted = decl.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.desc("key"))


def totals(decl: DataFrame, by: str) -> DataFrame:
    return decl.agg(F.count("*").alias("n"), F.countDistinct(by).alias("n_groups"))


def displayed() -> Column:
    """[Attributes] Name : Bases"""
    spaced = lambda c: F.regexp_replace(c, ",(?! )", ", ")
    return F.concat(F.when(F.col("attributes") != "", F.concat(F.lit("["), spaced("attributes"), F.lit("] "))).otherwise(""), F.col("name"), F.when(F.col("bases") != "", F.concat(F.lit(" : "), spaced("bases"))).otherwise(""))


def homonyms(decl: DataFrame) -> DataFrame:
    """Type names that several projects declare."""
    return decl.filter(F.col("kind").isin(*TYPES)).groupBy(simple_name().alias("name")).agg(F.countDistinct("project").alias("projects"), F.count("*").alias("n")).filter("projects > 1")


def unused(decl: DataFrame, lines: DataFrame) -> DataFrame:
    """Declared names that no line but their own has as a word: names of runs of word characters, joined, not searched one by one."""
    words = lines.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_[^\x00-\x7F]]+"), F.lit(0)))).alias("name")).groupBy("name").agg(F.count("*").alias("n_lines"))
    own = decl.groupBy(simple_name().alias("name")).agg(F.count("*").alias("n"))
    return own.join(words, "name", "left").filter(F.coalesce("n_lines", F.lit(0)) <= F.col("n")).select("name", "n")
