"""Column functions over source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind

#: A byte that belongs to a word: ASCII letters, digits, underscore, and whatever isn't ASCII.
WORD_CLASS = r"[A-Za-z0-9_[^\x00-\x7F]]"
EXCERPT, MAX_TEXT_BYTES = 200, 1_048_576


def content_sha(text: Column) -> Column:
    """The id that git gives to a blob of these bytes."""
    data = text.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def whole_word(text: Column, symbol: str) -> Column:
    """Does the literal symbol occur with no word byte beside it? The plain search goes first; it is cheap."""
    if not symbol:
        return F.lit(False)
    quoted = "\\Q" + symbol.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.contains(text, F.lit(symbol)) & text.rlike(f"(?<!{WORD_CLASS}){quoted}(?!{WORD_CLASS})")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def excerpt(text: Column, size: int = EXCERPT) -> Column:
    """Trimmed, at most `size` UTF-16 units, an ellipsis if cut; a pair of surrogates isn't cut in two."""

    def cut(data: Column) -> Column:
        split = F.substring(data, 2 * size - 1, 1).between(F.unhex(F.lit("D8")), F.unhex(F.lit("DB")))
        return F.concat(F.decode(F.when(split, F.substring(data, 1, 2 * size - 2)).otherwise(F.substring(data, 1, 2 * size)), "UTF-16BE"), F.lit("…"))

    # few lines have more characters than that, and only they are looked at in units
    return bind(trimmed(text), lambda t: F.when(F.char_length(t) <= size // 2, t).otherwise(bind(F.encode(t, "UTF-16BE"), lambda d: F.when(F.octet_length(d) <= 2 * size, t).otherwise(cut(d)))))


def is_text(data: Column) -> Column:
    """At most 1 MiB; NUL bytes only under a UTF-16 mark."""
    marked = F.substring(data, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    return (F.octet_length(data) <= MAX_TEXT_BYTES) & (marked | (F.position(F.unhex(F.lit("00")), data) == 0))


def all_lines(text: Column) -> Column:
    """Array of all lines: cut at line feeds, one carriage return taken off each, none after a last line feed."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def runtime_lines(text: Column) -> Column:
    """Number of lines as a line reader counts them: cut at line feeds, carriage returns and both together, none after a last one."""
    cut = F.regexp_count(text, F.lit(r"\r\n|\r|\n"))
    return F.when(text == "", 0).otherwise(cut + F.when(text.rlike(r"(?s)[\r\n]\z"), 0).otherwise(1)).cast("int")


def clean_cell(text: Column) -> Column:
    """Fit for a tab-separated cell: tabs and line feeds are spaces, carriage returns go."""
    return F.translate(text, "\t\n\r", "  ")


def directive_symbols(text: Column) -> Column:
    """Distinct identifiers of #if and #elif lines."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*#[ \t]*(?:if|elif)\b(.*)$"), F.lit(1))
    names = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    return F.array_except(F.array_distinct(names), F.array(F.lit("true"), F.lit("false")))
