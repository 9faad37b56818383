"""Answers as they are shown: ordered, capped, printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RESULTS, SHOWN_LINES = 200, 8


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """With place, from 1, in that order. One task numbers all rows: for answers of a size that a person looks at; what is only printed is sorted instead."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


#: Orders of answers.
USAGES, RANKED, CLOSURE = ("path", "line"), ("-score", "path"), ("file", "line", "ord")


def ordered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A distributed sort; a minus means descending."""
    return df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order])


def usages_row() -> Column:
    """Path, line and text (if it isn't null) between tabs."""
    return F.concat_ws("\t", "path", F.col("line").cast("string"), "text")


def ranked_row() -> Column:
    """Path, score with two decimals, terms, lines."""
    return F.concat_ws("\t", "path", F.format_string("%.2f", "score"), "terms", "lines")


def first_lines(shown: int = SHOWN_LINES) -> Column:
    """The first hit lines and how many more."""
    lines = F.split("lines", ",")
    more = F.size(lines) - shown
    return F.concat(F.array_join(F.slice(lines, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def closure_row() -> Column:
    """The columns of a declaration and whether it is loaded, between tabs."""
    names = ("kind", "name", "container", "modifiers", "attributes", "bases", "signature", "line", "file", "project", "loaded")
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in names])


def capped(df: DataFrame, order: list[str], most: int = MAX_RESULTS) -> DataFrame:
    """The first rows by that order, with place and hidden: how many rows there are beyond. The cap is of the display alone."""
    total = df.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("hidden"))
    return placed(df.orderBy(*order).limit(most), *order).crossJoin(F.broadcast(total))  # one row


def grouped_by_file(shown: DataFrame) -> list[str]:
    """Lines for a person: a file with its project, its declarations by line, a footer. Takes what `capped` gives of declarations with `shown`."""
    out, file = [], None
    rows = shown.orderBy("place").collect()  # capped
    for r in rows:
        if r.file != file:
            out += ["", f"=== {r.file}  [{r.project}]"]
            file = r.file
        out.append(f"  line {r.line:<5} {r.kind:<10} {r.modifiers:<18} {r.shown}  {r.signature}   in {r.container}".rstrip())
    hidden = rows[0].hidden if rows else 0
    out += ["", f"Total: {len(rows) + hidden} declarations"] + ([f"Shown: {len(rows)}. Narrow the search by kind, project, container or file."] if hidden else [])
    return out


def preview_text(name: str, rows: DataFrame) -> list[str]:
    """Lines for a person: a title with the number of lines, head and tail with what lies between counted."""
    found = rows.orderBy("line").collect()  # head and tail
    total = found[0].n_lines if found else 0
    out, last = [f"=== {name} ({total} lines) ===", ""], 0
    for r in found:
        if r.line != last + 1:
            out += ["", f"--- [ {r.line - last - 1} lines left out ] ---", ""]
        out.append(r.text)
        last = r.line
    return out
