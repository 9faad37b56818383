"""Manifest and line corpus: what files hold, each distinct content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.text import all_lines, content_sha, is_text


def manifest(files: DataFrame) -> DataFrame:
    """files: path, text. path, sha."""
    return files.select("path", content_sha(F.col("text")).alias("sha"))


def blobs(files: DataFrame) -> DataFrame:
    """sha, path (the first), text of each distinct content. First paths are found over keys alone; then the file that has one carries the text, so texts are
    hashed where they are read and moved once, to the join."""
    keyed = files.select("path", "text", content_sha(F.col("text")).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min("path").alias("path"))
    return keyed.join(first, ["sha", "path"]).select("sha", "path", "text")


def blob_lines(blob: DataFrame) -> DataFrame:
    """sha, n_lines (all lines; 0 for what isn't text), line, text: a row a line that isn't empty."""
    gated = blob.select("sha", F.when(is_text(F.col("text").cast("binary")), all_lines(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("lines"))
    return gated.select("sha", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line", "text")).select("sha", "n_lines", (F.col("line") + 1).alias("line"), "text").filter("text <> ''")


def blob_sizes(blob: DataFrame) -> DataFrame:
    """sha, n_lines, n_text_lines, n_bytes: bytes of the lines that aren't empty."""
    lines = F.when(is_text(F.col("text").cast("binary")), all_lines(F.col("text"))).otherwise(F.array().cast("array<string>"))
    full = blob.select("sha", lines.alias("lines")).select("sha", F.size("lines").cast("long").alias("n_lines"), F.filter("lines", lambda x: x != "").alias("full"))
    return full.select("sha", "n_lines", F.size("full").cast("long").alias("n_text_lines"), F.aggregate("full", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)).alias("n_bytes"))


#: Contents are numbered within ranges of their sha; a range is its leading hexadecimal digits, so there are 16 ** RANGE_DIGITS of them at most.
RANGE_DIGITS = 3


def corpus_ids(sizes: DataFrame, keep: DataFrame | None = None, last_id: int = 0, last_offset: int = 0) -> DataFrame:
    """id and end offset of each content by sha, after last_id and last_offset; keep (sha): what survives a prune, numbered anew. Running numbers are
    taken within ranges of sha in parallel, and what comes before a range is added: a broadcast of 4,096 rows at most."""
    if keep is not None:
        sizes = sizes.join(keep.select("sha").distinct(), "sha", "left_semi")
    ranged = sizes.withColumn("range", F.substring("sha", 1, RANGE_DIGITS))
    order = Window.orderBy("range")
    sums = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    before = sums.select("range", (F.sum("n").over(order) - F.col("n")).alias("n_before"), (F.sum("b").over(order) - F.col("b")).alias("b_before"))
    inside = Window.partitionBy("range").orderBy("sha")
    out = ranged.withColumn("i", F.row_number().over(inside)).withColumn("o", F.sum("n_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(before), "range")
    return out.select("sha", (F.col("n_before") + F.col("i") + last_id).cast("long").alias("id"), (F.col("b_before") + F.col("o") + last_offset).alias("end_offset"), "n_lines")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, removed, changed, same) between two manifests (path, sha)."""
    both = old.select("path", F.col("sha").alias("old")).join(new.select("path", F.col("sha").alias("new")), "path", "full_outer")
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same").alias("change"))


def overlay(tracked: DataFrame, dirty: DataFrame) -> DataFrame:
    """tracked: path, sha; dirty: path, sha (null: deleted). The manifest as the working tree has it."""
    both = tracked.join(dirty.select("path", F.col("sha").alias("now"), F.lit(True).alias("is_dirty")), "path", "full_outer")
    return both.select("path", F.when(F.col("is_dirty"), F.col("now")).otherwise(F.col("sha")).alias("sha")).filter("sha is not null")


def project_of(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """paths: path; projects: path of project files. path, project: stem of the project file in the nearest directory above,
    '' if none; of several in one directory the least."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    homes = projects.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), stem.alias("project")).groupBy("dir").agg(F.min("project").alias("project"))
    dirs = paths.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("home")).distinct()  # once a directory, not once a file
    up = dirs.select("home", F.explode(ancestors(F.concat("home", F.lit("/x")))).alias("dir"))
    nearest = up.join(homes, "dir").groupBy("home").agg(F.max_by("project", F.length("dir")).alias("project"))
    return paths.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("home")).join(nearest, "home", "left").select("path", F.coalesce("project", F.lit("")).alias("project"))


def preview(files: DataFrame, sizes: DataFrame, lines: DataFrame, head: int, tail: int) -> DataFrame:
    """First and last lines of each file, blank ones included. files: path, sha; sizes: sha, n_lines; lines: sha, line, text of those that aren't empty.
    path, n_lines, line, text; a file of no more than head + tail lines is shown whole."""
    n = F.col("n_lines").cast("int")
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i <= head) | (i > n - tail)))
    ends = F.concat(F.sequence(F.lit(1), F.least(n, F.lit(head))), F.sequence(n - tail + 1, n))
    shown = F.when(n <= 0, F.array().cast("array<int>")).when(n <= head + tail, places).otherwise(ends)
    at = files.select("path", "sha").join(sizes.select("sha", "n_lines"), "sha").select("path", "sha", "n_lines", F.explode(shown).alias("line"))
    return at.join(lines.select("sha", "line", "text"), ["sha", "line"], "left").select("path", "n_lines", "line", F.coalesce("text", F.lit("")).alias("text"))
