"""Declaration tables and manifests as tab-separated text, for exchange with tools that read and write lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bind
from ..functions.text import clean_cell

# The columns of a row, in order.
COLUMNS = ("kind", "name", "container", "modifiers", "attributes", "bases", "signature", "line", "file", "project")


def parse_rows(rows: DataFrame, column: str = "value") -> DataFrame:
    """A row of text each → the columns of a declaration. Rows with too few cells or a line that is no number are left out, a header among them."""

    def cells(c: Column) -> Column:
        return F.when((F.size(c) >= len(COLUMNS)) & F.get(c, F.lit(7)).rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.struct(*[(F.get(c, F.lit(i)).cast("int") if n == "line" else F.get(c, F.lit(i))).alias(n) for i, n in enumerate(COLUMNS)]))

    return rows.select(bind(F.split(F.regexp_replace(column, r"\r$", ""), "\t"), cells).alias("d")).filter("d is not null").select("d.*")


def rows_of(decl: DataFrame) -> Column:
    return F.concat_ws("\t", *[clean_cell(F.col(n).cast("string")) for n in COLUMNS])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_rows(spark.read.text(path))


def write_index(decl: DataFrame, path: str) -> None:
    """By file and order of declaration, as many files as partitions; no header, so that they can be joined."""
    decl.orderBy("file", "ord").select(rows_of(decl)).write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id, a tab and a path."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.get(parts, F.lit(1)).alias("path"), F.get(parts, F.lit(0)).alias("sha"))


def same_manifest(old: DataFrame, new: DataFrame, sources_only: bool = False) -> bool:
    """Do two manifests (path, sha) name the same contents? sources_only: as far as C# files go."""
    keep = F.lower("path").endswith(".cs") if sources_only else F.lit(True)
    a, b = (m.filter(keep).select("path", "sha") for m in (old, new))
    return a.exceptAll(b).union(b.exceptAll(a)).isEmpty()


def with_shas(table: DataFrame, shas: DataFrame) -> DataFrame:
    """The rows whose sha is wanted. A small set is broadcast by Spark, and an empty one reads nothing."""
    return table.join(shas.select("sha").distinct(), "sha", "left_semi")
