"""Closure of types over their bases, from seeds. Rounds run over keys of types and an edge table, which is built once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .declarations import TYPES, base_names, simple_name, type_key

MAX_ROUNDS = 6


def _first(df: DataFrame) -> DataFrame:
    """First row of a key in the order of the table; later parts of a type are not followed."""
    order = Window.partitionBy("type_key").orderBy("file", "ord")
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def types_of(decl: DataFrame) -> DataFrame:
    """Rows of types with type_key, simple and base_list."""
    return decl.filter(F.col("kind").isin(*TYPES)).withColumn("type_key", type_key()).withColumn("simple", simple_name()).withColumn("base_list", base_names(F.col("bases")))


def service_like(types: DataFrame) -> DataFrame:
    """Rows (type_key, file, ord) of services: classes with a base that ends in ServiceBase or ServiceCore, or with an interface that
    resolves by its simple name to a service contract."""
    bases = types.filter("kind = 'class'").select("type_key", "file", "ord", F.explode("base_list").alias("base"))
    contracts = types.filter("kind = 'interface'").filter(F.contains(F.col("attributes"), F.lit("ServiceContract"))).select(F.col("simple").alias("base")).distinct()
    named = bases.filter(F.col("base").rlike("Service(Base|Core)$"))
    implementing = bases.filter(F.col("base").rlike(r"^I\p{Lu}")).join(contracts, "base", "left_semi")
    return named.select("type_key", "file", "ord").union(implementing.select("type_key", "file", "ord")).distinct()


def close(decl: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """seeds: rows of types to start from (type_key, file, ord). (types of the files that hold loaded types, with loaded 0 or 1; loaded keys; members
    of loaded types)."""
    types = types_of(decl)
    row = ["type_key", "file", "ord"]
    names = types.select(F.col("type_key").alias("to"), F.col("simple").alias("base")).distinct()
    follow = lambda rows: rows.select("type_key", F.explode("base_list").alias("base")).join(names, "base").select("type_key", "to").distinct()
    started = _first(types.join(seeds.select(*row), row, "left_semi"))
    # what later rounds may follow: the first row of a key, if it is a service
    edges = staged(follow(_first(types).join(service_like(types), row, "left_semi")), "edges")
    loaded = staged(started.select("type_key"), "loaded")
    found = follow(started).select(F.col("to").alias("type_key"))
    for k in range(max_rounds):
        frontier = staged(found.distinct().join(loaded, "type_key", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        loaded = staged(loaded.union(frontier), "loaded")
        if k + 1 < max_rounds:
            found = edges.join(frontier, "type_key", "left_semi").select(F.col("to").alias("type_key"))
    # the files of the rows that were loaded: a seed's own row, else the first of its key
    rows = started.select(*row).union(_first(types).select(*row).join(loaded, "type_key", "left_semi").join(started.select("type_key"), "type_key", "left_anti"))
    files = rows.select(F.lower("file").alias("low")).distinct()
    near = types.withColumn("low", F.lower("file")).join(files, "low", "left_semi").drop("low")
    marked = near.join(loaded.withColumn("loaded", F.lit(1)), "type_key", "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    members = decl.filter(~F.col("kind").isin(*TYPES)).join(loaded.withColumnRenamed("type_key", "container"), "container", "left_semi")
    return marked, loaded, members


def scope_seeds(decl: DataFrame, scope: str) -> DataFrame:
    """Rows of the services under a directory."""
    s = scope.replace("\\", "/").strip("/").lower()
    found = service_like(types_of(decl))
    return found.filter(F.lower("file").startswith(s + "/")) if s and s != "." else found


def operation_seeds(decl: DataFrame, operation: str) -> DataFrame:
    """First rows of the types with a method of that name; an Action suffix is taken off, and both forms are looked for."""
    plain = operation.removesuffix("Action")
    owners = decl.filter("kind = 'method'").filter(F.col("name").isin(plain, plain + "Action")).select(F.col("container").alias("type_key")).distinct()
    return _first(types_of(decl)).join(owners, "type_key", "left_semi").select("type_key", "file", "ord")


def file_seeds(decl: DataFrame, file: str) -> DataFrame:
    """Rows of the types of a file, in any case of letters."""
    return types_of(decl).filter(F.lower("file") == file.replace("\\", "/").lower()).select("type_key", "file", "ord")
