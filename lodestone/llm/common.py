"""Shared plumbing of the corpus operators: input tables, staged tables, text packing."""

from __future__ import annotations

import gc
import uuid

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.shared import folder as shared_dir

#: Rows of an Arrow batch handed to Python; texts may be long.
BATCH_ROWS = 1000
#: What split() on bytes takes as white space: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Code for the workers, and small Arrow batches: long documents would not fit the default of 10,000 rows."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what `stage` wrote for these. Only for tables that nothing unwritten reads any more."""
    for t in tables:
        jvm, session = t.sparkSession._jvm, t.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


#: A key with more than one of so many rows is joined by broadcast: there can't be more such keys than that.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, unique: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with one row a key. unique's `count` says how many rows (of `total`) have the key. A key that holds many rows would meet in one
    task of a shuffle; there are HOT_SHARE such keys at most, and these are broadcast."""
    hot = F.broadcast(unique.filter(F.col(count) * HOT_SHARE > total).drop(count))
    rest = unique.filter(F.col(count) * HOT_SHARE <= total).drop(count)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on))


def doc_key() -> list[Column]:
    """Identity of a row: its id (null: the least long) and a hash of id and text. Rows that
    repeat both are indistinguishable and get the same decisions."""
    lowest = F.lit(-(2**63)).cast("long")
    return [
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias("k_hash"),
    ]


def hash_sample(docs: DataFrame, n: int) -> DataFrame:
    """About n rows of docs (doc_id, text without nulls), those with the least hashes. Only hashes are sorted; texts are filtered by the greatest
    hash that belongs, so no task gathers the texts that other tasks looked at."""
    hashed = docs.filter("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    cut = hashed.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return hashed.filter(F.col("h") <= F.lit(cut)).limit(n).drop("h") if cut is not None else hashed.limit(0).drop("h")


def pack(text: str | None, tool=zstandard.ZstdCompressor(level=1)) -> bytes | None:
    """Texts cross shuffles compressed."""
    return None if text is None else tool.compress(text.encode("utf-8", "surrogatepass"))


def unpack(data: bytes | None, tool=zstandard.ZstdDecompressor()) -> str | None:
    return None if data is None else tool.decompress(data).decode("utf-8", "surrogatepass")


_slot: list = [None, None]


def slot(key, make=None):
    """What this Python worker keeps from task to task: one object. Another key drops it, so a worker that Spark reuses for another operator doesn't carry
    the first one's memory; key None just drops."""
    if _slot[0] != key:
        _slot[:] = [None, None]
        gc.collect()
        if key is not None:
            _slot[:] = [key, make()]
    return _slot[1]


def tidy(spark: SparkSession) -> None:
    """After a long step: dropped plans are collected on the driver, and with them Spark removes their shuffle files and broadcasts on all executors."""
    gc.collect()
    spark._jvm.System.gc()


class Memo(dict):
    """A memo bounded by bytes. It has two generations: what was used since the last turn stays, the rest goes when half of the bound is full,
    so frequent keys outlive rare ones. An entry weighs `each` bytes and, if sized, what its key (text) and its value (bytes) hold."""

    def __init__(self, make, bound: int, each: int = 300, sized: bool = True):
        super().__init__()
        self.make, self.half, self.each, self.sized = make, bound // 2, each, sized
        self.before: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self.held += self.each + 4 * len(key) + len(value) if self.sized else self.each
        if self.held > self.half:
            self.before, self.held = self.copy(), 0
            self.clear()
        self[key] = value
        return value
