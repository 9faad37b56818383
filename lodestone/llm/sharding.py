"""Sharding by a k-d tree over metadata; DataFrame functions only. Law: `bytes`, sizes of shards near equal.

A node's rows are split along its widest dimension (weighted variance of coordinates scaled to the table's range, in whole numbers) at
the weighted median: rows are ordered by that coordinate, a checksum of the text and a hash of the row. Equal texts share the coordinates
of the first of them by id, so they stay together but where the median falls among copies of over GROUP_WHOLE of the node's bytes, which are
dealt out by the row's hash, as sizes would not be near equal otherwise. The median is found over histograms: bytes by
bucket of the order's leading bits, then within the bucket that holds the median, until that bucket is lighter than TOLERANCE of the node or
no bits are left; such a bucket goes whole to the nearer side. All nodes of a level are split in the same passes, over a staged table of a few
numbers a row; only histograms of BUCKET_BITS bits a node come to the driver. Leaves are the shards.

Nothing depends on how the table is partitioned or in what order it is read: rows that are equal in id, text, source and lang are counted first, a
unit holds at most UNIT_ROWS of them, and order and slots come from a hash of the unit.

Size: UTF-8 bytes of the text (null: none) plus 1. Null metadata are taken as the lowest coordinate. Rows that repeat are
rows of their own; they may share a shard or not, like any equal texts. Fewer rows than shards leave shards empty, an empty table gives no rows. Of equal
coordinates the checksum decides, then the hash. Texts of any length are measured whole and never shuffled. Extra columns are not carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_hot, stage

SHARDS, TOLERANCE, GROUP_WHOLE, BUCKET_BITS = 8, 5e-5, 5e-3, 12
#: Bits of each part of the order: coordinate, checksum of the text, hash of the row.
COORDINATE_BITS, TEXT_BITS, ROW_BITS = 24, 32, 60
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")
#: Rows whose places in a shard one task numbers, about.
SLOT_ROWS = 20_000
#: Equal rows that stay together as one unit.
UNIT_ROWS = 256


def _coordinates(docs: DataFrame) -> DataFrame:
    """A staged row of numbers for each unit of n rows; coordinates from 0 to 1."""
    text = F.col("text").cast("string")
    named = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) / float(1 << 32), F.lit(0.0)) if c in docs.columns else F.lit(0.0)
    numbers = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(text).alias("same"), named("source").alias("d_source"), named("lang").alias("d_lang"),
    )
    counted = numbers.groupBy("doc_id", "size", "crc", "same", "d_source", "d_lang").agg(F.count("*").alias("of"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("of") - 1) / UNIT_ROWS))).alias("chunk")
    units = counted.select("*", chunk).withColumn("n", F.least(F.lit(UNIT_ROWS).cast("long"), F.col("of") - F.col("chunk") * UNIT_ROWS)).drop("of")
    rows = stage(units.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "same", "crc", "d_source", "d_lang", "chunk"), 64 - ROW_BITS)), "rows")
    low, high, most, total = rows.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double"), F.max("size"), F.count("*")).first()
    key = ["same", "size", "crc"]
    first = stage(rows.groupBy(*key).agg(F.min(F.struct("doc_id", "d_source", "d_lang")).alias("first"), F.count("*").alias("copies")), "texts")
    grouped = join_hot(rows.drop("d_source", "d_lang"), first, key, "copies", total)
    span = (high - low) if low is not None and high > low else 1.0
    return (
        grouped.select("doc_id", "size", "crc", "n", "hash", F.col("first.doc_id").alias("first_id"), "first.d_source", "first.d_lang")
        .withColumn("d_id", F.coalesce((F.col("first_id").cast("double") - (low or 0.0)) / span, F.lit(0.0)))
        .withColumn("d_size", F.log2(F.col("size").cast("double")) / F.log2(F.lit(float((most or 1) + 1))))
        .drop("first_id")
    )


def _spread(dimension: str) -> Column:
    """Sums of which the weighted variance follows, as whole numbers: they don't depend on the order of the rows."""
    x = (F.col(dimension) * float((1 << COORDINATE_BITS) - 1)).cast("long").cast("decimal(12,0)")
    weight = (F.col("size") * F.col("n")).cast("decimal(14,0)")
    whole = lambda c: F.sum(c).cast("decimal(38,0)")
    return F.struct(whole(weight * x).alias("one"), whole((weight * x).cast("decimal(26,0)") * x).alias("two")).alias(dimension)


def _order(dimension: str) -> list[tuple[Column, int]]:
    """Parts of the order along a dimension, each a non-negative long of so many bits."""
    return [((F.col(dimension) * float((1 << COORDINATE_BITS) - 1)).cast("long"), COORDINATE_BITS), (F.col("crc").cast("long"), TEXT_BITS), (F.col("hash"), ROW_BITS)]


def _by_node(chosen: dict[int, Column]) -> Column:
    return reduce(lambda c, kv: c.when(F.col("node") == kv[0], kv[1]), list(chosen.items())[1:], F.when(F.col("node") == next(iter(chosen)), next(iter(chosen.values()))))


def _above(dimension: str, cut: list[int], bits: int) -> Column:
    """Does the order come after the cut's leading bits? cut: values of parts; bits: of the last of them, how many count."""
    after, equal = F.lit(False), F.lit(True)
    for k, ((value, width), at) in enumerate(zip(_order(dimension), cut, strict=False)):
        if k == len(cut) - 1:
            value = F.shiftrightunsigned(value, width - bits)
        after = after | (equal & (value > at))
        equal = equal & (value == at)
    return after


def assign(docs: DataFrame, shards: int = SHARDS, group_whole: float = GROUP_WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) for every row."""
    table = stage(_coordinates(docs).withColumn("node", F.lit(0)), "coordinates")
    leaves = {0: shards}  # leaves under each open node; the left child of node n is 2n + 1
    shard_of: dict[int, int] = {}
    while any(n > 1 for n in leaves.values()):
        split = {k: n for k, n in leaves.items() if n > 1}
        stats = {r["node"]: r for r in table.filter(F.col("node").isin(*split)).groupBy("node").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), *map(_spread, DIMENSIONS)).collect()}
        split = {k: n for k, n in split.items() if k in stats}
        if not split:
            break
        variance = lambda r, d: int(r[d]["two"]) * r["bytes"] - int(r[d]["one"]) ** 2  # noqa: E731  times bytes squared
        widest = {k: max(DIMENSIONS, key=lambda d: variance(stats[k], d)) for k in split}
        goal = {k: stats[k]["bytes"] * (n // 2) / n for k, n in split.items()}  # bytes that go left
        cuts: dict[int, tuple[list[int], int]] = {k: ([0], 0) for k in split}  # parts of the order, bits of the last
        left = dict.fromkeys(split, 0)  # bytes before the bucket that is open
        going = set(split)
        while going:
            conditions, keys, size = {}, {}, {}
            for k in going:
                parts, bits = cuts[k]
                order = _order(widest[k])[: len(parts)]
                take = min(BUCKET_BITS, order[-1][1] - bits)
                inside = F.shiftrightunsigned(order[-1][0], order[-1][1] - bits) == parts[-1] if bits else F.lit(True)
                conditions[k] = reduce(lambda a, b: a & b, [v == at for (v, _), at in zip(order[:-1], parts[:-1], strict=True)], inside)
                keys[k], size[k] = F.shiftrightunsigned(order[-1][0], order[-1][1] - bits - take), take
            found: dict[int, list[tuple[int, int]]] = {}
            for r in table.filter(F.col("node").isin(*going) & _by_node(conditions)).groupBy("node", _by_node(keys).alias("at")).agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).collect():
                found.setdefault(r["node"], []).append((r["at"], r["bytes"]))
            for k in list(going):
                parts, bits = cuts[k]
                before = left[k]
                for at, weight in sorted(found[k]):  # noqa: B007
                    if before + weight >= goal[k]:
                        break
                    before += weight
                else:
                    before -= weight
                width = _order(widest[k])[len(parts) - 1][1]
                bits += size[k]
                left[k] = before
                whole = len(parts) == 2 and bits == width and weight <= group_whole * stats[k]["bytes"]
                if whole or weight <= TOLERANCE * stats[k]["bytes"] or bits == width and len(parts) == 3:
                    # the open bucket goes to the nearer side: left with it, or the cut moves before it
                    cuts[k] = (parts[:-1] + [at if goal[k] - before >= weight / 2 else at - 1], bits)
                    going.discard(k)
                elif bits == width:
                    cuts[k] = (parts[:-1] + [at, 0], 0)
                else:
                    cuts[k] = (parts[:-1] + [at], bits)
        child = _by_node({k: F.col("node") * 2 + 1 + _above(widest[k], *cuts[k]).cast("int") for k in split})
        parent, table = table, stage(table.withColumn("node", F.when(F.col("node").isin(*split), child).otherwise(F.col("node"))), "coordinates")
        forget(parent)
        leaves = {k: n for k, n in leaves.items() if k not in split} | {2 * k + 1: n // 2 for k, n in split.items()} | {2 * k + 2: n - n // 2 for k, n in split.items()}

    def leftmost(k: int) -> str:
        path = ""
        while k:
            path, k = ("0" if k % 2 else "1") + path, (k - 1) // 2
        return path

    for i, k in enumerate(sorted(leaves, key=leftmost)):
        shard_of[k] = i
    table = table.withColumn("shard", _by_node({k: F.lit(i) for k, i in shard_of.items()}))
    buckets = max(1, -(-(table.agg(F.sum("n")).first()[0] or 0) // SLOT_ROWS))
    table = table.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    counts = table.groupBy("shard", "bucket").agg(F.sum("n").alias("here"))
    before = counts.withColumn("before", F.sum("here").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("here")).drop("here")
    order = Window.partitionBy("shard", "bucket").orderBy("hash", "doc_id", "crc", "size")
    place = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = table.withColumn("place", place).join(before, ["shard", "bucket"])
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.explode(F.sequence(F.col("before") + F.col("place"), F.col("before") + F.col("place") + F.col("n") - 1)).alias("slot"))
