"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words; lines without words are separators and stay. Two lines are the same if their edit
distance over words (insert, delete, replace) is at most 1 where both have MIN_WORDS words or more, 0
otherwise. A line goes if an equal or such a line comes earlier, by (doc_id, place in the document); null ids come first.

Deletion neighbourhood: lines that differ by a replaced word have the same variant if that word is deleted
from both, and the shorter of lines that differ by an inserted word is a variant of the longer one. Every line emits its
variants as hashed keys (with the place for replacements); equal keys are grouped and the earliest line of each
group is taken by a partial minimum, so no group is gathered or paired. Edit distance is then verified on the words.
Only lines that share an intact half with another line (one edit spares a half) emit any, and only deletions in
the other half: no pair is lost by that.

Null texts have no lines. Rows that repeat both id and text are one document to this operator: each keeps the
same lines. Empty tables give no rows. Extra columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_key, forget, pack, prepare, slot, stage, tidy, unpack

MIN_WORDS = 8
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Roles of emitted keys: replacement variants, the line itself, insertion variants.
REPLACED, SELF, DELETED = 0, 1, 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def identity(words: list[bytes]) -> tuple[int, int]:
    """128 bits that stand for the line."""
    x = xxhash.xxh3_128_intdigest(b" ".join(words))
    return _signed(x >> 64), _signed(x & _MASK)


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the halves that one edit spares, for lines of n and of n - 1 words as the shorter ones. Tagged in the
    lowest bits, which say what the line is if another one has the key: 0, 1 as long as the other or shorter (left or right half intact);
    2, 3 longer."""
    n = len(words)
    out = []
    for tag, size in ((0, n), (2, n - 1)):
        if size >= MIN_WORDS:
            c = size // 2
            for side, part in ((0, words[:c]), (1, words[n - c :])):
                x = xxhash.xxh3_64_intdigest(b"%d %d " % (side, size) + b" ".join(part))
                out.append(_signed(x & ~3 | tag | side))
    return out


def _bare(key: Column) -> Column:
    """A half key without the role in it: the shorter and the longer line meet."""
    return key.bitwiseAND(F.lit(-3).cast("long"))


def deletion_hashes(words: list[bytes]) -> tuple[int, np.ndarray]:
    """A hash of the word sequence, and of it without word i for each i."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    powers = np.ones(n, np.uint64)
    if n > 1:
        powers[1:] = np.uint64(_ODD)
        powers = np.cumprod(powers, dtype=np.uint64)
    term = h * powers
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    return int(upto[-1]), upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(_INVERSE)


def _key(tag: int, n: int, place: int, value: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b"%d %d %d %d" % (tag, n, place, value)))


def variants(words: list[bytes], roles: set[int]) -> list[tuple[int, int]]:
    """(key, role) of a line: the deletions that the intact halves in `roles` (tags of half_keys) leave open."""
    n = len(words)
    whole, without = deletion_hashes(words)
    out: set[tuple[int, int]] = set()
    if roles & {0, 1}:
        out.add((_key(1, n, 0, whole), SELF))
    for tag, role, c in ((0, REPLACED, n // 2), (2, DELETED, (n - 1) // 2)):
        places: set[int] = set()
        if tag in roles:
            places.update(range(c, n))
        if tag + 1 in roles:
            places.update(range(n - c))
        for i in places:
            out.add((_key(0, n, i, int(without[i])) if role == REPLACED else _key(1, n - 1, 0, int(without[i])), role))
    return sorted(out)


def within_one(a: list[str], b: list[str]) -> bool:
    """Edit distance over words at most 1: common ends leave one word at most."""
    n, m = len(a), len(b)
    p = 0
    while p < min(n, m) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(n, m) - p and a[n - 1 - s] == b[m - 1 - s]:
        s += 1
    return max(n, m) - p - s <= 1


def _split(text: str | None) -> list[list[bytes]]:
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _lines(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            rows, place, l1, l2, keys = [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                for i, words in enumerate(_split(text)):
                    if words:
                        x, y = identity(words)
                        rows.append(k), place.append(i), l1.append(x), l2.append(y), keys.append(half_keys(words))
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column("k_id").take(at), b.column("k_hash").take(at), pa.array(place, pa.int32()), pa.array(l1, pa.int64()), pa.array(l2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["k_id", "k_hash", "place", "l1", "l2", "keys"])

    return docs.select(*doc_key(), "text").mapInArrow(run, "k_id long, k_hash long, place int, l1 long, l2 long, keys array<long>")


def removed_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k_id, k_hash, places: of all lines to remove; a row a document that has some), and the packed documents (k_id, k_hash, packed). What led there is
    deleted."""
    lines = stage(_lines(docs), "lines")
    at = F.struct("k_id", "place", "k_hash")
    distinct = stage(lines.groupBy("l1", "l2").agg(F.min(at).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")), "distinct")
    halves = distinct.select("l1", "l2", "first", F.explode("keys").alias("half")).withColumn("meet", _bare(F.col("half")))
    shared = halves.groupBy("meet").agg(F.min("l1").alias("least"), F.max("l1").alias("most")).filter("least <> most").select("meet")
    roles = halves.join(shared, "meet").groupBy("first.k_id", "first.k_hash", "first.place").agg(F.collect_set(F.col("half").bitwiseAND(F.lit(3)).cast("int")).alias("roles"))
    wanted = roles.groupBy("k_id", "k_hash").agg(F.collect_list(F.struct("place", "roles")).alias("wanted"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            yield pa.record_batch([b.column("k_id"), b.column("k_hash"), pa.array([pack(t) for t in b.column("text").to_pylist()], pa.binary())], ["k_id", "k_hash", "packed"])

    texts = docs.select(*doc_key(), "text").mapInArrow(packed, "k_id long, k_hash long, packed binary")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            rows, place, key, role, text = [], [], [], [], []
            for k, (data, found) in enumerate(zip(b.column("packed").to_pylist(), b.column("wanted").to_pylist(), strict=True)):
                split = _split(unpack(data))
                for x in found:
                    words = split[x["place"]]
                    for v, r in variants(words, set(x["roles"])):
                        rows.append(k), place.append(x["place"]), key.append(v), role.append(r), text.append(None)
                    rows.append(k), place.append(x["place"]), key.append(None), role.append(None), text.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column("k_id").take(at), b.column("k_hash").take(at), pa.array(place, pa.int32()), pa.array(key, pa.int64()), pa.array(role, pa.int32()), pa.array(text, pa.string())], ["k_id", "k_hash", "place", "key", "role", "line"])

    # rows that repeat id and text repeat their variants, too; minima don't mind
    emitted = stage(texts.join(wanted, ["k_id", "k_hash"]).mapInArrow(emit, "k_id long, k_hash long, place int, key long, role int, line string"), "variants")
    keyed = emitted.filter("key is not null").drop("line")
    earliest = lambda *r: F.min(F.when(F.col("role").isin(*r), at))
    groups = keyed.groupBy("key").agg(F.min(at).alias("e"), F.max(at).alias("z"), earliest(REPLACED, SELF).alias("short"), earliest(DELETED).alias("long")).filter("e <> z")
    met = keyed.join(groups, "key").withColumn("partner", F.when(F.col("role") == SELF, F.col("long")).otherwise(F.col("short"))).filter(F.col("partner") < at)
    pairs = met.groupBy("k_id", "k_hash", "place").agg(F.min("partner").alias("partner"))
    text = emitted.filter("key is null").groupBy("k_id", "k_hash", "place").agg(F.first("line").alias("line"))
    both = pairs.join(text, ["k_id", "k_hash", "place"]).join(text.select(F.struct("k_id", "place", "k_hash").alias("partner"), F.col("line").alias("other")), "partner")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            ok = pa.array([within_one(x.split(" "), y.split(" ")) for x, y in zip(b.column("line").to_pylist(), b.column("other").to_pylist(), strict=True)], pa.bool_())
            yield b.select(["k_id", "k_hash", "place"]).filter(ok)

    near = both.mapInArrow(verify, "k_id long, k_hash long, place int").select(at.alias("first"), F.lit(True).alias("near"))
    judged = distinct.select("l1", "l2", "first", "n").join(near, "first", "left").filter("n > 1 or near").drop("n")
    gone = lines.select("k_id", "k_hash", "place", "l1", "l2").join(judged, ["l1", "l2"]).filter(F.col("near").isNotNull() | (at != F.col("first")))
    places = stage(gone.groupBy("k_id", "k_hash").agg(F.collect_set("place").alias("places")), "removed-lines")
    forget(lines, distinct, emitted)
    tidy(docs.sparkSession)
    return places, texts


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (kept lines joined by a line feed; null stays null) for every row; n_lines counts lines with a word."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places, texts = removed_lines(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            total, less, kept = [], [], []
            for data, drop in zip(b.column("packed").to_pylist(), b.column("places").to_pylist(), strict=True):
                text = unpack(data)
                gone = set(drop or ())
                total.append(sum(1 for words in _split(text) if words))
                less.append(len(gone))
                kept.append(text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
            ids = [None if k == -(2**63) else k for k in b.column("k_id").to_pylist()]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(less, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    return texts.join(places, ["k_id", "k_hash"], "left").mapInArrow(cut, "doc_id long, n_lines long, n_removed long, text string")


def dedup_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs with all their columns; texts without the removed lines, n_chars (if there is such a column) of the new
    text. Rows that lose all their lines with words go; rows that never had one stay."""
    prepare(docs.sparkSession)
    places, _ = removed_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *doc_key()).join(places, ["k_id", "k_hash"], "left").select("row", F.col("row.text").cast("string").alias("text"), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            kept, stay = [], []
            for text, drop in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                gone = set(drop or ())
                lines = (text or "").split("\n")
                rest = [x for i, x in enumerate(lines) if i not in gone]
                kept.append("\n".join(rest) if gone else text)
                stay.append(not gone or any(x.encode("utf-8", "surrogatepass").split() for x in rest))
            yield pa.record_batch([b.column("row"), pa.array(kept, pa.string())], ["row", "kept"]).filter(pa.array(stay, pa.bool_()))

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("kept", T.StringType())])
    out = rows.mapInArrow(cut, schema)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
