"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles, repeats included; A-Z are lower-cased first. Texts without words have
fingerprint zero, which links like any other.

Index: fingerprints within `max_bits` <= 2 differ in at most `max_bits` of eight byte positions, so they share at least
8 - `max_bits` positional bytes: the guaranteed minimum of matches. A posting is a combination of that many positional bytes, with the
positions left open; two fingerprints meet in a list if and only if their tally of shared positional bytes reaches the minimum. Lists of one
fingerprint go. Their members agree but for the open bytes, so a list can't grow beyond the values of these, however many documents there are.

Verification without pairs: the open positions of all of a fingerprint's lists are united, and it emits itself and its one-bit changes there.
All that meet in one value differ by two bits at most (one, if only the changes of a bit meet the fingerprint itself), and any two that do meet: a star to the least of
them keeps every connection, and the links of the star are checked by their differing bits. Work is linear in the number of fingerprints,
whatever their groups.

Components are labelled by hooking to the least neighbouring label and pointer jumping.

Null texts count as empty. Null ids take part; a component's id is its least id that isn't null. Rows
with the same id stay separate rows. Texts of any length are taken whole, SLICE shingles at a time; a bit set in exactly half of the hashes is 0.
Extra columns are not carried along. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, forget, join_hot, prepare, slot, stage, tidy

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
#: Shingle hashes whose bits are counted at a time.
SLICE = 65536


def hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the shingles in order, repeats included."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return np.empty(0, np.uint64)
    n = len(data)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(data)
    if n <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n - words + 1)


def majority(found: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(found), SLICE):
        part = found[k : k + SLICE]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(total * 2 > len(found)).tolist())


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, k_id and k_hash (identity of the row), fp (the fingerprint as a signed long)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), b.column("k_id"), b.column("k_hash"), pa.array(fps.view(np.int64))], ["doc_id", "k_id", "k_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", *doc_key(), "text").mapInArrow(run, "doc_id long, k_id long, k_hash long, fp long")


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def postings(nodes: DataFrame, max_bits: int) -> DataFrame:
    """fp, key (which positions, and their bytes), open (mask of the other bytes) for every combination of 8 - max_bits positions."""
    rows = []
    for c, free in enumerate(combinations(range(8), max_bits)):
        key = F.lit(c).cast("long")
        for p in range(8):
            if p not in free:
                key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        rows.append(F.struct(key.alias("key"), F.lit(sum(1 << p for p in free)).alias("open")))
    return nodes.select("fp", F.explode(F.array(*rows)).alias("p")).select("fp", "p.*")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """nodes: distinct fp. Links (a, b), a < b, each within max_bits, that connect what is connected within max_bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("0 to 2 bits")
    if not max_bits:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    lists = postings(nodes, max_bits).groupBy("key", "open").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    met = stage(lists.select("open", F.explode("fps").alias("fp")).groupBy("fp").agg(F.bit_or("open").alias("open")), "met")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("open"), F.shiftright(i, 3)).bitwiseAND(F.lit(1)) == 1)
    changed = F.transform(bits, lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if max_bits == 1:  # a link is a one-bit change itself
        out = met.select(F.col("fp").alias("a"), F.explode(changed).alias("b")).join(met.select(F.col("fp").alias("b")), "b", "left_semi").filter("a < b")
    else:
        values = met.select("fp", F.explode(F.concat(F.array("fp"), changed)).alias("v"))
        out = values.groupBy("v").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return out.filter(_differing(F.col("a"), F.col("b")) <= max_bits).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs → (node, label): the least node of its component. Each round takes the least label
    of the neighbours, then that label's own label; rounds grow with the log of the longest path in the common case."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b"), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        hooked = both.join(labels.select(F.col("node").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = stage(labels.join(hooked, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stage(near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        done = new.filter("label <> old").isEmpty()
        forget(labels, near)
        labels = new.select("node", "label")
        labels.staged_at = new.staged_at
        if done:
            forget(both)
            return labels


def _labelled(docs: DataFrame, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, (fp, least, first, copies, label) of each distinct fingerprint)."""
    fps = stage(fingerprints(docs, words), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("k_id", "k_hash")).alias("first"), F.count("*").alias("copies")), "nodes")
    labels = components(links(nodes.select("fp"), max_bits))
    tidy(docs.sparkSession)
    return fps, nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) for every row."""
    fps, labelled = _labelled(docs, words, max_bits)
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = stage(join_hot(labelled, ids, ["label"], "n", labelled.count()).select("fp", "component_id", "copies"), "components")
    return join_hot(fps, of, ["fp"], "copies", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their component by id (null ids before others) and a hash of
    the row; of rows that repeat id and text one."""
    _, labelled = _labelled(docs, words, max_bits)
    first = labelled.groupBy("label").agg(F.min("first").alias("first")).select("first.k_id", "first.k_hash")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *doc_key()).join(first, ["k_id", "k_hash"], "left_semi")
    return rows.dropDuplicates(["k_id", "k_hash"]).select("row.*")
