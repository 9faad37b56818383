"""Substring dedup with prefix-partitioned (sparse) suffix trees over words.

A window is WINDOW consecutive words of one document; a word goes if a window that covers it starts anywhere
else, too. Suffixes enter the tree through anchors: in each window the leftmost least hash of its GRAM-word
sequences. Equal windows have equal anchors at the same offset, so only suffixes that share their
anchor's words (a prefix that all of them have in the tree) with another one can have a deep node above them. The suffixes of an anchor are the
starts of its run of windows, its context.

Groups by anchor are the partitions. One that is larger than GROUP_CAP contexts is made memory-sized: equal contexts are counted and become
one, and the others are dealt out by their whole prefix (the hash of the context), so that each part has GROUP_CAP contexts or so. In every part a subtree is
built: its suffixes are sorted by their first WINDOW words with prefix doubling, and runs of equal ones are the nodes of that depth, with the suffixes as
their leaves. A tree need not be deeper. In a group of one part, a node with two leaves is a deep internal node. In a group of several parts, each
hands on its nodes (a hash of the path and the number of leaves), and nodes with the same path are one node of the whole tree:
their leaves are summed. Runs of deep leaves in a document are its maximal repeats, the spans to remove.

Null texts have no words. Rows that repeat both id and text count as occurrences of their own. Texts of any length are taken whole. Where several
sequences of a window have the least hash, the leftmost is the anchor. Extra columns are not carried along. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, forget, join_hot, pack, prepare, slot, stage, tidy, unpack

WINDOW, GRAM = 35, 8
#: Contexts that one subtree holds, about; larger groups are built in parts.
GROUP_CAP = 1000
#: Rows of one subtree build; at least one group.
BUILD_ROWS = 4000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sequence(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = (out + h[k : k + n]) * _ODD if n > 0 else out
    return _mix(out)


def anchors_of(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: hash, first and last start of the windows that it anchors."""
    starts = len(h) - window + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    g = _sequence(h, gram)
    span = window - gram + 1
    least, size = np.arange(len(g)), 1
    while size < span:
        step = min(size, span - size)
        i, j = least[:-step], least[step:]
        least, size = np.where(g[j] < g[i], j, i), size + step
    lo = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    hi = np.concatenate([lo[1:] - 1, [starts - 1]])
    return g[least[lo]], lo, hi


class Subtree:
    """The nodes of depth `window` over the suffixes of contexts (the words of a run of windows each), in the order of their paths.
    leaf_context, leaf_offset: of each leaf, node by node; first: where the leaves of each node begin. With `least` 2 nodes of one leaf are left out."""

    def __init__(self, contexts: list[np.ndarray], window: int, least: int = 1):
        sizes = np.array([len(c) for c in contexts])
        words = np.concatenate(contexts)
        _, rank = np.unique(words, return_inverse=True)
        depth = 1
        while depth < window:  # ranks by the first `depth` words give ranks by twice as many
            step = min(depth, window - depth)
            pair = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
            _, rank = np.unique(pair, return_inverse=True)
            depth += step
        ends = np.cumsum(sizes)
        place = np.arange(len(rank))
        context = np.repeat(np.arange(len(sizes)), sizes)[: len(rank)]
        inside = place <= ends[context] - window
        if least > 1:
            inside &= np.bincount(rank[inside], minlength=int(rank.max()) + 1)[rank] >= least
        at = place[inside]
        at = at[np.argsort(rank[at], kind="stable")]
        self.leaf_context, self.leaf_offset = context[at], at - (ends - sizes)[context[at]]
        node = rank[at]
        self.first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.words, self.place = words, at

    def paths(self, window: int) -> np.ndarray:
        """A hash of the path of each node."""
        return _sequence(self.words, window)[self.place[self.first]]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted starts → (first, last) of runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True))


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            rows, found = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                words = _words(text)
                if len(words) >= window:
                    found.append(anchors_of(_hashes(words), window, gram))
                    rows.append(np.full(len(found[-1][0]), k))
            if found:
                at = pa.array(np.concatenate(rows))
                g, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([b.column("k_id").take(at), b.column("k_hash").take(at), pa.array(g.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["k_id", "k_hash", "g", "lo", "hi"])

    return docs.select(*doc_key(), "text").mapInArrow(run, "k_id long, k_hash long, g long, lo int, hi int")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_cap: int = GROUP_CAP) -> tuple[DataFrame, DataFrame]:
    """(runs, texts): maximal runs of repeated windows (k_id, k_hash, lo, hi: first and last start), and
    the packed texts of all documents that may have some (k_id, k_hash, packed; rows repeat as in docs)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchors = stage(_anchors(docs, window, gram), "anchors")
    groups = stage(anchors.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "groups")  # as a table, so that a hot group's join can be split
    active = anchors.join(groups, "g").groupBy("k_id", "k_hash").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "g", F.ceil(F.col("n") / group_cap).alias("parts")))).alias("found"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            yield pa.record_batch([b.column("k_id"), b.column("k_hash"), pa.array([pack(t) for t in b.column("text").to_pylist()], pa.binary())], ["k_id", "k_hash", "packed"])

    texts = stage(docs.select(*doc_key(), "text").mapInArrow(packed, "k_id long, k_hash long, packed binary").join(active, ["k_id", "k_hash"]), "active")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row an anchor: the words of its windows, and a hash of these."""
        slot(None)
        for b in batches:
            rows, key, same, first, last, words, parts = [], [], [], [], [], [], []
            for k, (data, found) in enumerate(zip(b.column("packed").to_pylist(), b.column("found").to_pylist(), strict=True)):
                h = _hashes(_words(unpack(data)))
                for x in found:
                    part = h[x["lo"] : x["hi"] + window].tobytes()
                    rows.append(k), key.append(x["g"]), first.append(x["lo"]), last.append(x["hi"]), words.append(part), parts.append(x["parts"]), same.append(xxhash.xxh3_64_intdigest(part))
            at = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [b.column("k_id").take(at), b.column("k_hash").take(at), pa.array(key, pa.int64()), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(words, pa.binary()), pa.array(parts, pa.int64())],
                ["k_id", "k_hash", "key", "same", "lo", "hi", "words", "parts"],
            )

    forget(anchors, groups)
    tidy(docs.sparkSession)
    fields = "k_id long, k_hash long, lo int, hi int"

    def leaves(which: str) -> DataFrame:
        mine = texts.withColumn("found", F.expr(f"filter(found, x -> x.parts {which})")).filter(F.size("found") > 0)
        return mine.mapInArrow(suffixes, "k_id long, k_hash long, key long, same long, lo int, hi int, words binary, parts long")

    def spans(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Runs of deep leaves of whole groups."""
        lo, out = t.column("lo").to_numpy(), []
        tree = Subtree([np.frombuffer(w, np.uint64) for w in t.column("words").to_pylist()], window, 2)
        order = np.lexsort((tree.leaf_offset, tree.leaf_context))
        context, offset = tree.leaf_context[order], tree.leaf_offset[order]
        cut = np.flatnonzero((np.diff(context) != 0) | (np.diff(offset) > 1)) if len(order) else np.zeros(0, np.int64)
        if len(order):
            a, z = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(order) - 1]])
            at = pa.array(context[a])
            out = [t.column("k_id").take(at).combine_chunks(), t.column("k_hash").take(at).combine_chunks(), pa.array((offset[a] + lo[context[a]]).astype(np.int32)), pa.array((offset[z] + lo[context[z]]).astype(np.int32))]
            yield pa.record_batch(out, ["k_id", "k_hash", "lo", "hi"])

    # suffixes take several times the room of their texts: those of whole groups go straight to the trees, and only those that are read again are stored
    small = leaves("= 1").select("k_id", "k_hash", "key", "lo", "hi", "words")
    tree = small.repartition("key").sortWithinPartitions("key").mapInArrow(_by_group(spans), fields)
    return tree.union(_in_parts(stage(leaves("> 1"), "suffixes"), window)), texts


def _by_group(build: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key; build gets whole groups, BUILD_ROWS or more rows of them but at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BUILD_ROWS:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # rows before the last group
                if whole:
                    yield from build(t.slice(0, whole))
                held = t.slice(whole).to_batches()
                rows -= whole
        if rows:
            yield from build(pa.Table.from_batches(held))

    return run


def _in_parts(leaves: DataFrame, window: int) -> DataFrame:
    """Groups of several parts. Suffixes with the same words around are counted first, by partial sums, so the copies of a passage make one context;
    every part of a group hands on a row a node, and rows of the same path are summed."""
    contexts = leaves.groupBy("same").agg(F.count("*").alias("n"), F.min(F.struct("key", "parts")).alias("of"), F.any_value("words").alias("words"))
    dealt = contexts.select("same", "n", "words", F.xxhash64("of.key", F.pmod(F.xxhash64("same"), F.col("of.parts"))).alias("key"))

    def nodes(t: pa.Table) -> Iterator[pa.RecordBatch]:
        same, n = t.column("same").to_numpy(), t.column("n").to_numpy()
        tree = Subtree([np.frombuffer(w, np.uint64) for w in t.column("words").to_pylist()], window)
        if len(tree.first):
            leaf_n = n[tree.leaf_context]
            ends = pa.array(np.concatenate([tree.first, [len(leaf_n)]]).astype(np.int32))
            leaf = lambda x: pa.ListArray.from_arrays(ends, pa.array(x))
            yield pa.record_batch(
                [pa.array(tree.paths(window).view(np.int64)), pa.array(np.add.reduceat(leaf_n, tree.first)), leaf(same[tree.leaf_context]), leaf(leaf_n), leaf(tree.leaf_offset.astype(np.int32))],
                ["path", "leaves", "same", "n", "offset"],
            )

    found = stage(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_by_group(nodes), "path long, leaves long, same array<long>, n array<long>, offset array<int>"), "nodes")
    deep = found.groupBy("path").agg(F.sum("leaves").alias("leaves")).filter("leaves > 1").select("path")
    leaf = found.join(deep, "path", "left_semi").select(F.explode(F.arrays_zip("same", "n", "offset")).alias("leaf")).select("leaf.*")
    deep_leaves = leaf.groupBy("same").agg(F.max("n").alias("n"), F.collect_set("offset").alias("offsets"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            got = [_runs(np.sort(np.array(x))) for x in b.column("offsets").to_pylist()]
            ends = pa.array(np.cumsum([0] + [len(g) for g in got]).astype(np.int32))
            each = lambda i: pa.ListArray.from_arrays(ends, pa.array([r[i] for g in got for r in g], pa.int32()))  # noqa: B023, E731
            yield pa.record_batch([b.column("same"), b.column("n"), each(0), each(1)], ["same", "n", "a", "z"])

    spans = stage(deep_leaves.mapInArrow(runs, "same long, n long, a array<int>, z array<int>"), "context-spans")
    forget(found)
    tidy(leaves.sparkSession)
    back = join_hot(leaves.select("k_id", "k_hash", "same", "lo"), spans, ["same"], "n", leaves.count())
    each = back.select("k_id", "k_hash", "lo", F.explode(F.arrays_zip("a", "z")).alias("s"))
    return each.select("k_id", "k_hash", (F.col("lo") + F.col("s.a")).alias("lo"), (F.col("lo") + F.col("s.z")).alias("hi"))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_cap: int = GROUP_CAP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space, and the spans that went
    ("first:end" in words, comma-joined) for every row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs, texts = repeats(docs, window, gram, group_cap)
    spans = runs.groupBy("k_id", "k_hash").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            gone, shas, at = [], [], []
            for data, found in zip(b.column("packed").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = _words(unpack(data))
                merged: list[list[int]] = []
                for x in found:
                    if merged and x["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["hi"] + window)
                    else:
                        merged.append([x["lo"], x["hi"] + window])
                kept, end = [], 0
                for a, z in merged:
                    kept += words[end:a]
                    end = z
                kept += words[end:]
                gone.append(len(words) - len(kept)), shas.append(_sha(kept)), at.append(",".join(f"{a}:{z}" for a, z in merged))
            yield pa.record_batch([b.column("k_id"), b.column("k_hash"), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(at, pa.string())], ["k_id", "k_hash", "n_removed", "kept_sha256", "spans"])

    changed = texts.select("k_id", "k_hash", "packed").join(spans, ["k_id", "k_hash"]).mapInArrow(cut, "k_id long, k_hash long, n_removed long, kept_sha256 string, spans string").dropDuplicates(["k_id", "k_hash"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            words = [_words(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("k_id"), b.column("k_hash"), b.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array([_sha(w) for w in words], pa.string())], ["k_id", "k_hash", "doc_id", "n_words", "sha"])

    every = docs.select(*doc_key(), "doc_id", "text").mapInArrow(whole, "k_id long, k_hash long, doc_id long, n_words long, sha string")
    return every.join(changed, ["k_id", "k_hash"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
