"""Benchmark decontamination by latent semantic retrieval.

Statistics: document frequencies of hashed words over all passages of all documents. Index: a distributed randomised SVD of
the TF-IDF vectors of all passages of the benchmark and of all documents gives a latent space; the benchmark's
passages together weigh twice what the corpus does. Texts are hashed once; what both passes of the SVD read are the stored buckets of the passages. The items of the benchmark are put into clusters by their latent vectors. Search: every window of every document is projected
(items of up to SHORT words are looked for with shorter windows), and items whose cosine
(latent inner product over the lengths of the full vectors) reaches a share of what the item has with itself are candidates. Windows meet the items of a
cluster only if the length of the window's vector, and then the cluster's centre and radius, leave that possible: these bounds are exact, so retrieval finds what
a comparison with all items would.
Verification: the longest common subsequence of words of the item and of the region around the window, unless they have too few words in common for one; an item leaks if
at least LCS_SURE of its words match in order, or LCS_LEAST and the answer check holds: of the words of its closing
sentence, ANSWER_SHARE appear in the region in order.

The benchmark is the query set: it is taken in blocks of ITEM_BLOCK items or BLOCK_BYTES of text against all rows. Null texts are empty and
never leak; items without words, or without id, match nothing that could be named (a nameless item still marks a document). Rows that repeat are judged alike, of equal
shares all items are given. Texts are searched whole, SLICE words at a time, short ones together. An empty benchmark leaks nowhere, empty tables give no rows. Extra columns are
not carried along by `decontaminate`; `keep_clean` keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, forget, prepare, slot, stage, tidy

BITS, PASSAGE = 14, 40
BUCKETS = 1 << BITS
RANK, OVERSAMPLE = 64, 16
#: Passages of a stored row and of a step of the sums; rows of a matrix that travel together.
CELL_ROWS, CHUNK, ROW_BLOCK = 128, 4096, 256
_SIGNS = np.random.default_rng(2).integers(0, 1 << 63, BUCKETS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
#: Columns of the sketch that a passage is in; a bucket that a step has more often is summed by a product of matrices.
SPREAD, OFTEN = 4, 64
#: Items, and bytes of their texts, of a block.
ITEM_BLOCK, BLOCK_BYTES = 8000, 32 << 20
#: Words of a step, steps of a window and of one for items of up to SHORT words, share of an item's own cosine that makes a candidate.
STEP, STEPS, SHORT_STEPS, SHORT, CANDIDATE = 8, 5, 3, 24, 0.4
LCS_SURE, LCS_LEAST, ANSWER_SHARE = 0.75, 0.6, 0.8


#: Byte → random odd number for what makes up words (letters, digits, all bytes over ASCII), 0 for white space and signs.
_VALUES = np.random.default_rng(1).integers(1, 1 << 62, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[[i for i in range(128) if not chr(i).isalnum()]] = 0
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0, 1, ... modulo 2^64, at least n of them."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16) * 2, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and the places of these among its words by white space. A word is hashed without signs,
    A-Z in lower case; words of signs alone are left out. Polynomial hashes of all words at once."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    values = _VALUES[data]
    at = np.flatnonzero(values)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    first = np.flatnonzero(space[:-1] > space[1:]) + 1  # words begin
    if not space[0]:
        first = np.concatenate([[0], first])
    word = np.searchsorted(at, first)
    size = np.diff(np.concatenate([word, [len(at)]]))
    place = np.flatnonzero(size)
    word, size = word[place], size[place]
    upto = np.cumsum(values[at] * _power(_BASE, len(at))[: len(at)], dtype=np.uint64)
    total = upto[word + size - 1]
    total[1:] -= upto[word[1:] - 1]
    h = total * _power(_INVERSE, len(at))[word]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32)), place


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


#: Words of a text that are searched at a time.
SLICE = 1 << 15


def words_of(text: str | None) -> list[int]:
    return hashed(text)[0].tolist()


def answer_of(text: str | None) -> list[int]:
    """Words of the closing sentence; the last eight words if it is shorter than that."""
    sentences = [s for s in map(words_of, re.split(r"[.!?\n]+(?:\s|$)", text or "")) if s]
    words = words_of(text)
    return sentences[-1] if sentences and len(sentences[-1]) >= 8 else words[-8:]


def lcs(pattern: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a bit a pattern word; pattern: word → mask of its places."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = pattern.get(w, 0)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return size - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def cells(rows: DataFrame) -> DataFrame:
    """rows: text. cells (the sorted buckets of CELL_ROWS passages or fewer; a passage has PASSAGE places, empty ones are BUCKETS): all passages of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                ids = bucket(hashed(text)[0])
                if len(ids):
                    cell = np.full(-(-len(ids) // PASSAGE) * PASSAGE, BUCKETS, np.uint16)
                    cell[: len(ids)] = ids
                    found.append(cell.reshape(-1, PASSAGE))
            if found:
                cell = np.sort(np.concatenate(found), axis=1)
                yield pa.record_batch([pa.array([cell[k : k + CELL_ROWS].tobytes() for k in range(0, len(cell), CELL_ROWS)], pa.binary())], ["cells"])

    return rows.select("text").mapInArrow(run, "cells binary")


def _opened(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint16).reshape(-1, PASSAGE)


def document_frequencies(passages: DataFrame) -> tuple[int, np.ndarray]:
    """passages: cells. How many there are, and of each bucket those that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            cell = _opened(b)
            n += len(cell)
            new = np.ones(cell.shape, bool)
            new[:, 1:] = cell[:, 1:] != cell[:, :-1]
            counts += np.bincount(cell[new], minlength=BUCKETS + 1)[:BUCKETS]
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[n], counts[at]]))], ["bucket", "n"])

    df, total = np.zeros(BUCKETS, np.float64), 0
    for r in passages.select("cells").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    return total, df


def _vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit TF-IDF weights."""
    ids, tf = np.unique(bucket(hashed(text)[0]), return_counts=True)
    x = tf * idf[ids]
    size = np.linalg.norm(x)
    return ids, (x / size if size else x).astype(np.float32)


def _lengths(cell: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Lengths of the TF-IDF vectors of passages. idf: of all buckets, and 0 for empty places."""
    start = np.ones(cell.shape, bool)
    start[:, 1:] = cell[:, 1:] != cell[:, :-1]
    at = np.flatnonzero(start)
    x = np.diff(at, append=cell.size) * idf[cell.ravel()[at]]
    return np.sqrt(np.add.reduceat(x * x, np.flatnonzero(at % PASSAGE == 0)))


def _signs(cell: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """SPREAD columns of a sketch that many wide, one in each of its parts, and random signs there for each passage, from its words."""
    h = _SIGNS[cell].sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width = wide // SPREAD
    bits = h[:, None] >> (np.arange(SPREAD, dtype=np.uint64) * np.uint64(64 // SPREAD))
    return ((bits >> np.uint64(1)) % np.uint64(1 << 15) % np.uint64(width)).astype(np.int64) + np.arange(SPREAD) * width, (bits & np.uint64(1)).astype(np.float32) * 2 - 1


def _row_sums(source: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of source that index[first : first + size] names, for every segment of one row or more; with the order of the segments that the sums have."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    out = source[index[first]]
    for k in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))
        out[:n] += source[index[first[:n] + k]]
    return order, out


def _segments(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, np.int64)
    return first, np.diff(first, append=len(sorted_values))


def summed(cell: np.ndarray, idf: np.ndarray, basis: np.ndarray | None, wide: int, weight: float, out: np.ndarray) -> None:
    """Adds to out, before the idf of its rows, X'XB for unit passages X and the basis B (that has its idf); without a basis X'S for sparse random signs S."""
    for k in range(0, len(cell), CHUNK):
        part = cell[k : k + CHUNK]
        length = _lengths(part, idf)
        part, length = part[length > 0], length[length > 0]
        if not len(part):
            continue
        if basis is None:
            column, sign = _signs(part, wide)
            row = part.astype(np.int64) * wide
            for j in range(SPREAD):
                np.add.at(out.ravel(), (row + column[:, j, None]).ravel(), np.repeat(sign[:, j] * (weight / length).astype(np.float32), PASSAGE))
            continue
        flat = part.ravel()
        count = np.bincount(flat, minlength=BUCKETS + 1)
        count[BUCKETS] = 0  # its row of the basis is 0
        often = np.flatnonzero(count > OFTEN)
        place = np.full(BUCKETS + 1, -1, np.int32)
        place[often] = np.arange(len(often))
        passage = np.repeat(np.arange(len(part)), PASSAGE)
        dense = place[flat]
        mine = dense >= 0
        x = np.bincount(passage[mine] * len(often) + dense[mine], minlength=len(part) * len(often)).reshape(len(part), -1).astype(np.float32)
        y = x @ basis[often]
        rest = ~mine & (flat < BUCKETS)
        flat, passage = flat[rest], passage[rest]
        first, size = _segments(passage)
        order, sums = _row_sums(basis, flat, first, size)
        y[passage[first[order]]] += sums
        y *= ((weight / length) ** 2).astype(np.float32)[:, None]
        out[often] += x.T @ y
        order = np.argsort(flat, kind="stable")
        flat, passage = flat[order], passage[order]
        first, size = _segments(flat)
        order, sums = _row_sums(y, passage, first, size)
        out[flat[first[order]]] += sums


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """passages: cells, weight. BUCKETS x rank: leading right singular vectors of all of them, by a randomised SVD: a sketch by sparse signs, one power step, and Nystrom's form of what the
    step gives. Both passes sum a matrix over the partitions; partial matrices are summed by blocks of rows on the executors, so one matrix comes to the driver however
    many partitions there are."""
    wide = rank + OVERSAMPLE
    padded = np.concatenate([idf, [0.0]])

    def total(basis: np.ndarray | None) -> np.ndarray:
        scaled = None if basis is None else np.concatenate([basis * idf[:, None], np.zeros((1, wide))]).astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot(None)
            out = np.zeros((BUCKETS + 1, wide), np.float32)
            for b in batches:
                weights = b.column("weight").to_numpy()
                for weight in np.unique(weights).tolist():
                    summed(_opened(b.filter(pa.array(weights == weight))), padded, scaled, wide, weight, out)
            for k in range(0, BUCKETS, ROW_BLOCK):
                part = out[k : k + ROW_BLOCK] if k + ROW_BLOCK < BUCKETS else out[k:BUCKETS]
                if part.any():
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["at", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot(None)
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for at, part in zip(b.column("at").to_pylist(), b.column("part").to_pylist(), strict=True):
                    x = np.frombuffer(part, np.float32).astype(np.float64)
                    sums[at] = sums[at] + x if at in sums else x
            for at, x in sums.items():
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["at", "part"])

        out = np.zeros((BUCKETS, wide), np.float64)
        for r in passages.mapInArrow(run, "at int, part binary").repartition("at").mapInArrow(add, "at int, part binary").collect():  # one matrix
            block = np.frombuffer(r.part, np.float32).reshape(-1, wide)
            out[r["at"] : r["at"] + len(block)] += block
        return out * idf[:, None]

    basis, _ = np.linalg.qr(total(None))
    power = total(basis)
    inner = basis.T @ power
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = value > 1e-6 * max(value.max(), 1e-30)
    if not keep.any():
        return np.zeros((BUCKETS, 1), np.float32)
    left, _, _ = np.linalg.svd(power @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return left[:, :rank].astype(np.float32)


def clusters(points: np.ndarray, rounds: int = 6) -> list[np.ndarray]:
    """Members of about sqrt(n) clusters of points, by a few rounds of k-means from evenly spaced points."""
    n = len(points)
    k = max(1, int(n**0.5))
    centres = points[np.linspace(0, n - 1, k).astype(int)] if n else points
    of = np.zeros(n, np.int64)
    for _ in range(rounds if k > 1 else 0):
        of = np.concatenate([((centres**2).sum(1) - 2 * points[i : i + 4096] @ centres.T).argmin(1) for i in range(0, n, 4096)])
        centres = np.array([points[of == c].mean(0) if (of == c).any() else centres[c] for c in range(k)], np.float32)
    return [m for c in range(k) if len(m := np.flatnonzero(of == c))]


@dataclass
class Index:
    table: np.ndarray  # BUCKETS + 1 x rank: latent vectors of words, weighted; the last for empty places
    norms: np.ndarray  # squared weights of words, and 0
    ids: list[int | None]
    words: list[list[int]]
    answers: list[list[int]]
    latent: np.ndarray  # items x rank, unit in the full space
    own: np.ndarray  # cosine of an item with itself, within the latent space

    @staticmethod
    def of(space: np.ndarray, idf: np.ndarray, items: list[tuple[int | None, str | None]]) -> Index:
        table = np.concatenate([space * idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
        vectors = [_vector(t, idf) for _, t in items]
        latent = np.array([x @ space[ids] for ids, x in vectors], np.float32).reshape(len(items), space.shape[1])
        return Index(table, np.concatenate([idf**2, [0.0]]).astype(np.float32), [i for i, _ in items], [words_of(t) for _, t in items], [answer_of(t) for _, t in items], latent, np.maximum((latent**2).sum(1), 1e-3))


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.patterns = [(_masks(w), len(w)) for w in index.words]
        self.counts = [np.unique(np.array(w, np.uint64), return_counts=True) for w in index.words]
        self.answers = [(_masks(w), len(w)) for w in index.answers]
        goal = (index.latent / index.own[:, None]).astype(np.float32)
        sizes = np.array([len(w) for w in index.words], np.int64)
        #: For each width of windows: steps, longest goal, and clusters as (items, goals, centre, radius).
        self.widths = []
        for steps, mine in ((STEPS, np.flatnonzero(sizes > SHORT)), (SHORT_STEPS, np.flatnonzero((sizes > 0) & (sizes <= SHORT)))):
            groups = []
            for members in clusters(goal[mine]):
                g = goal[mine[members]]
                centre = g.mean(0)
                groups.append((mine[members], g.T.copy(), centre, float(np.linalg.norm(g - centre, axis=1).max()) * 1.0001 + 1e-6))
            if groups:
                longest = float(np.linalg.norm(goal[mine], axis=1).max()) * 1.0001 + 1e-6
                self.widths.append((steps, longest, groups, np.array([c for _, _, c, _ in groups]).T.copy(), np.array([r for *_, r in groups], np.float32)))

    def candidates(self, ids: np.ndarray, starts: list[int] = [0]) -> list[tuple[int, int, int]]:  # noqa: B006
        """(item, first word, words) of windows that reach the item's cosine. starts: of the texts, none of them empty, that ids holds one after another; no window crosses into the next."""
        starts = np.array(starts, np.int64)
        sizes = np.diff(starts, append=len(ids))
        steps_of = -(-sizes // STEP)
        ends = np.cumsum(np.maximum(steps_of, STEPS))
        begin = np.concatenate([[0], ends[:-1]])
        grid = np.full(ends[-1] * STEP, BUCKETS, np.int64)
        grid[np.arange(len(ids)) + np.repeat(begin * STEP - starts, sizes)] = ids
        grid = grid.reshape(-1, STEP)
        cell, weight = self.index.table[grid[:, 0]], self.index.norms[grid].sum(1)
        for k in range(1, STEP):
            cell += self.index.table[grid[:, k]]
        out: list[tuple[int, int, int]] = []
        for steps, longest, groups, centres, radii in self.widths:
            n = len(cell) - steps + 1
            total, square = cell[:n].copy(), weight[:n].copy()
            for k in range(1, steps):
                total += cell[k : k + n]
                square += weight[k : k + n]
            least = CANDIDATE * np.sqrt(np.maximum(square, 1e-9))
            length = np.sqrt(np.einsum("ij,ij->i", total, total))
            many = np.maximum(steps_of - steps + 1, 1)  # windows of each text
            rows = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            rows = rows[length[rows] * longest >= least[rows]]
            if not len(rows):
                continue
            mine, need, size = total[rows], least[rows], length[rows]
            of = np.searchsorted(begin, rows, "right") - 1
            first = (rows - begin[of]) * STEP + starts[of]
            possible = mine @ centres + size[:, None] * radii >= need[:, None]
            for c in np.flatnonzero(possible.any(0)).tolist():
                items, goals, _, _ = groups[c]
                at = np.flatnonzero(possible[:, c])
                window, item = np.nonzero(mine[at] @ goals >= need[at, None])
                out += zip(items[item].tolist(), first[at[window]].tolist(), [steps * STEP] * len(item), strict=True)
        return out

    def verify(self, item: int, region: np.ndarray) -> float:
        """Share of the item's words in order if it leaks, else 0."""
        pattern, size = self.patterns[item]
        if not size:
            return 0.0
        words, counts = self.counts[item]
        at = np.minimum(np.searchsorted(words, region), len(words) - 1)
        shared = words[at] == region
        # no more words can match in order than the two have in common
        if np.minimum(np.bincount(at[shared], minlength=len(words)), counts).sum() / size < LCS_LEAST:
            return 0.0
        share = lcs(pattern, size, region[shared].tolist()) / size
        if share >= LCS_SURE:
            return share
        if share >= LCS_LEAST:
            pattern, size = self.answers[item]
            return share if lcs(pattern, size, region.tolist()) >= ANSWER_SHARE * size else 0.0
        return 0.0

    def leaks(self, texts: list[str | None]) -> list[dict[int, float]]:
        """Of each text, item → share of its words, over the whole text. Short texts are searched together."""
        found: list[dict[int, float]] = [{} for _ in texts]
        if not self.index.ids:
            return found
        held: list[tuple[int, np.ndarray, int, int]] = []  # text, its words, from, to
        n = 0
        done: set[tuple[int, int, int]] = set()

        def search() -> None:
            starts = np.cumsum([0, *(high - low for *_, low, high in held)])
            for item, at, width in self.candidates(bucket(np.concatenate([words[low:high] for _, words, low, high in held])), starts[:-1].tolist()):
                k = int(np.searchsorted(starts, at, "right")) - 1
                text, words, low, _ = held[k]
                at += low - int(starts[k])
                size = self.patterns[item][1]
                cell = at // max(width, size // 2)  # neighbours see the same region
                if (text, item, cell) in done:
                    continue
                done.add((text, item, cell))
                reach = max(width, size)
                share = self.verify(item, words[max(0, at - reach) : at + width + reach])
                if share > found[text].get(item, 0.0):
                    found[text][item] = share
            held.clear()

        overlap = 2 * STEP * STEPS
        for t, text in enumerate(texts):
            words, _ = hashed(text)
            for k in range(0, len(words), SLICE):  # long texts by overlapping slices
                held.append((t, words, max(0, k - overlap), min(len(words), k + SLICE)))
                n += held[-1][3] - held[-1][2]
                if n >= SLICE:
                    search()
                    n = 0
        if held:
            search()
        return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. doc_id, contaminated, item_ids (sorted) and best_share for every row."""
    return _find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, item_block)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated."""
    bad = stage(_find(docs.select(*doc_key(), F.col("text").cast("string").alias("text")), benchmark).filter("contaminated").select("k_id", "k_hash").distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *doc_key())
    return rows.join(bad, ["k_id", "k_hash"], "left_anti").select("row.*")


def _find(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """docs: longs, and text. Its longs, contaminated, item_ids, best_share."""
    prepare(docs.sparkSession)
    carried = [c for c in docs.columns if c != "text"]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n_items // item_block), -(-n_bytes // BLOCK_BYTES))
    corpus, asked = stage(cells(docs), "passages"), stage(cells(items), "asked")
    passages, df = document_frequencies(corpus)
    idf = np.maximum(np.log((passages + 1) / (df + 1)), 0) ** 1.5
    # together the passages of the benchmark weigh twice what those of all documents do
    n_asked = asked.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0] // (2 * PASSAGE)
    weight = float(np.sqrt(max(1.0, 2.0 * passages / max(1, n_asked))))
    space = latent_space(asked.withColumn("weight", F.lit(weight)).union(corpus.withColumn("weight", F.lit(1.0))), idf)
    forget(corpus, asked)
    tidy(docs.sparkSession)

    def search(docs: DataFrame, index: Index) -> DataFrame:
        carried = [c for c in docs.columns if c != "text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot(None)
            searcher = Searcher(index)
            for b in batches:
                found = searcher.leaks(b.column("text").to_pylist())
                ids = [sorted({index.ids[i] for i in f if index.ids[i] is not None}) for f in found]
                yield pa.record_batch([*map(b.column, carried), pa.array([bool(f) for f in found], pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())], [*carried, "contaminated", "item_ids", "best_share"])

        return docs.mapInArrow(run, "".join(f"{c} long, " for c in carried) + "contaminated boolean, item_ids array<long>, best_share double")

    def block(k: int) -> Index:
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k)
        return Index.of(space, idf, [(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()])

    if blocks == 1:
        return search(docs, block(0))
    # more blocks: a search a block, then united by the keys of the rows (equal rows have equal results)
    keyed = docs.select(*carried, "text", F.xxhash64(*carried, "text").alias("row"), F.xxhash64("text", F.lit(1)).alias("twin"))
    parts = [stage(search(keyed.select("row", "twin", "text"), block(k)).filter("contaminated"), "block") for k in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    hits = stage(every.select("row", "twin", "best_share", F.explode_outer("item_ids").alias("item")).groupBy("row", "twin").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("best_share").alias("best_share")), "hits")
    forget(*parts)
    none = F.array().cast("array<long>")
    return keyed.drop("text").join(hits, ["row", "twin"], "left").select(*carried, F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"))
