"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hashed form and prefixes. Filters of several widths slide over
the words of the whole text, each keeps its maximum, and a logistic layer weighs the maxima. Embeddings, filters and weights start at random and are learnt
together by stochastic gradients. A calibration fold, apart from the gradient's, sets the scale so that 0.5 is the
best cut. Thresholds by language come from the scores of all labelled documents of that fold in the whole table, as histograms that are summed in Spark; language
never enters the score.

Only rows whose crc32 of the id as text is not divisible by 5 teach. The classifier is fitted on a bounded sample of them: MAX_TRAIN rows by a hash of their id,
of texts of at most MAX_CHARS characters (longer ones teach nothing but count for the thresholds). Scores are of whole texts, SLICE words at a time.
Null and empty texts score as a text without words. Null ids are never held out and never taught
from. Rows that repeat are scored alike; of contradicting labels of an id the larger counts. A score of exactly 0.5, or of the threshold, is over it. Without
labels every score is the prior. Empty tables give no rows. Extra columns are not carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, prepare, slot, stage

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
PREFIXES = (3, 4, 5, 6)
MAX_TRAIN, MAX_CHARS, EPOCHS, RATE, EMBEDDING_RATE, BATCH = 6000, 32_000, 6, 0.02, 0.3, 16
#: Labels that a language needs for a threshold of its own.
LEAST_LABELS, BINS = 50, 1000
#: Words, and characters of them, memoised per Python worker; words that are convolved at a time, and that are learnt together at most.
MEMO_WORDS, MEMO_CHARS, SLICE, GROUP = 400_000, 8_000_000, 1 << 16, 1 << 18
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>_-"


_START = zlib.crc32(b"<")


def buckets(word: str) -> list[int]:
    """Hashed features of a word: itself and its prefixes."""
    w = word.strip(_STRIP).lower()
    if not w:
        return []
    out, crc, at = [], _START, 0
    for k in PREFIXES:
        if len(w) < k:
            break
        crc = zlib.crc32(w[at:k].encode("utf-8", "surrogatepass"), crc)
        out.append(crc % BUCKETS)
        at = k
    out.append(zlib.crc32(w[at:].encode("utf-8", "surrogatepass") + b">", crc) % BUCKETS)
    return out


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray  # a filter
    out: np.ndarray  # a filter
    prior: float  # logit of a text without words
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"embedding": self.embedding.astype(np.float16)}

    def __setstate__(self, state):
        self.__dict__.update(state | {"embedding": state["embedding"].astype(np.float32)})


class Scorer:
    """Scores texts; of each word all filter positions' products are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.across = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in model.filters], axis=1).astype(np.float32)
        self.padded = np.concatenate([model.embedding, np.zeros((1, DIM), np.float32)])
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.held = 0
        self.products = np.zeros((4096, self.across.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        """Products of all of these words that aren't known yet; there are GROUP at most."""
        new = words - self.rows.keys()
        size = sum(map(len, new))
        if len(self.rows) + len(new) > MEMO_WORDS or self.held + size > MEMO_CHARS:
            self._reset()
            new, size = words, sum(map(len, words))
        self.held += size
        ordered = sorted(new)
        for k in range(0, len(ordered), SLICE):
            part = ordered[k : k + SLICE]
            ids = np.full((len(part), len(PREFIXES) + 1), BUCKETS, np.int64)
            for i, w in enumerate(part):
                found = buckets(w)
                ids[i, : len(found)] = found
            n = len(self.rows)
            while n + len(part) > len(self.products):
                self.products = np.concatenate([self.products, np.zeros_like(self.products)])
            self.products[n : n + len(part)] = self.padded[ids].sum(1) @ self.across
            self.rows.update(zip(part, range(n, n + len(part)), strict=True))

    def _pool(self, words: list[str], most: np.ndarray) -> None:
        """Raises the maxima by the windows of known words."""
        p = self.products[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        at = 0
        for i, width in enumerate(WIDTHS):
            n = len(p) - width + 1
            if n > 0:
                total = p[:n, at : at + FILTERS]
                for j in range(1, width):
                    total = total + p[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                mine = most[i * FILTERS : (i + 1) * FILTERS]
                np.maximum(mine, total.max(0), out=mine)
            at += width * FILTERS

    def _logit(self, words: list[str], known: bool) -> float:
        if not words:
            return self.model.prior
        most = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for k in range(0, len(words), SLICE):
            part = words[k : k + SLICE + max(WIDTHS) - 1]
            if not known:
                self.learn(set(part))
            self._pool(part, most)
        hidden = np.maximum(np.where(np.isfinite(most), most, 0) + self.model.bias, 0)
        return float(hidden @ self.model.out) + self.model.prior

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out: list[float] = []
        group: list[list[str]] = []

        def finish() -> None:
            self.learn(set().union(*group))
            out.extend(self._logit(words, True) for words in group)
            group.clear()

        size = 0
        for t in texts:
            words = (t or "").split()
            if size + len(words) > GROUP:
                finish()
                size = 0
            if len(words) > GROUP:  # one of its own, learnt slice by slice
                out.append(self._logit(words, False))
            else:
                group.append(words)
                size += len(words)
        finish()
        return np.array(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.model.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -30, 30)))


def fit(texts: list[str], labels: list[int], folds: list[int], seed: int = 7) -> Model:
    """folds: 0 for the gradient, 1 for calibration."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    size = len(WIDTHS) * FILTERS
    model = Model(embedding, filters, np.zeros(size, np.float32), rng.normal(0.2, 0.05, size).astype(np.float32), -2.0)
    teach = [i for i in range(len(texts)) if folds[i] == 0]
    if not 0 < sum(labels[i] for i in teach) < len(teach):
        p = (sum(labels) + 0.5) / (len(labels) + 1)
        model.prior, model.out = float(np.log(p / (1 - p))), np.zeros(size, np.float32)
        return model
    memo: dict[str, list[int]] = {}
    words = [[memo[w] if w in memo else memo.setdefault(w, buckets(w)) for w in texts[i].split()] for i in teach]
    flat = [(np.array([x for w in ws for x in w] or [0], np.int64), np.cumsum([0] + [len(w) for w in ws])) for ws in words]
    speed = [np.full_like(p, 1e-3) for p in (*filters, model.bias, model.out)]
    slow = np.full((BUCKETS,), 1e-2, np.float32)
    bad = sum(labels[i] for i in teach)
    heavy = min(4.0, (len(teach) - bad) / bad)
    for _ in range(EPOCHS):
        order = rng.permutation(len(teach))
        for k in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in (*filters, model.bias, model.out)]
            prior_grad = 0.0
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            for d in order[k : k + BATCH].tolist():
                ids, ends = flat[d]
                label = labels[teach[d]]
                if not len(words[d]):
                    continue
                total = np.concatenate([np.zeros((1, DIM), np.float32), np.cumsum(embedding[ids], 0, dtype=np.float64).astype(np.float32)])
                x = total[ends[1:]] - total[ends[:-1]]
                pooled, where = np.zeros(size, np.float32), np.full(size, -1)
                for i, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                    n = len(x) - w + 1
                    if n > 0:
                        s = sum(x[j : j + n] @ f[j] for j in range(w))
                        where[i * FILTERS : (i + 1) * FILTERS] = best = s.argmax(0)
                        pooled[i * FILTERS : (i + 1) * FILTERS] = s[best, np.arange(FILTERS)]
                hidden = np.maximum(pooled + model.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.prior, -30, 30)))
                g = (p - y[teach[d]]) * (heavy if label else 1.0) / BATCH
                grads[-1] += g * hidden
                prior_grad += g
                back = g * model.out * (hidden > 0)
                grads[-2] += back
                for q in np.flatnonzero((where >= 0) & (back != 0)).tolist():
                    i, c = divmod(q, FILTERS)
                    for j in range(WIDTHS[i]):
                        at = where[q] + j
                        grads[i][j, :, c] += back[q] * x[at]
                        touched.append((ids[ends[at] : ends[at + 1]], back[q] * filters[i][j, :, c]))
            for param, g, v in zip((*filters, model.bias, model.out), grads, speed, strict=True):
                v += g * g
                param -= RATE * (g / np.sqrt(v) + 1e-4 * param)
            model.prior -= RATE * prior_grad
            for ids, g in touched:
                slow[ids] += float(g @ g)
                embedding[ids] -= EMBEDDING_RATE * g / np.sqrt(slow[ids])[:, None]
    _calibrate(model, texts, y, folds)
    return model


def _best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, midway between the scores beside it."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    n = np.arange(1, len(s) + 1)
    f1 = 2 * hits / (n + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def _calibrate(model: Model, texts: list[str], y: np.ndarray, folds: list[int]) -> None:
    scorer = Scorer(model)
    use = [i for i in range(len(texts)) if folds[i] == 1] or list(range(len(texts)))
    logit, truth = scorer.logits([texts[i] for i in use]), y[use]
    if not 0 < truth.sum() < len(truth):
        return
    cut = _best_cut(logit, truth)
    spread = max(0.1, float(logit[logit >= cut].mean() - cut))
    model.scale = (2 / spread, -2 * cut / spread)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """docs: doc_id, text, lang. labels: doc_id, toxic."""
    taught = _taught(labels)
    picked = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    joined = docs.join(F.broadcast(picked), "doc_id")  # at most max_train rows of three numbers
    rows = joined.filter(F.length("text") <= MAX_CHARS).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_train).collect()
    return fit([r.text for r in rows], [r.toxic for r in rows], [int(r.fold == 4) for r in rows])


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def _taught(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", _fold()).filter("fold <> 0")


def _scores(docs: DataFrame, model: Model, carried: dict[str, str]) -> DataFrame:
    """The carried columns of docs, and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        scorer = Scorer(model)
        for b in batches:
            yield pa.record_batch([*map(b.column, carried), pa.array(scorer.scores(b.column("text").to_pylist()), pa.float64())], [*carried, "score"])

    return docs.select(*carried, "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in carried.items()) + ", score double")


def language_thresholds(docs: DataFrame, labels: DataFrame, model: Model) -> dict[str, float]:
    """Language → the score from which its calibration fold is classified best (F1), over all labelled documents of that fold. BINS rows a language with
    LEAST_LABELS labels come to the driver."""
    scored = _scores(docs.filter((_fold() == 4) & F.col("lang").isNotNull()), model, {"doc_id": "long", "lang": "string"})
    binned = scored.groupBy("doc_id", "lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    bins = stage(binned.join(_taught(labels).filter("fold = 4"), "doc_id").groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("bad")), "bins")
    enough = bins.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("bad").alias("all_bad")).filter(f"all >= {LEAST_LABELS} and all_bad > 0 and all_bad < all")
    table: dict[str, list[tuple[int, int, int]]] = {}
    for r in bins.join(enough.select("lang"), "lang").orderBy("lang", "bin").collect():
        table.setdefault(r.lang, []).append((r.bin, r.n, r.bad))
    forget(bins)
    return {lang: best_bin(rows) / BINS for lang, rows in table.items()}


def best_bin(rows: list[tuple[int, int, int]]) -> int:
    """rows: bin, documents, bad ones. The bin from which on the F1 is best; of equal ones the highest."""
    total, taken, hits, best = sum(b for _, _, b in rows), 0, 0, (-1.0, 0)
    for at, n, bad in sorted(rows, reverse=True):
        taken, hits = taken + n, hits + bad
        best = max(best, (2 * hits / (taken + total), at))
    return best[1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged: the score reaches the threshold of the row's language."""
    prepare(docs.sparkSession)
    held = F.coalesce(_fold() == 0, F.lit(False))
    rows = _scores(docs.withColumn("held_out", held), model, {"doc_id": "long", "held_out": "boolean", "lang": "string"})
    cut = F.lit(0.5)
    if model.thresholds:
        cut = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(model.thresholds.items()) for x in kv]), F.coalesce("lang", F.lit(""))), cut)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    prepare(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    model = train(docs, labels, max_train)
    model.thresholds = language_thresholds(docs, labels, model)
    return score(docs, model)
