"""The toxicity classifier: the forward pass against a plain convolution, thresholds, accuracy, long texts."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity as T


def model_for(seed):
    rng = np.random.default_rng(seed)
    size = len(T.WIDTHS) * T.FILTERS
    filters = [rng.normal(0, 1, (w, T.DIM, T.FILTERS)).astype(np.float32) for w in T.WIDTHS]
    return T.Model(rng.normal(0, 1, (T.BUCKETS, T.DIM)).astype(np.float32), filters, rng.normal(0, 1, size).astype(np.float32), rng.normal(0, 1, size).astype(np.float32), 0.25)


def plain_logit(model, text):
    """Loops over filters and windows."""
    words = (text or "").split()
    if not words:
        return model.prior
    vectors = [sum((model.embedding[b] for b in T.buckets(w)), np.zeros(T.DIM, np.float32)) for w in words]
    hidden = []
    for width, f in zip(T.WIDTHS, model.filters, strict=True):
        for c in range(T.FILTERS):
            found = [sum(float(vectors[k + j] @ f[j, :, c]) for j in range(width)) for k in range(len(words) - width + 1)]
            hidden.append(max(found, default=0.0))
    return float(np.maximum(np.array(hidden) + model.bias, 0) @ model.out) + model.prior


def test_forward_pass(monkeypatch):
    rng = random.Random(1)
    vocab = ["a", "Bad!", "word", "longerword", "***", "schön", "x" * 70, "好"]
    texts = [None, "", "  ", "a", "a Bad!", "***"] + [" ".join(rng.choice(vocab) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    model = model_for(3)
    want = [plain_logit(model, t) for t in texts]
    assert np.allclose(T.Scorer(model).logits(texts), want, rtol=1e-3, atol=1e-3)
    # slices, groups and a memo smaller than the texts change nothing
    monkeypatch.setattr(T, "SLICE", 7)
    monkeypatch.setattr(T, "GROUP", 20)
    monkeypatch.setattr(T, "MEMO_WORDS", 25)
    small = T.Scorer(model)
    assert np.allclose(small.logits(texts), want, rtol=1e-3, atol=1e-3) and len(small.rows) <= 25


def test_texts_beyond_every_border():
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") + str(rng.randrange(4000)) for _ in range(T.GROUP + 10)]
    model = model_for(5)
    last = T.Scorer(model).logits([" ".join(words)])[0]
    parts = [" ".join(words[k : k + 1000 + max(T.WIDTHS) - 1]) for k in range(0, len(words), 1000)]
    scorer = T.Scorer(model)
    most = np.full(len(T.WIDTHS) * T.FILTERS, -np.inf, np.float32)
    for p in parts:
        scorer.learn(set(p.split()))
        scorer._pool(p.split(), most)
    assert np.isclose(last, float(np.maximum(most + model.bias, 0) @ model.out) + model.prior, rtol=1e-4)


def test_best_bin():
    rows = [(10, 50, 0), (400, 9, 4), (600, 5, 5), (900, 3, 3)]
    f1 = {cut: 2 * sum(b for a, _, b in rows if a >= cut) / (sum(n for a, n, _ in rows if a >= cut) + 12) for cut, _, _ in rows}
    assert T.best_bin(rows) == max(f1, key=f1.get)


def test_accuracy_and_thresholds(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2400):
        bad = i % 6 == 0
        words = [rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(50)) for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = rng.choice(["vilex", "vilone", "rotten"])
        rows.append((i, " ".join(words), "en" if i // 6 % 2 else "de", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic")
    docs = df.drop("toxic")
    got = T.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(2400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97 and np.mean([r.flagged == bool(r.toxic) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    model = T.train(docs, labels)
    cuts = T.language_thresholds(docs, labels, model)
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in range(2400)}
    scored = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    for lang, cut in cuts.items():
        mine = [r for r in rows if fold[r[0]] == 4 and r[2] == lang]
        f1 = lambda c, mine=mine: 2 * sum(r[3] for r in mine if scored[r[0]] >= c) / (sum(scored[r[0]] >= c for r in mine) + sum(r[3] for r in mine))
        assert f1(cut) >= max(f1(k / T.BINS) for k in range(T.BINS)) - 1e-9
    assert set(cuts) == {"en", "de"}
    # ids of the held-out fold teach nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in T.score(docs, T.train(docs, other)).collect()} == scored
