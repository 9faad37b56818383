"""Benchmark decontamination against exact comparisons, and its recall under changes of the text."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as D

WORDS = [a + b + c for a in ("ba", "ko", "tri", "su", "mel", "fan") for b in ("na", "ri", "do", "ke") for c in ("s", "t", "lo", "mi", "x", "pe", "qu")]


def items_for(rng, n, sizes=(12, 18, 24, 30, 45, 70)):
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(sizes[i % len(sizes)])]
        cut = len(words) * 2 // 3
        out.append((i, " ".join(words[:cut]) + "? " + " ".join(words[cut:]) + "."))
    return out


def changed(rng, text, share, how):
    words = text.split()
    n = int(len(words) * share)
    for k in sorted(rng.sample(range(len(words)), n), reverse=True):
        if how == "replace":
            words[k] = rng.choice(WORDS)
        elif how == "delete":
            del words[k]
        elif how == "insert":
            words.insert(k, rng.choice(WORDS))
        elif k:
            words[k - 1], words[k] = words[k], words[k - 1]
    return " ".join(words)


def around(rng, text, n=40):
    pick = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    return f"{pick(rng.randrange(n))} {text} {pick(rng.randrange(n))}"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def leaks(item, doc):
    """The rule of the docstring over a whole short text."""
    a, b = D.words_of(item), D.words_of(doc)
    share = plain_lcs(a, b) / len(a)
    answer = D.answer_of(item)
    return share >= D.LCS_SURE or share >= D.LCS_LEAST and plain_lcs(answer, b) >= D.ANSWER_SHARE * len(answer)


def test_against_all_pairs(spark):
    """Short texts: nothing is found that a comparison of all pairs doesn't find, and at least 0.9 of what it finds, for each kind of change."""
    rng = random.Random(1)
    items = items_for(rng, 60)
    docs, kind = [], {}
    for how in ("replace", "delete", "insert", "swap"):
        for share in (0.0, 0.1, 0.2, 0.3):
            for i, text in rng.sample(items, 12):
                kind[len(docs)] = (how, share, i)
                docs.append((len(docs), around(rng, changed(rng, text, share, how), 12)))
    clean = range(len(docs), len(docs) + 60)
    docs += [(k, " ".join(rng.choice(WORDS) for _ in range(60))) for k in clean]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, i) for r in D.decontaminate(df, bench).collect() for i in r.item_ids}
    want = {(d, i) for d, text in docs for i, item in items if leaks(item, text)}
    assert got <= want
    for how in ("replace", "delete", "insert", "swap"):
        mine = {(d, i) for d, i in want if d in kind and kind[d][0] == how}
        assert len(mine & got) >= 0.9 * len(mine), how
    assert len(got) >= 0.9 * len(want) and len(want) > 100


def test_clusters_lose_nothing():
    rng = np.random.default_rng(3)
    space, _ = np.linalg.qr(rng.normal(size=(D.BUCKETS, 16)))
    idf = rng.uniform(1, 3, D.BUCKETS)
    r = random.Random(4)
    items = items_for(r, 300)
    index = D.Index.of(space.astype(np.float32), idf, items)
    searcher = D.Searcher(index)
    text = " ".join(t for _, t in items[:40])
    ids = D.bucket(D.hashed(text)[0])
    table, norms = index.table, index.norms
    want = set()
    goal = index.latent / index.own[:, None]
    for i, words in enumerate(index.words):
        width = (D.SHORT_STEPS if len(words) <= D.SHORT else D.STEPS) * D.STEP
        for at in range(0, max(1, -(-len(ids) // D.STEP) - width // D.STEP + 1)):
            part = ids[at * D.STEP : at * D.STEP + width]
            score, least = float(table[part].sum(0) @ goal[i]), D.CANDIDATE * float(np.sqrt(norms[part].sum()))
            if score >= least * 1.001:
                want.add((i, at * D.STEP, width))
    got = set(searcher.candidates(ids))
    assert want <= got and len(got) <= 1.02 * len(want) + 5 and len(want) > 100
    members = np.concatenate(D.clusters(goal.astype(np.float32)))
    assert sorted(members.tolist()) == list(range(300))


def test_blocks_of_items_change_nothing(spark):
    rng = random.Random(5)
    items = items_for(rng, 2001) + [(None, "nameless " * 30), (9000, None), (9001, "")]
    docs = [(d, around(rng, changed(rng, text, 0.1, "replace"))) for d, (_, text) in enumerate(rng.sample(items[:2001], 150))] + [(500, None), (501, ""), (None, items[3][1]), (502, items[5][1]), (502, items[5][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, D.decontaminate(df, bench).collect()))
    assert one == sorted(map(str, D.decontaminate(df, bench, item_block=600).collect())) and len(one) == len(docs)
    assert sum("contaminated=True" in r for r in one) >= 0.9 * 150
    kept = D.keep_clean(df, bench).collect()
    assert len(kept) == sum("contaminated=False" in r for r in one)


def test_long_text_over_slices(spark):
    rng = random.Random(6)
    items = items_for(rng, 12)
    words = [rng.choice(WORDS) for _ in range(D.SLICE + 500)]
    words[D.SLICE - 20 : D.SLICE - 20] = items[4][1].split()
    words[D.SLICE + 300 : D.SLICE + 300] = items[5][1].split()
    df, bench = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {4, 5} <= set(D.decontaminate(df, bench).first().item_ids)


def test_space_is_fitted_on_all_passages(spark, monkeypatch):
    """More documents and items than the samples had, and one document of many passages: every passage of both enters the fit."""
    rng = random.Random(7)
    items = items_for(rng, 1100, (12, 45))
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(d, pick(60)) for d in range(500)] + [(500, pick(40 * 150))]
    seen, fit = [], D.latent_space

    def counted(passages, *rest):
        n = F.lit(1) if "text" in passages.columns else F.octet_length("cells") / (2 * D.PASSAGE)
        seen.append(passages.agg(F.sum(n)).first()[0])
        return fit(passages, *rest)

    monkeypatch.setattr(D, "latent_space", counted)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    D.decontaminate(df, bench)
    assert seen == [sum(-(-len(t.split()) // D.PASSAGE) for _, t in docs + items)]


def test_space_against_dense_svd(spark):
    rng = random.Random(8)
    docs = [(d, " ".join(rng.choice(WORDS[d % 7 :: 7] if k % 3 else WORDS) for k in range(100))) for d in range(300)]
    passages = D.cells(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    n, df = D.document_frequencies(passages)
    idf = np.log((n + 1) / (df + 1))
    x = np.zeros((n, D.BUCKETS))
    at = 0
    for _, text in docs:
        ids = D.bucket(D.hashed(text)[0])
        for k in range(0, len(ids), D.PASSAGE):
            np.add.at(x[at], ids[k : k + D.PASSAGE], idf[ids[k : k + D.PASSAGE]])
            at += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = D.latent_space(passages.withColumn("weight", F.lit(1.0)), idf, 16)
    best = (np.linalg.svd(x, compute_uv=False)[:16] ** 2).sum()
    assert at == n == 900 and np.allclose(space.T @ space, np.eye(16), atol=1e-4)
    assert (np.asarray(x @ space) ** 2).sum() >= 0.95 * best


def test_sums_against_dense_matrices():
    """One pass over passages with words that are rare, frequent, and repeated within a passage; and the sketch by its own signs."""
    rng = np.random.default_rng(9)
    cell = np.sort(np.where(rng.random((300, D.PASSAGE)) < 0.4, rng.integers(0, 6, (300, D.PASSAGE)), rng.integers(6, D.BUCKETS, (300, D.PASSAGE))), axis=1).astype(np.uint16)
    cell[7], cell[8, 20:] = 11, D.BUCKETS
    idf = np.concatenate([rng.uniform(1, 3, D.BUCKETS), [0.0]])
    x = np.zeros((300, D.BUCKETS + 1))
    for k, row in enumerate(cell):
        np.add.at(x[k], row, 1.0)
    x[:, D.BUCKETS] = 0
    x /= np.linalg.norm(x * idf, axis=1, keepdims=True)
    basis = np.concatenate([rng.normal(size=(D.BUCKETS, 24)), np.zeros((1, 24))]).astype(np.float32)
    got = np.zeros((D.BUCKETS + 1, 24), np.float32)
    D.summed(cell, idf, basis, 24, 2.0, got)
    assert np.allclose(got[:-1], (4 * x.T @ (x @ basis))[:-1], rtol=1e-3, atol=1e-3)
    column, sign = D._signs(cell, 24)
    signs = np.zeros((300, 24))
    signs[np.arange(300)[:, None], column] = sign
    assert (np.abs(signs).sum(1) == D.SPREAD).all() and set(np.unique(sign)) == {-1.0, 1.0} and len(np.unique(column)) == 24
    sketch = np.zeros((D.BUCKETS + 1, 24), np.float32)
    D.summed(cell, idf, None, 24, 2.0, sketch)
    assert np.allclose(sketch[:-1], (2 * x.T @ signs)[:-1], rtol=1e-3, atol=1e-3)


def test_texts_together_are_as_texts_alone(monkeypatch):
    """Windows don't cross from one text into the next, and subsequences are computed only where enough words are shared."""
    rng = random.Random(10)
    items = items_for(rng, 80)
    space, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(D.BUCKETS, 64)))
    searcher = D.Searcher(D.Index.of(space.astype(np.float32), np.random.default_rng(4).uniform(1, 3, D.BUCKETS), items))
    texts = [None, "", "a", "?? !"] + [changed(rng, t, 0.1, "replace") for _, t in items] + [around(rng, t) for _, t in items[:20]]
    texts += [half for _, t in items[:20] for half in (" ".join(t.split()[: len(t.split()) // 2]), " ".join(t.split()[len(t.split()) // 2 :]))]
    asked, lcs = [], D.lcs
    monkeypatch.setattr(D, "lcs", lambda pattern, size, words: asked.append((lcs(pattern, size, words), size, len(words))) or lcs(pattern, size, words))
    together = searcher.leaks(texts)
    assert all(n >= D.LCS_LEAST * size for _, size, n in asked)
    assert together == [searcher.leaks([t])[0] for t in texts]
    assert sum(map(bool, together)) >= 95 and not any(together[-40:][k].get(k // 2) for k in range(40) if len(items[k // 2][1].split()) > 20)
