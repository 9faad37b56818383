"""Near copies of the pipeline against brute force over whole shingle sets."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_copies, simhash


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near(sets[a], sets[b]):
                root[find(a)] = find(b)
    return sorted(min(rows[k][0] for k in range(len(rows)) if find(k) == g) for g in {find(k) for k in range(len(rows))})


def texts():
    rng = random.Random(11)
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A B"), (4, "a b c d e"), (5, "one two three four five six")]
    for family in range(12):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 200]))]
        for copy in range(9):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 6])):
                changed[rng.randrange(len(changed))] = f"z{rng.randrange(10**6)}"
            lead = common + " " if family % 3 == 0 else ""
            rows.append((100 * family + copy + 10, lead + " ".join(changed)))
    return rows


@pytest.mark.parametrize("cap", [2, 32])
def test_near_copies(spark, cap):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    got = near_copies.keep_one(df, list_cap=cap)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_stage_leaves_no_near_copies(spark):
    import corpus_pipeline

    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [sets_of(r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert not any(near(a, b) for i, a in enumerate(left) for b in left[:i])


def test_links_come_through_the_index(spark, monkeypatch):
    """Fingerprints of all texts, on five words, go through op10's index; what it links is verified by whole sets, and what it can't link is found all the same."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    again = " ".join(word() for _ in range(7))
    rows = [(k, " ".join([again] * 40 + [word() for _ in range(12)])) for k in range(3)]  # one fingerprint, different sets
    words = [word() for _ in range(400)]
    for k in range(4):  # one word of 400: near copies within few bits
        rows.append((10 + k, " ".join([*words[:-1], word()] if k else words)))
    words = [word() for _ in range(100)]
    rows += [(20, " ".join(words)), (21, " ".join(words[:97] + [word(), word(), word()] + words[97:]))]
    asked, links, looked, passed, verify = [], simhash.links, [], [], near_copies._verified

    def counted(nodes, *rest):
        asked.extend(r.fp for r in nodes.collect())
        return links(nodes, *rest)

    def seen(texts, pairs, words):
        pairs = pairs.localCheckpoint()
        looked.append({(r.a, r.b) for r in pairs.collect()})
        out = verify(texts, pairs, words)
        passed.append({(r.a, r.b) for r in out.collect()})
        return out

    monkeypatch.setattr(simhash, "links", counted)
    monkeypatch.setattr(near_copies, "_verified", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == kept(rows) == [0, 1, 2, 10, 20]
    fps = {k: simhash.fingerprint(t, 5) for k, t in rows}
    assert {f % 2**64 for f in asked} == set(fps.values())
    bits = lambda a, b: (fps[a] ^ fps[b]).bit_count()
    assert bits(0, 1) <= 2 and bits(20, 21) > 2 and any(bits(10, k) <= 2 for k in (11, 12, 13))
    assert passed[0] and looked[0] - passed[0] and not any(passed[0] & p for p in looked[1:])
