"""Learnt quality rules in small strata."""

import random

from lodestone.llm import quality


def test_small_stratum_gets_cutoffs():
    clean = {r: [0] * len(quality.GRID) for r in quality.RULES}
    cut = quality.choose({"en": (5000, clean), "de": (300, clean), "xx": (200, clean)})
    assert set(cut["de"]) == set(quality.RULES) and "xx" not in cut


def test_order_ignores_the_stratum_itself():
    clean, dirty = ({r: [k] * len(quality.GRID) for r in quality.RULES} for k in (0, 90))
    assert quality.sequence({"en": (5000, clean), "de": (300, clean)}, "de") == quality.sequence({"en": (5000, clean), "de": (300, dirty)}, "de")
    sets = quality.sequence({"en": (5000, clean), "de": (300, clean)}, "de")
    assert all(all(y <= x for x, y in zip(a, b, strict=True)) for a, b in zip(sets, sets[1:]))


def test_whole_set_keeps_the_risk(spark):
    """Each rule alone rejects under 2 % of the good documents, all together over it."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        if i % 600 < 8:
            words[0] = "!" * 30
        elif i % 600 < 16:
            words[0] = "#" * 60
        rows.append((i, " ".join(words), "en" if i < 600 else "de"))
        labels.append((i, 1))
    measures = quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    cut = quality.cutoffs(measures, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert cut["de"] and all(not ("bang_ratio" in c and c["bang_ratio"] < 0.6 and "symbol_ratio" in c and c["symbol_ratio"] < 0.18) for c in cut.values())


def labelled_rows():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        good = i % 5 != 0
        if not good:
            words[:12] = ["###"] * 12
        elif i % 90 == 1:
            words[0] = "#" * 12
        rows.append((i, " ".join(words), "en" if i % 3 else "de"))
        if i % 10:
            labels.append((i, int(good)))
    return rows, labels


def test_repeats_are_no_evidence(spark):
    """Rows twenty times over, and ids with equal texts, give the cutoffs of the rows once."""
    rows, labels = labelled_rows()
    make = lambda r: quality.measure(spark.createDataFrame(r, "doc_id long, text string, lang string"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    once = quality.cutoffs(make(rows), known)
    assert once["en"] and quality.cutoffs(make(rows * 20), known) == once
    few, copies = rows[:60], [(10_000 + i, rows[1][1], "en") for i in range(2000)]
    more = spark.createDataFrame(labels + [(c[0], 1) for c in copies], "doc_id long, quality int")
    assert quality.cutoffs(make(few + copies), more) == {}


def test_kept_by_hand(spark):
    """The verdict from the counts and the cutoffs, and the bound on the labelled good documents, both computed apart."""
    from math import comb

    rows, labels = labelled_rows()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    cut = quality.cutoffs(quality.measure(docs), known)
    got = {r.doc_id: r for r in quality.judge(docs, known).collect()}
    text = {i: (t, g) for i, t, g in rows}
    for i, (t, g) in text.items():
        words = t.split()
        ratios = {"symbol_ratio": sum(c in "#*$%&|<>" for c in t) / sum(map(len, words)), "bang_ratio": t.count("!") / len(words), "dup_line_ratio": 0.0, "repeat_ratio": got[i].n_repeat_words / len(words)}
        assert got[i].kept == (not got[i].base_failed and not any(ratios[r] > c for r, c in cut.get(g, {}).items()))
    for g, rules in cut.items():
        good = [i for i, q in labels if q and text[i][1] == g]
        lost = sum(not got[i].kept and not got[i].base_failed for i in good)
        assert rules and sum(comb(len(good), k) * quality.RISK**k * (1 - quality.RISK) ** (len(good) - k) for k in range(lost + 1)) <= quality.DELTA
    assert sum(not got[i].kept for i, q in labels if not q) > 0.9 * sum(not q for _, q in labels)
    assert sorted(r.doc_id for r in quality.keep_good(docs, known).collect()) == sorted(i for i in got if got[i].kept)
