"""The pipeline's stages and its rows against brute force on a small corpus, and on odd and empty tables."""

import collections
import random
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, quality, queries
from tests.llm.test_decontaminate import WORDS, around, changed, items_for, leaks
from tests.llm.test_near_copies import kept as without_near_copies
from tests.llm.test_operators import DIR, deduped, measured, odd_texts, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    items = items_for(rng, 20, (30, 45, 70))
    line = lambda n=12: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    shared = [line() for _ in range(4)]
    docs = []
    for i in range(900):
        kind = i % 9
        text = "\n".join(line() for _ in range(3))
        if kind == 1 and docs:
            text = rng.choice(docs)[1]
        elif kind == 2 and docs:
            text = changed(rng, rng.choice(docs)[1].replace("\n", " "), 0.03, "replace")
        elif kind == 3:
            text = text + "\n" + rng.choice(shared)
        elif kind == 4:
            text = around(rng, changed(rng, rng.choice(items)[1], 0.1, "replace"), 10)
        elif kind == 5:
            text = " ".join(["###"] * 8) + " " + text
        elif kind == 6 and i % 2:
            text = "too short"
        docs.append((i, text, "en" if i % 3 else "de", "s", len(text)))
    labels = [(i, int(i % 9 != 5 and not (i % 9 == 6 and i % 2)), 0) for i in range(900) if i % 7]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_and_rows(spark, folder):
    from tokenizers import Tokenizer

    docs, labels, items = corpus()
    now = spark.read.parquet(f"{folder}/documents.parquet")
    cut = quality.cutoffs(quality.measure(now), spark.read.parquet(f"{folder}/labels.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    # quality rules
    want = []
    for i, t, lang, *_ in docs:
        n, chars, symbols, dup, repeat = measured(t)
        lines = sum(bool(x.split()) for x in t.split("\n"))
        ratios = {"symbol_ratio": symbols / chars, "bang_ratio": t.count("!") / n, "dup_line_ratio": dup / lines, "repeat_ratio": repeat / n}
        if n >= 20 and 100 * repeat <= 30 * n and not any(ratios[r] > c for r, c in cut.get(lang, {}).items()):
            want.append((i, t))
    got = steps["quality_rules"](spark, now, folder)
    assert rows_of(got) == sorted(want, key=str) and cut and len(want) < 850
    # line dedup
    want = [(i, t) for i, t in deduped(want) if t.split()]
    got = steps["line_dedup"](spark, spark.createDataFrame(got.collect(), SCHEMA), folder)
    assert rows_of(got) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    # near-dedup
    stay = set(without_near_copies(want))
    want = [(i, t) for i, t in want if i in stay]
    got = steps["near_dedup"](spark, spark.createDataFrame(got.collect(), SCHEMA), folder)
    assert rows_of(got) == sorted(want, key=str)
    # decontamination: what leaks by the rule over the whole of a short text goes, and nothing else
    bad = {i for i, t in want if any(leaks(x, t) for _, x in items)}
    got = steps["decontamination"](spark, spark.createDataFrame(got.collect(), SCHEMA), folder)
    left = {r.doc_id for r in got.collect()}
    assert {i for i, _ in want} - bad <= left and len(bad & left) <= 0.1 * len(bad) and len(bad) > 20
    want = [(i, t) for i, t in want if i in left]
    assert got.columns == now.columns and rows_of(got) == sorted(want, key=str)
    # encoding, and the whole run
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in want}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in whole} == {i: (len(x), struct.pack(f"<{len(x)}I", *x), library.decode(x, skip_special_tokens=False)) for i, x in ids.items()}
    assert "pipeline" in __import__("__spark_entry__").queries()


def test_odd_and_empty_tables(spark, tmp_path):
    odd = spark.createDataFrame(odd_texts(), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("node", F.lit("clash"))
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        left = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, at).collect())
        # 1 is a repeated passage's first copy, 6 and 8 are near copies, 14 repeats one word, the others are short
        assert (set(left) <= {i for i, _ in odd_texts()} and 14 not in left and None in left) if name == "odd" else not left


def test_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"]
    out = corpus_pipeline.STAGES[0][1](spark, docs, DIR)
    assert out.columns == docs.columns and decontaminate.keep_clean(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).columns == docs.columns
