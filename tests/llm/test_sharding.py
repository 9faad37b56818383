"""Sharding against a plain k-d tree, and under other partitionings."""

import collections
import math
import random
import zlib

from pyspark.sql import functions as F

from lodestone.llm import sharding

SCALE = (1 << 24) - 1


def rows_for(seed, n, texts):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 120))) for _ in range(texts)]
    return [(i, rng.choice(pool), rng.choice(["s1", "s2", "s3", None]), rng.choice(["en", "de"])) for i in rng.sample(range(10**6), n)]


def plain(rows, shards):
    """Recursive splits of groups of equal texts at the weighted median of the widest dimension. Text → shard."""
    first = {}
    for i, t, source, lang in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t, (i, source, lang))
    ids, most = [r[0] for r in rows], max(len(r[1].encode()) + 1 for r in rows)
    crc = lambda x: zlib.crc32(x.encode()) / 2**32 if x is not None else 0.0
    weight = collections.Counter()
    for _, t, _, _ in rows:
        weight[t] += len(t.encode()) + 1
    at = {}
    for t, (i, source, lang) in first.items():
        at[t] = [int(x * SCALE) for x in (math.log2(len(t.encode()) + 1) / math.log2(most + 1), crc(source), crc(lang), (i - min(ids)) / (max(ids) - min(ids)))]
    out = {}

    def split(node, shards, base):
        if shards == 1 or not node:
            out.update(dict.fromkeys(node, base))
            return
        total = sum(weight[t] for t in node)
        variance = [sum(weight[t] * at[t][d] ** 2 for t in node) * total - sum(weight[t] * at[t][d] for t in node) ** 2 for d in range(4)]
        d = variance.index(max(variance))
        node = sorted(node, key=lambda t: (at[t][d], zlib.crc32(t.encode())))
        goal, before, k = total * (shards // 2) / shards, 0, 0
        while before + weight[node[k]] < goal:
            before += weight[node[k]]
            k += 1
        k += goal - before >= weight[node[k]] / 2
        split(node[:k], shards // 2, base)
        split(node[k:], shards - shards // 2, base + shards // 2)

    split(list(first), shards, 0)
    return out


def test_equals_a_plain_tree(spark):
    for seed, shards in ((1, 8), (2, 5)):
        rows = rows_for(seed, 400, 150)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
        want = plain(rows, shards)
        got = sharding.assign(df, shards, group_whole=1.0).collect()
        assert {r.doc_id: r.shard for r in got} == {i: want[t] for i, t, _, _ in rows}


def test_partitioning_changes_nothing(spark):
    rows = rows_for(3, 500, 60) * 2 + [(7, "the same row", "s1", "en")] * 700 + [(None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = [sorted(map(tuple, sharding.assign(d, 8).collect()), key=str) for d in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("doc_id")))]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    slots = collections.defaultdict(list)
    for r in sharding.assign(df, 8).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_light_groups_stay_together(spark):
    rows = [(i, f"text {i // 2} " + "y" * (i // 2 % 50), "s", "en") for i in range(3000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 8).collect()
    shards = collections.defaultdict(set)
    for r in got:
        shards[r.doc_id // 2].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
