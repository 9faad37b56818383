"""Near copies by the similarity of their word shingles, exactly: links of the byte-position index of fingerprints, verified, and a prefix-filtered set join of what these leave apart.

A text is the set of its shingles of SHINGLE_WORDS words (words as for the fingerprints of simhash, A-Z lower-cased; a shorter text is one
shingle). Two texts are near copies if their sets have a Jaccard similarity of at least SIMILAR.

Index: fingerprints of the same shingles go through the inverted index of simhash. Sets with one fingerprint, or with fingerprints that it links, are verified by their
whole sets, since a text that repeats a passage often has the fingerprint of others that do. Which sets are near copies within its two bits it finds without lists of
shingles; a similarity of 0.8 differs in more bits as a rule, so pairs of sets in different groups are looked for by shingles, and only these.

Candidates: under any one order of all shingles, two such sets share one among the first n - ceil(0.8 n) + 1 of each. Shingles are ordered by
hash, those in over LIST_CAP sets' prefixes last, so that common passages make no long lists unless they are most of a text; which these are stays a
distributed table. For a set that has some, more of the start of its order is looked at, all of it only where that isn't enough. Sets that share a shingle of their
prefixes, at places and with sizes that leave room for enough others after it, are verified by their whole sets. Lists
that are long all the same are linked to one of their sets first; then only sets outside a list's largest component are paired. No candidate is left out.
Texts move packed: of the sets that the index links, of those with common shingles, and of the others that lists hold.

Null texts count as empty, and texts without words are copies of each other. Sets are compared by 64-bit hashes of their shingles. Repeated rows are one
set; texts of any length are taken whole. A similarity of exactly 0.8 counts. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import doc_key, forget, join_hot, pack, prepare, slot, stage, tidy, unpack

SHINGLE_WORDS = 5
#: Least Jaccard similarity as a fraction; whole numbers keep the comparison exact.
SIMILAR = (4, 5)
#: A shingle in the prefixes of more sets goes last in the order; a longer list is linked by stars before pairs.
LIST_CAP = 32


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(simhash.hashes(text, words).view(np.int64))


def prefix_length(n: int) -> int:
    up, down = SIMILAR
    return n - -(-n * up // down) + 1 if n else 0


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _prefixes(docs: DataFrame, words: int) -> DataFrame:
    """k_id, k_hash, fp (fingerprint of the text), node (hash of the set), n (its size), part: its prefix in the order of hashes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            fps, nodes, sizes, parts = [], [], [], []
            for t in b.column("text").to_pylist():
                h = simhash.hashes(t, words)
                s = np.unique(h.view(np.int64))
                fps.append(simhash.majority(h))
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED))
                sizes.append(len(s))
                parts.append(s[: prefix_length(len(s))].copy())
            keys = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)]
            yield pa.record_batch([b.column("k_id"), b.column("k_hash"), *keys, pa.array(sizes, pa.int64()), _arrays(parts)], ["k_id", "k_hash", "fp", "node", "n", "part"])

    rows = docs.select(*doc_key(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "k_id long, k_hash long, fp long, node long, n long, part array<long>")


def _texts(docs: DataFrame, firsts: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """node, packed: a text of each of the nodes; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            yield pa.record_batch([b.column("k_id"), b.column("k_hash"), pa.array([pack(t) for t in b.column("text").to_pylist()], pa.binary())], ["k_id", "k_hash", "packed"])

    packed = docs.select(*doc_key(), F.col("text").cast("string").alias("text")).mapInArrow(run, "k_id long, k_hash long, packed binary")
    # the same plan at every size: whatever the number of nodes, texts and keys are dealt out by key
    return stage(packed.join(firsts.join(nodes, "node", "left_semi").hint("merge"), ["k_id", "k_hash"]).select("node", "packed"), label)


def _sets(texts: DataFrame, words: int, reach: int | None = None) -> DataFrame:
    """node, n, part of packed texts: the whole set, or the first `reach` prefixes of it in the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            found = [shingles(unpack(t), words) for t in b.column("packed").to_pylist()]
            parts = _arrays([s if reach is None else s[: reach * prefix_length(len(s)) + reach] for s in found])
            yield pa.record_batch([b.column("node"), pa.array([len(s) for s in found], pa.int64()), parts], ["node", "n", "part"])

    return texts.mapInArrow(run, "node long, n long, part array<long>")


def _possible() -> Column:
    """Of two postings x, y of groups not linked so far: may the shingle be the first that a similar pair shares? The sets share no more than it and what comes after it."""
    up, down = SIMILAR
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1
    sizes = down * F.least("nx", "ny") >= up * F.greatest("nx", "ny")
    return (F.col("label_x") != F.col("label_y")) & sizes & ((up + down) * rest >= up * (F.col("nx") + F.col("ny")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of columns x, y."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _verified(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs whose whole sets are similar enough. texts: node, packed."""
    pairs = stage(pairs, "candidates")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stage(_sets(texts.join(nodes, "node", "left_semi"), words).select("node", "part").dropDuplicates(["node"]), "sets")
    a, b = sets.select(F.col("node").alias("a"), F.col("part").alias("pa")), sets.select(F.col("node").alias("b"), F.col("part").alias("pb"))
    up, down = SIMILAR
    common = F.size(F.array_intersect("pa", "pb"))
    out = stage(pairs.join(a, "a").join(b, "b").filter((up + down) * common >= up * (F.size("pa") + F.size("pb"))).select("a", "b"), "verified")
    forget(pairs, sets)
    return out


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _labels(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label of every set; staged."""
    found = simhash.components(edges)
    out = stage(firsts.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labelled")
    forget(found)
    return out


def indexed(nodes: DataFrame, max_bits: int = simhash.MAX_BITS) -> DataFrame:
    """nodes: node, fp, n. Pairs (a, b) to verify that come from the byte-position index: sets of one fingerprint with the least of them, and the least ones of fingerprints that
    simhash links."""
    up, down = SIMILAR
    fps = stage(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("copies")), "set-fingerprints")
    same = join_hot(nodes.select("node", "fp", "n"), fps, ["fp"], "copies", nodes.count()).select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("hub.node").alias("y"), F.col("hub.n").alias("ny"))
    a, b = (fps.select(F.col("fp").alias(f), F.col("hub.node").alias(c), F.col("hub.n").alias(f"n{c}")) for f, c in (("a", "x"), ("b", "y")))
    met = simhash.links(fps.select("fp"), max_bits).join(a, "a").join(b, "b").select("x", "nx", "y", "ny")
    fit = (F.col("x") != F.col("y")) & (down * F.least("nx", "ny") >= up * F.greatest("nx", "ny"))
    out = stage(_ordered(same.union(met).filter(fit)), "indexed")
    forget(fps)
    return out


def _late_last(sets: DataFrame, common: DataFrame) -> DataFrame:
    """sets: node, n, part. node, n, length (of the prefix), part: shingles that aren't common, in order, then those that are."""
    up, down = SIMILAR
    length = F.expr(f"cast(n - (n * {up} + {down - 1}) div {down} + 1 as int)")
    flagged = sets.select("node", "n", F.explode("part").alias("key")).join(common.withColumn("late", F.lit(1)), "key", "left")
    grouped = flagged.groupBy("node").agg(F.first("n").alias("n"), F.collect_set(F.when(F.col("late").isNull(), F.col("key"))).alias("early"), F.collect_set(F.when(F.col("late") == 1, F.col("key"))).alias("late"))
    return grouped.select("node", "n", length.alias("length"), F.sort_array("early").alias("early"), F.sort_array("late").alias("late"))


def _postings(docs: DataFrame, nodes: DataFrame, firsts: DataFrame, words: int, list_cap: int) -> tuple[DataFrame, DataFrame]:
    """(node, label, n, place, key: the prefixes of all sets, shingles of over list_cap sets' prefixes (late ones) last in the order; place: twice the place from 0, and one more
    for late ones; node, packed: texts of the sets that have such shingles); staged. nodes: node, label, n, part."""
    opened = lambda t: t.select("node", "label", "n", F.posexplode("part").alias("at", "key")).select("node", "label", "n", (F.col("at") * 2).alias("place"), "key")
    plain = opened(nodes)
    common = stage(plain.groupBy("key").count().filter(F.col("count") > list_cap).select("key"), "common-shingles")
    moved = stage(plain.join(common, "key", "left_semi").select("node", "label").distinct(), "moved")
    texts = _texts(docs, firsts, moved.select("node"), "moved-texts")
    tidy(docs.sparkSession)
    start = stage(_late_last(_sets(texts, words, 2), common), "starts")
    enough = start.filter(F.size("early") >= F.col("length")).select("node", "n", F.slice("early", F.lit(1), F.col("length")).alias("part"), F.col("length").alias("n_early"))
    short = _sets(texts.join(start.filter(F.size("early") < F.col("length")).select("node"), "node", "left_semi"), words)
    whole = _late_last(short, common).select("node", "n", F.slice(F.concat("early", "late"), F.lit(1), F.col("length")).alias("part"), F.size("early").alias("n_early"))
    again = enough.union(whole).join(moved.hint("merge"), "node").select("node", "label", "n", "n_early", F.posexplode("part").alias("at", "key")).select("node", "label", "n", (F.col("at") * 2 + (F.col("at") >= F.col("n_early")).cast("int")).alias("place"), "key")
    out = stage(opened(nodes.join(moved, "node", "left_anti")).union(again), "prefix-postings")
    forget(common, moved, start)
    return out, texts


def groups(docs: DataFrame, words: int = SHINGLE_WORDS, list_cap: int = LIST_CAP) -> DataFrame:
    """node, label, k_id, k_hash (first row) of each distinct set; staged. All else that is written on the way is deleted."""
    spark = docs.sparkSession
    rows = stage(_prefixes(docs, words), "shingle-prefixes")
    sets = stage(rows.groupBy("node").agg(F.min(F.struct("k_id", "k_hash", "fp")).alias("f"), F.first("n").alias("n"), F.first("part").alias("part")).select("node", "n", "f.*", "part"), "shingle-sets")
    forget(rows)
    firsts = stage(sets.select("node", "k_id", "k_hash"), "firsts")
    # first the index of fingerprints, its links verified
    met = indexed(sets)
    met_texts = _texts(docs, firsts, met.select(F.col("a").alias("node")).union(met.select("b")).distinct(), "indexed-texts")
    parts = [_verified(met_texts, met, words)]
    forget(met, met_texts)
    linked = _labels(firsts, parts[0])
    nodes = stage(sets.join(linked.hint("merge"), "node").select("node", "label", "n", "part"), "labelled-sets")
    forget(sets, linked)
    tidy(spark)
    # what the index can't promise to find: pairs of sets that it left in different groups
    postings, moved = _postings(docs, nodes, firsts, words, list_cap)
    forget(nodes)
    tidy(spark)
    sizes = postings.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "m")
    shared = stage(postings.join(sizes, "key"), "shared-shingles")
    forget(postings)
    others = _texts(docs, firsts, shared.select("node").distinct().join(moved.select("node"), "node", "left_anti"), "other-texts")
    tidy(spark)
    texts = moved.union(others)
    named = lambda t, c: t.select("key", F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("n").alias(f"n{c}"), (F.shiftright("place", 1) + 1).alias(f"p{c}"), (F.col("place") % 2).alias("late"))
    short, long = shared.filter(F.col("m") <= list_cap), shared.filter(F.col("m") > list_cap)
    x, y = named(short, "x"), named(short, "y")
    parts.append(_verified(texts, _ordered(x.join(y.drop("late"), (x["key"] == y["key"]) & (F.col("x") < F.col("y")) & _possible())), words))
    if not long.isEmpty():
        # to the set of a list that has most after the shingle: what is mostly common shingles is similar to it
        hubs = named(long, "y").groupBy("key").agg(F.min(F.struct((F.col("py") / F.col("ny")).alias("share"), "y", "label_y", "ny", "py")).alias("hub")).select("key", "hub.*")
        parts.append(_verified(texts, _ordered(named(long, "x").join(hubs, "key").filter(_possible())), words))
        so_far = _labels(firsts, _united(parts))
        # the first long list of a set in the order: two sets with the same one are paired there alone, all others that they share say nothing more
        lead = named(long, "x").groupBy("x").agg(F.min(F.struct("late", "key")).alias("lead"))
        in_lists = stage(named(long, "x").drop("label_x").join(so_far.select(F.col("node").alias("x"), F.col("label").alias("label_x")), "x").join(lead, "x").withColumn("lead", F.col("lead.key")), "long-lists")
        shares = in_lists.groupBy("key", "label_x").count().groupBy("key").agg(F.max(F.struct("count", "label_x")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1").select("key", F.col("most.label_x").alias("main"))
        mixed = in_lists.join(shares, "key")
        other = mixed.filter("label_x <> main").select(F.col("key").alias("key_y"), F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("px").alias("py"), F.col("label_x").alias("label_y"), F.col("lead").alias("lead_y"))
        once = (F.col("lead") != F.col("lead_y")) | (F.col("lead") == F.col("key"))
        pairs = mixed.join(other, (F.col("key") == F.col("key_y")) & once & _possible())
        parts.append(_verified(texts, _ordered(pairs), words))
        forget(so_far, in_lists)
    labels = _labels(firsts, _united(parts))
    out = stage(firsts.join(labels, "node"), "near-groups")
    forget(shared, firsts, labels, moved, others, *parts)
    tidy(docs.sparkSession)
    return out


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, list_cap: int = LIST_CAP) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their component of near copies by id (null ids before others) and a
    hash of the row; of rows that repeat id and text one."""
    found = groups(docs, words, list_cap)
    first = stage(found.groupBy("label").agg(F.min(F.struct("k_id", "k_hash")).alias("first")).select("first.*"), "kept-rows")
    forget(found)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *doc_key()).join(first, ["k_id", "k_hash"], "left_semi")
    return rows.dropDuplicates(["k_id", "k_hash"]).select("row.*")
