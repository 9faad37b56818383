"""Whole-word usages and BM25 ranking over the line corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import accepted
from ..functions.text import excerpt, whole_word

K1, B, TOP = 1.2, 0.75, 20


def usages(lines: DataFrame, manifest: DataFrame, symbol: str, scope: str | None = None, globs: list[str] | None = None) -> DataFrame:
    """path, line, text: lines that have the symbol as a whole word. Each content is searched once, paths are joined to the hits."""
    hits = lines.filter(whole_word(F.col("text"), symbol)).select("sha", "line", excerpt(F.col("text")).alias("text"))
    return hits.join(manifest.filter(accepted(F.col("path"), scope, globs)), "sha").select("path", "line", "text").distinct()


def rank(lines: DataFrame, manifest: DataFrame, terms: list[str], scope: str | None = None, globs: list[str] | None = None, top: int | None = TOP) -> DataFrame:
    """path, score, terms, lines of the files that fit best under BM25. Statistics are of distinct contents, the limit is of paths. One scan
    serves all terms."""
    terms = list(dict.fromkeys(t for t in terms if t))
    paths = manifest.filter(accepted(F.col("path"), scope, globs))
    docs = lines.join(paths.select("sha").distinct(), "sha", "left_semi")
    found = [whole_word(F.col("text"), t) for t in terms]
    any_hit = F.lit(False)
    for f in found:
        any_hit = any_hit | f
    counts = docs.groupBy("sha").agg(
        F.max("n_lines").cast("double").alias("dl"),
        *[F.count_if(f).cast("double").alias(f"tf{i}") for i, f in enumerate(found)],
        F.sort_array(F.collect_set(F.when(any_hit, F.col("line")))).alias("hits"),
    )
    stats = counts.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    scored = counts.filter(F.size("hits") > 0).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    names = F.array_compact(F.array(*[F.when(F.col(f"tf{i}") > 0, F.lit(t)) for i, t in enumerate(terms)]))
    ranked = scored.select("sha", score.alias("score"), F.array_join(names, ",").alias("terms"), F.array_join("hits", ",").alias("lines")).join(paths, "sha").select("path", "score", "terms", "lines")
    return ranked.orderBy(F.desc("score"), "path").limit(top) if top else ranked
