"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Base rules reject texts of fewer than MIN_WORDS words, or with over 30 % of their words in 8-word windows that occur
twice or more. The learnt rules cut measured ratios. For each stratum (language) a sequence of rule
sets is fixed, each at least as strict as the one before, from the good documents of all other strata alone. In this order the exact binomial tail
of the stratum's good labelled documents that a whole set rejects is tested against RISK at level DELTA / strata; the first set that
isn't shown safe ends the sequence and the set before it is taken (fixed-sequence testing: the level isn't divided by the tests). So with probability 1 - DELTA the
learnt rules together reject less than RISK of the good documents in every stratum. A stratum without a safe set has none; it takes
ln(strata / DELTA) / -ln(1 - RISK) good documents to have one (217 with four strata).

A trial of the tests is a distinct text among the good documents of a stratum: an id with several rows counts once, with the row of the least text
hash, and ids with equal texts count once together, so copies can't pass for evidence.

Words are runs of what isn't white space (space, tab to carriage return). Null texts have no words. Rows without
language, or of one without a safe set, meet the base rules only. Repeated rows are judged alike, a ratio equal to its cutoff passes. Texts of any
length are measured whole. Labels of ids that aren't in the table don't count, nor do null ids; of contradicting labels of one id the larger counts.
Empty tables give no rows, empty labels no learnt rules. Extra columns are not carried along by `judge`; `keep_good` keeps all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, forget, stage, tidy

BLANK = r"[\x20\x09-\x0D]+"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
RISK, DELTA = 0.02, 0.05
#: What the learnt rules measure, and the cutoffs tried for each (rejected: over it).
RULES = ("symbol_ratio", "bang_ratio", "dup_line_ratio", "repeat_ratio")
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)
#: Shares of the other strata's good documents that a rule may reject, along the sequence of rule sets.
SHARES = (0, 0.001, 0.002, 0.005, 0.01, 0.02)


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once; a plain reference would be computed anew in every lambda call."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the array. Equal windows are neighbours once their hashes are sorted."""

    def count(pairs: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(pairs, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")), lambda a: a["total"])

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(pairs, count))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_bind(hashes, of))


def measured(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words (long) of a whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    long = lambda c: c.cast("long")
    less = lambda t, pattern: F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        words = F.filter(F.split(t, BLANK), lambda w: w != "")
        by_words = _bind(words, lambda w: F.struct(long(F.size(w)).alias("n"), repeated_words(w).alias("r")))
        by_lines = _bind(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("d")))
        return F.struct(
            by_words.alias("w"), by_lines.alias("x"),
            long(F.char_length(F.regexp_replace(t, BLANK, ""))).alias("c"), long(less(t, "[#*$%&|<>]+")).alias("s"), long(less(t, "!+")).alias("b"),
        )

    return F.transform(
        F.array(_bind(text, of)),
        lambda m: F.struct(m["w"]["n"].alias("n_words"), m["c"].alias("word_chars"), m["s"].alias("n_symbols"), m["b"].alias("n_bangs"), m["x"]["n"].alias("n_lines"), m["x"]["d"].alias("n_dup_lines"), m["w"]["r"].alias("n_repeat_words")),
    )[0]


def _ratio(m: Column, rule: str) -> Column:
    up, down = {"symbol_ratio": ("n_symbols", "word_chars"), "bang_ratio": ("n_bangs", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words")}[rule]
    return F.when(m[down] > 0, m[up] / m[down]).otherwise(0.0)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, by its largest terms; exact but for terms under 1e-18 of the sum."""
    if k >= n:
        return 1.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    if k > n * p:
        return min(1.0, 1.0 - _upper(k + 1, n, p))
    total, x, i = 1.0, 1.0, k
    while i > 0 and x > total * 1e-18:
        x *= i / (n - i + 1) * (1 - p) / p
        i -= 1
        total += x
    return min(1.0, math.exp(term) * total)


def _upper(k: int, n: int, p: float) -> float:
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, x, i = 1.0, 1.0, k
    while i < n and x > total * 1e-18:
        x *= (n - i) / (i + 1) * p / (1 - p)
        i += 1
        total += x
    return math.exp(term) * total


Counts = dict[str, tuple[int, dict[str, list[int]]]]


def sequence(counts: Counts, stratum: str) -> list[tuple[int, ...]]:
    """Rule sets in the order of their tests: for each rule an index of GRID (len(GRID): off). No count of the stratum itself enters."""
    others = [c for g, c in counts.items() if g != stratum]
    n = sum(c[0] for c in others)
    at = [tuple(next((i for i in range(len(GRID)) if sum(c[1][r][i] for c in others) <= share * n), len(GRID)) for r in RULES) for share in SHARES]
    now, sets = [len(GRID)] * len(RULES), []
    for target in at + [tuple(max(0, i - k) for i in at[-1]) for k in range(1, len(GRID))]:
        for goal in sorted(set(target)):  # the rules that harm least elsewhere first
            for step in reversed(range(goal, len(GRID))):
                now = [min(i, step) if t == goal else i for i, t in zip(now, target, strict=True)]
                sets.append(tuple(now))
    return list(dict.fromkeys(sets))


def choose(counts: Counts, risk: float = RISK, delta: float = DELTA, joint: dict[str, list[int]] | None = None) -> dict[str, dict[str, float]]:
    """counts: stratum → (good documents, rule → how many of them each cutoff rejects). joint: stratum → how many each set of its
    sequence rejects; without it the sum over the rules, which is no less. Stratum → rule → cutoff."""
    level = delta / max(1, len(counts))
    out: dict[str, dict[str, float]] = {}
    for stratum, (n, rejected) in counts.items():
        for k, chosen in enumerate(sequence(counts, stratum)):
            on = [(r, i) for r, i in zip(RULES, chosen, strict=True) if i < len(GRID)]
            lost = joint[stratum][k] if joint else min(n, sum(rejected[r][i] for r, i in on))
            if binomial_tail(lost, n, risk) > level:
                break
            out[stratum] = {r: GRID[i] for r, i in on}
    return out


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """measures: doc_id, lang, same (hash of the text), m. Two rows of counts a language come to the driver, and only of languages with labels enough for
    any test."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    least = math.log(1 / delta) / -math.log1p(-risk)
    # a row an id, then a row a text: partial minima, so an id or a text that fills the table meets in no task
    known = measures.filter("lang is not null and doc_id is not null").select("doc_id", F.struct("same", "lang", *[_ratio(F.col("m"), r).alias(r) for r in RULES]).alias("t"))
    trials = known.groupBy("doc_id").agg(F.min("t").alias("t")).join(good, "doc_id").select("t.*")
    ratios = stage(trials.groupBy("lang", "same").agg(*[F.max(r).alias(r) for r in RULES]).drop("same"), "good-ratios")
    lost = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    sums = [lost(F.col(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)]
    rows = ratios.groupBy("lang").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= least).collect()
    counts = {r["lang"]: (r["n"], {rule: [r[f"{rule}_{i}"] for i in range(len(GRID))] for rule in RULES}) for r in sorted(rows)}
    if not counts:
        forget(ratios)
        return {}
    # A set's cutoffs as an array of four a language and step; beyond any ratio where the rule is off.
    steps = [(g, k, [GRID[i] if i < len(GRID) else float("inf") for i in x]) for g in counts for k, x in enumerate(sequence(counts, g))]
    sets = F.broadcast(ratios.sparkSession.createDataFrame(steps, "lang string, step int, cut array<double>"))
    over = [F.col(r) > F.col("cut")[i] for i, r in enumerate(RULES)]
    joint: dict[str, list[int]] = {}
    for r in ratios.join(sets, "lang").groupBy("lang", "step").agg(lost(over[0] | over[1] | over[2] | over[3]).alias("k")).orderBy("lang", "step").collect():
        joint.setdefault(r["lang"], []).append(r["k"])
    forget(ratios)
    return choose(counts, risk, delta, joint)


def kept(m: Column, lang: Column, cut: dict[str, dict[str, float]]) -> Column:
    """The verdict: base rules, and the learnt ones of the row's language."""
    failed = base_failed(m)
    for rule in RULES:
        known = {g: c[rule] for g, c in cut.items() if rule in c}
        if known:
            at = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), F.coalesce(lang.cast("string"), F.lit("")))
            failed = failed | F.coalesce(_ratio(m, rule) > at, F.lit(False))
    return ~failed


def _facts(docs: DataFrame) -> list[Column]:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64("text").alias("same"), measured(F.col("text")).alias("m")]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, same (hash of the text), m (what `measured` gives) of every row."""
    return docs.select(*_facts(docs))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of m, base_failed and kept for every row."""
    measures = stage(measure(docs), "measures")
    cut = cutoffs(measures, labels)
    return measures.select("doc_id", "m.*", base_failed(F.col("m")).alias("base_failed"), kept(F.col("m"), F.col("lang"), cut).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Texts are measured once: numbers are written, cutoffs and verdicts come from them, and
    the rejected rows are left out by key (the row's id and a hash of id, text and lang, which decide its verdict)."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    k_id, k_hash = doc_key()
    key = [k_id, F.xxhash64(k_hash, lang).alias("k_hash")]
    measures = stage(docs.select(*key, *_facts(docs)), "measures")
    cut = cutoffs(measures, labels)
    tidy(docs.sparkSession)
    bad = stage(measures.filter(~kept(F.col("m"), F.col("lang"), cut)).select("k_id", "k_hash").distinct(), "rejected")
    forget(measures)
    return docs.select(F.struct(*docs.columns).alias("row"), *key).join(bad.hint("merge"), ["k_id", "k_hash"], "left_anti").select("row.*")
