"""Secret scan: base patterns, and formats inferred from labelled credentials as probabilistic automata.

Base spans (leftmost, not overlapping, by kind; code points, end exclusive) are those of three patterns with least
lengths. The values that they find anywhere in the table are labelled credentials; other tokens of a bounded sample of documents are ordinary
ones. For each label a prefix tree of at most TRAIN_VALUES values (over classes of characters, the first TRAIN_LENGTH of each) is
generalised by merging states whose endings and symbols are statistically compatible (Hoeffding bounds), recursively, which gives a
probabilistic automaton. Every token of CANDIDATE_LEAST characters or more that no base span touches is then scored, over all of its
characters: log-likelihood a character under the best credential automaton, less that under the automaton of ordinary tokens. A token over the threshold, which
no more than MISS of the reliably ordinary tokens reach (spies tell which these are), is verified by its length (none of a length that no credential of that automaton has, within LENGTH_SLACK) and
added as a span of kind `format`. Base spans always stay.

Null texts are empty. Texts and tokens are scanned whole, whatever their length. Rows that repeat are scanned alike and teach once. Of equal margins
both are over the threshold or neither is. Extra columns are not carried along. Empty tables give no rows; without labelled credentials nothing is added.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, forget, hash_sample, prepare, slot, stage

# The base patterns, their kinds in order and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "format")

#: What the automata score.
CANDIDATE_LEAST = 12
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Documents whose other tokens are the ordinary ones; values that teach an automaton, and their characters.
ORDINARY_DOCS, TRAIN_VALUES, TRAIN_LENGTH = 5000, 2000, 256
#: Confidence of the merge test, floor of a probability, share of ordinary tokens that may pass, least margin a character, share by which
#: a length may lie outside those of the labelled credentials.
ALPHA, FLOOR, MISS, MARGIN, LENGTH_SLACK = 0.01, 1e-4, 0.001, 0.5, 0.1
#: What a worker keeps of tokens that it has judged.
MEMO_BYTES = 40 << 20
_KEYS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: Characters by class: digits, letters that are hexadecimal digits, other letters; signs stand for themselves.
_CLASSES = str.maketrans({c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "g" for c in "ghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEF"} | {c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"})


def _symbols(value: str) -> str:
    """Classes of the characters."""
    return value.translate(_CLASSES)


class Automaton:
    """A probabilistic automaton by state merging. counts[s] = [arrivals, endings], edges[s] = {symbol: [target, count]}."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.counts, self.edges = [[0, 0]], [{}]
        self.lengths = (min(map(len, values), default=0), max(map(len, values), default=0))
        for v in sorted(values):
            s = 0
            self.counts[0][0] += 1
            for c in v:
                if c not in self.edges[s]:
                    self.edges[s][c] = [len(self.counts), 0]
                    self.counts.append([0, 0])
                    self.edges.append({})
                e = self.edges[s][c]
                e[1] += 1
                s = e[0]
                self.counts[s][0] += 1
            self.counts[s][1] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _near(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return not n1 or not n2 or abs(f1 / n1 - f2 / n2) < self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            (n1, f1), (n2, f2) = self.counts[a], self.counts[b]
            if not self._near(f1, n1, f2, n2):
                return False
            for c in self.edges[a].keys() | self.edges[b].keys():
                x, y = self.edges[a].get(c), self.edges[b].get(c)
                if not self._near(x[1] if x else 0, n1, y[1] if y else 0, n2):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.counts[a][0] += self.counts[b][0]
            self.counts[a][1] += self.counts[b][1]
            for c, (t, n) in self.edges[b].items():
                if c in self.edges[a]:
                    self.edges[a][c][1] += n
                    todo.append((self.edges[a][c][0], t))
                else:
                    self.edges[a][c] = [t, n]

    def _merge_all(self) -> None:
        """Fixed states grow from the root; a state next to them is merged into the first compatible one or becomes fixed."""
        fixed = [0]
        while True:
            edge = next(((s, c) for s in fixed for c in sorted(self.edges[s]) if self.edges[s][c][0] not in fixed), None)
            if edge is None:
                break
            s, c = edge
            t = self.edges[s][c][0]
            into = next((r for r in fixed if self._compatible(r, t)), None)
            if into is None:
                fixed.append(t)
            else:
                self.edges[s][c][0] = into
                self._fold(into, t)
        self.states = len(fixed)

        low = math.log(FLOOR)
        self.steps = [{c: (t, max(low, math.log(n / self.counts[i][0]))) for c, (t, n) in self.edges[i].items()} if i in fixed else {} for i in range(len(self.counts))]
        self.ends = [max(low, math.log(e / n)) if e and n else low for n, e in self.counts]

    def score(self, symbols: str) -> float:
        """Log-likelihood of the whole value, its end included."""
        state, total, low = 0, 0.0, math.log(FLOOR)
        for k, c in enumerate(symbols):
            step = self.steps[state].get(c)
            if step is None:  # nothing is known beyond
                return total + low * (len(symbols) - k + 1)
            state, p = step
            total += p
        return total + self.ends[state]

    def plausible(self, value: str) -> bool:
        least, most = self.lengths
        return least * (1 - LENGTH_SLACK) <= len(value) <= most * (1 + LENGTH_SLACK) or most >= TRAIN_LENGTH and len(value) >= least


class Formats:
    """Automata of credentials and of ordinary tokens, and the threshold between them."""

    def __init__(self, labelled: dict[str, list[str]]):
        ordinary = sorted(labelled.get("ordinary", []))
        train = lambda values: Automaton([_symbols(v[:TRAIN_LENGTH]) for v in values])
        self.good = [train(labelled[k]) for k in KINDS[:3] if labelled.get(k)]
        self.plain, self.threshold = None, MARGIN
        if not self.good or not ordinary:
            return
        # Credentials that no label names may be among the ordinary tokens. Labelled ones are put among them as spies; what looks like a spy to
        # automata trained so isn't counted as ordinary.
        known = sorted({v for k in KINDS[:3] for v in labelled.get(k, [])})
        spies = known[:: max(1, len(known) // max(1, len(ordinary) // 5))]
        self.plain = train(ordinary + spies)
        cut = min(-MARGIN, sorted(map(self.margin, spies))[len(spies) // 20])
        reliable = [v for v in ordinary if self.margin(v) < cut]
        self.plain = train(reliable) if reliable else None
        if reliable:
            ranked = sorted(map(self.margin, reliable), reverse=True)
            self.threshold = max(MARGIN, math.nextafter(ranked[int(MISS * len(ranked))], math.inf))

    def margin(self, value: str) -> float:
        """Log-likelihood ratio a character of the best automaton that has values of such a length."""
        symbols = _symbols(value)
        likely = [a.score(symbols) for a in self.good if a.plausible(value)]
        if not likely:
            return -math.inf
        return (max(likely) - (self.plain.score(symbols) if self.plain else -(len(symbols) + 1) * math.log(8))) / (len(symbols) + 1)

    def found(self, token: str) -> bool:
        return self.margin(token) >= self.threshold


class _Cover:
    """Which stretches of a text no span touches, by binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        self.reach = list(accumulate((e for _, _, e in spans), max))

    def spares(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return not k or self.reach[k - 1] <= start


def credentials(text: str) -> list[tuple[str, str]]:
    """(label, value) of the base spans."""
    return [(KINDS[kind], ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]) for start, kind, end in base_spans(text)]


def ordinary_tokens(text: str) -> list[str]:
    cover = _Cover(base_spans(text))
    return [m[0] for m in TOKEN.finditer(text) if cover.spares(m.start(), m.end())]


def train(docs: DataFrame, ordinary_docs: int = ORDINARY_DOCS) -> Formats:
    """Credentials from all documents, ordinary tokens from a bounded sample of them; of each label the TRAIN_VALUES with the least hashes."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            got = sorted({(k, v[:TRAIN_LENGTH]) for t in b.column("text").to_pylist() for k, v in credentials(t or "")})
            yield pa.record_batch([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], ["label", "value"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        for b in batches:
            got = sorted({v[:TRAIN_LENGTH] for t in b.column("text").to_pylist() for v in ordinary_tokens(t or "")})
            yield pa.record_batch([pa.array(["ordinary"] * len(got), pa.string()), pa.array(got, pa.string())], ["label", "value"])

    known = docs.select("text").mapInArrow(labelled, "label string, value string")
    found = known.unionByName(hash_sample(docs, ordinary_docs).select("text").mapInArrow(plain, "label string, value string"))
    values: dict[str, list[str]] = {}
    # a row a distinct value, then the least hashes by label: partial top-k, no label meets in a task
    distinct = stage(found.distinct().withColumn("h", F.xxhash64("value")), "labelled-values")
    for label in (*KINDS[:3], "ordinary"):
        for row in distinct.filter(F.col("label") == label).orderBy("h", "value").limit(TRAIN_VALUES).collect():
            values.setdefault(label, []).append(row.value)
    forget(distinct)
    return Formats(values)


def scan(docs: DataFrame, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base (base spans) and spans (all): "kind:start:end", comma-joined."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    formats = train(docs, ordinary_docs)

    def spans_of(text: str, judged: Memo) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        cover = _Cover(base)
        return base, [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if judged[m[0]] and cover.spares(m.start(), m.end())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot(None)
        judged = Memo(lambda token: b"1" if formats.found(token) else b"", MEMO_BYTES)
        show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for b in batches:
            found = [spans_of(t or "", judged) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in base + more) for base, more in found], pa.int64()) for kind in range(4)]
            yield pa.record_batch([b.column("doc_id"), *counts, pa.array([show(base) for base, _ in found], pa.string()), pa.array([show(sorted(base + more)) for base, more in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base", "spans"])

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base string, spans string")

