"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The pieces are those of a public sentencepiece vocabulary in the order of their merges; they get the Zipf-Mandelbrot law, in which a piece of rank r has a
probability in proportion to 1 / (r + RANK_SHIFT), normalised over the vocabulary. A character that no piece covers is spelled in its UTF-8
bytes, one token each at BYTE_SCORE. The count of a pre-token (a word with the mark U+2581 before it) is that of its best segmentation; of
equal scores the one with fewer tokens. Distinct pre-tokens are inserted in a trie that a Python worker keeps over all its batches: a node is a prefix and holds
the forward score of that prefix, which is computed once, when the first word with the prefix comes; a word's last node gives its terminal count, which is
stored.

The trie is bounded by its nodes: when it is full it starts anew, at any word, without a change of results. Characters of a word beyond LONG are
scored in passing and get no nodes, so a text without spaces fills nothing.

Null and empty texts: 0 words, 0 tokens. Repeated rows are counted alike. Texts are taken whole, whatever their length. Empty tables give no rows.
Extra columns are not carried along.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slot

MARK, RANK_SHIFT, BYTE_SCORE = "▁", 10.0, -24.0
#: Nodes of a worker's trie (about 180 bytes each, with the terminal counts), and characters of a word that get nodes.
MAX_NODES, LONG = 1_200_000, 512
#: More than any code point.
_WIDTH = 1 << 21
_LOW = float("-inf")


class UnigramTrie:
    def __init__(self, model_path: str, max_nodes: int = MAX_NODES, long: int = LONG):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        total = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(normal))))
        self.score = {model.id_to_piece(i): -math.log(r + RANK_SHIFT) - total for r, i in enumerate(normal)}
        self.longest = max(map(len, self.score))
        self.max_nodes, self.long = max_nodes, long
        self._reset()

    def _reset(self) -> None:
        """The root stands for the mark alone."""
        self.child: dict[int, int] = {}
        self.counts: dict[str, int] = {}
        best, used = self._forward(MARK, 1, [0.0], [0])
        self.best, self.used = array("d", [best]), array("l", [used])

    def _forward(self, text: str, end: int, best: list[float], used: list[int]) -> tuple[float, int]:
        """Score and tokens of the best segmentation of text[:end], from those of all shorter prefixes."""
        score, top, tokens = self.score, _LOW, 0
        for start in range(max(0, end - self.longest), end):
            s = score.get(text[start:end])
            if s is not None:
                s += best[start]
                if s > top or s == top and used[start] + 1 < tokens:
                    top, tokens = s, used[start] + 1
        if text[end - 1] not in score:
            size = len(text[end - 1].encode("utf-8", "surrogatepass"))
            s = best[end - 1] + size * BYTE_SCORE
            if s > top or s == top and used[end - 1] + size < tokens:
                top, tokens = s, used[end - 1] + size
        return top, tokens

    def insert(self, word: str) -> int:
        """The word's terminal count; only prefixes that no word before had are scored."""
        if len(self.best) + min(len(word), self.long) > self.max_nodes:
            self._reset()
        text, child = MARK + word, self.child
        best, used, node = [0.0, self.best[0]], [0, self.used[0]], 0
        for end in range(2, min(len(text), self.long) + 1):
            at = node * _WIDTH + ord(text[end - 1])
            node = child.get(at, -1)
            if node < 0:
                b, u = self._forward(text, end, best, used)
                node = child[at] = len(self.best)
                self.best.append(b)
                self.used.append(u)
            best.append(self.best[node])
            used.append(self.used[node])
        for end in range(len(best), len(text) + 1):  # beyond LONG
            b, u = self._forward(text, end, best, used)
            best.append(b)
            used.append(u)
        if len(word) <= self.long:
            self.counts[word] = used[-1]
        return used[-1]

    def count(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = (text or "").split()
        total, find = 0, self.counts.get
        for w in words:
            n = find(w)
            if n is None:
                n = self.insert(w)
                find = self.counts.get
            total += n
        return len(words), total


def trie(model_path: str) -> UnigramTrie:
    return slot(("unigram", model_path), lambda: UnigramTrie(model_path))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = trie(model_path)
        for b in batches:
            got = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
