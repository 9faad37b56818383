"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one vocabulary token can end its encoding. The tokens that
are suffixes of a prefix come from an automaton over the vocabulary; the right one is the
token that is compatible with the last token of the prefix before it: no merge across their
border would have come before the merges that made the two. Back-pointers give the ids.

Decoding starts from the ids alone.

Null and empty texts: no ids, the empty decoded text. Repeated rows are encoded alike. Texts of any length are encoded whole, chunk by chunk
(what lies between white space). Empty tables give no rows; ties can't arise, an encoding is unique. Extra columns are not carried along.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Memo, prepare, slot

#: Bytes that the memos of a Python worker may hold: of chunks, of pieces, of pairs of tokens.
MEMO_CHUNKS, MEMO_PIECES, MEMO_PAIRS = 64 << 20, 56 << 20, 32 << 20
#: White space that both this module and the normaliser take as a separator.
SEPARATORS = " \t\n\r"
#: Chunks that need no normaliser but lower case: printable ASCII and the letters of Latin-1, none of which composes or depends on its neighbours.
SIMPLE = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: The pre-tokenizer's pattern, restricted to these in lower case.
SIMPLE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^\sa-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
#: Not a letter of the vocabulary.
END = "\0"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: the byte's own character where that is visible, else the next one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


class PrefixBpe:
    """An encoder for a tokenizer file with BPE merges and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("a BPE model without subword prefix is needed")
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be matched as they stand")
        self.text_of |= {i: t for t, i in self.special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {i: i.to_bytes(4, "little") for i in self.text_of}
        self.texts = np.array([self.text_of.get(i, "") for i in range(max(self.text_of) + 1)], object)
        letters = byte_letters()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((i, j), r)
            self.made.setdefault(k, (r, i, j))
        self.compatible = Memo(self._compatible, MEMO_PAIRS, 200, False)
        # one entry a token at most
        self.right_spine: dict[int, list[tuple[int, float]]] = {}
        self.left_spine: dict[int, list[tuple[int, float]]] = {}
        self.piece_ids = Memo(self._encode_piece, MEMO_PIECES)
        self.chunk = Memo(self._encode_chunk, MEMO_CHUNKS)
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        # One automaton for tokens inside a piece and, with END after them, for tokens that end one.
        self.matches = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            bare = text.removesuffix(self.suffix) if ends else text
            if not bare or i not in self.made and len(bare) > 1:
                continue  # no merge leads to it
            if not ends:
                self.matches.add_word(bare, (i, len(bare)))
            if ends or not self.suffix:
                self.matches.add_word(bare + END, (i, len(bare) + 1))
        self.matches.make_automaton()

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the outermost symbol up to the token: each with the rank of the merge that ends it."""
        found, until = [], float("inf")
        while True:
            found.append((token, until))
            if token not in self.made:
                return found[::-1]
            until = self.made[token][0]
            token = self.made[token][side]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Does the text of the two tokens encode as these two? Replays, in the order of ranks, what
        happens at their border. Of equal ranks the left occurrence goes first."""
        left, right, i, j = self.right_spine.get(pair[0]), self.left_spine.get(pair[1]), 0, 0
        if left is None:
            left = self.right_spine[pair[0]] = self._spine(pair[0], 2)
        if right is None:
            right = self.left_spine[pair[1]] = self._spine(pair[1], 1)
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_end and r <= y_end:
                return False
            if x_end == y_end == float("inf"):
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def _encode_piece(self, piece: str) -> bytes:
        """piece: one pre-token in the alphabet of the vocabulary. Its ids as little-endian 32-bit integers."""
        n = len(piece) + 1
        token: list[int] = [-1] * (n + 1)  # of each prefix: the last token, and where it starts
        back = [0] * (n + 1)
        compatible, done = self.compatible, -1
        for end, (i, size) in self.matches.iter(piece + END):
            if end == done:
                continue
            start = end + 1 - size
            if start:
                left = token[start]
                if left < 0 or not compatible[left, i]:
                    continue
            token[end + 1], back[end + 1], done = i, start, end
        if token[n] < 0:
            raise ValueError(f"no encoding for {piece!r}")
        ids, of = b"", self.bytes_of
        while n:
            ids = of[token[n]] + ids
            n = back[n]
        return ids

    def _pieces(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            pieces = SIMPLE_PIECES.findall(text.lower())
            return pieces if text.isascii() else [p.translate(self.letters) for p in pieces]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _encode_chunk(self, chunk: str) -> bytes:
        """chunk: a text without separators."""
        if chunk.isascii() and chunk.isalpha():
            return self.piece_ids[chunk.lower()]
        found: list[bytes] = []
        for k, part in enumerate(self.special_pattern.split(chunk) if self.special_pattern and "<" in chunk else [chunk]):
            if k % 2:
                found.append(self.bytes_of[self.special[part]])
            else:
                found += map(self.piece_ids.__getitem__, self._pieces(part))
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        for c in SEPARATORS[1:]:
            text = text.replace(c, " ")
        return b"".join(map(self.chunk.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> str:
        """The file has no decoder: tokens are joined by spaces."""
        return " ".join(self.texts[np.frombuffer(ids, "<u4")].tolist())


def encoder(path: str) -> PrefixBpe:
    return slot(("bpe", path), lambda: PrefixBpe(path))


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for b in batches:
            ids = [coder.encode(t) for t in b.column("text").to_pylist()]
            decoded = pa.array(map(coder.decode, ids), pa.string())
            yield pa.record_batch([b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
