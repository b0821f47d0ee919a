"""BPE encoding and decoding.

Merging: a segment tree over the adjacent pairs of a word holds rank * width + place for each pair that
may merge; its root is the leftmost pair of the lowest rank. A merge changes at most three leaves, each
updated along one path. The trees of many words are rows of one array, so that every step is done for all
words that still have a pair. Words are encoded once and kept in a bounded table. Decoding starts from the ids.

Null texts count as empty. Empty texts have no ids. Repeated rows give repeated rows; other columns of the
input are ignored. Texts of any length are encoded whole; a long word is a wide tree, not a special case.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from tallyforge.llm.common import pieces

NONE = np.iinfo(np.int64).max
#: Words kept by a task; beyond that the table is emptied.
KEPT_WORDS = 500_000
#: Control characters that Python takes for white space.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Cells of the trees that are merged at once.
CELLS = 1 << 19


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merges:
    """The merge table: rank and product of a pair of ids, for whole arrays of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.base = max(vocab.values()) + 1
        a, b, c = (np.array([vocab[x] for x in side], np.int64) for side in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        keys, first = np.unique(a * self.base + b, return_index=True)
        self.keys, self.ranks, self.products = keys, first, c[first]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, product) of each pair; rank -1 where the pair never merges."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], -1), self.products[at]


def merge_words(ids: np.ndarray, length: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Words one after the other in ``ids``, with their lengths: the same after all merges."""
    start = np.cumsum(length) - length
    width = np.where(length < 2, 1, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
    kept = np.ones(len(ids), bool)
    ids, after = ids.copy(), length.copy()
    for w in np.unique(width[width > 1]).tolist():
        members = np.flatnonzero(width == w)
        step = max(1, CELLS // w)
        for k in range(0, len(members), step):
            rows = members[k : k + step]
            filled = np.arange(w) < length[rows][:, None]
            at = (start[rows][:, None] + np.arange(w))[filled]
            grid = np.full((len(rows), w + 1), -1, np.int64)  # the last column stands for what is beyond either end
            grid[:, :w][filled] = ids[at]
            _merge_rows(grid, length[rows], w, table)
            ids[at], kept[at] = grid[:, :w][filled], grid[:, :w][filled] >= 0
            after[rows] = (grid[:, :w] >= 0).sum(1)
    return ids[kept], after


def _merge_rows(ids: np.ndarray, length: np.ndarray, width: int, table: Merges) -> None:
    """Merges each row of ids in place; cells that a merge has used up become -1."""
    n, place = len(ids), np.arange(width)
    filled = place < length[:, None]
    after = np.broadcast_to(place + 1, (n, width)).copy()
    after[np.arange(n), length - 1] = width
    after = np.pad(after, ((0, 0), (0, 1)), constant_values=width)
    before = np.pad(np.broadcast_to(place - 1, (n, width)).copy(), ((0, 0), (0, 1)), constant_values=-1)
    before[:, 0] = width

    def leaf(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank, _ = table.find(ids[row, at], ids[row, after[row, at]])
        return np.where(rank >= 0, rank * width + at, NONE)

    tree = np.full((n, 2 * width), NONE, np.int64)
    row, at = np.nonzero(filled)
    tree[row, width + at] = leaf(row, at)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        at = tree[row, 1] % width
        gone = after[row, at]
        _, ids[row, at] = table.find(ids[row, at], ids[row, gone])
        beyond = after[row, gone]
        after[row, at] = beyond
        inside = beyond < width
        before[row[inside], beyond[inside]] = at[inside]
        ids[row, gone] = -1
        tree[row, width + gone] = NONE
        tree[row, width + at] = leaf(row, at)
        left = before[row, at]
        some = left < width
        tree[row[some], width + left[some]] = leaf(row[some], left[some])
        rows, nodes = np.concatenate([row, row, row[some]]), width + np.concatenate([at, gone, left[some]])
        for _ in range(width.bit_length() - 1):
            nodes = nodes >> 1
            tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
        row = row[tree[row, 1] != NONE]


class WordEncoder:
    """Encodes whole texts with a vocabulary of words that end in a suffix, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.table = Merges(self.vocab, [tuple(m) for m in model["merges"]])
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.first = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        self.numbers = {i: str(i) for i in self.tokens}
        self.token_of = {str(i): t for i, t in self.tokens.items()}
        #: Ids, joined by spaces, of each chunk (a text without white space) that was met.
        self.kept_ids: dict[str, str] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character in lower case (capital sigma has one small form here)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that aren't kept yet, each of their words once."""
        words = {c: self.words.findall(c) for c in chunks if not c.isalpha()}
        new = list({*(c for c in chunks if c not in words), *(w for ws in words.values() for w in ws)} - self.kept_ids.keys())
        if new:
            self._learn_words(new)
        for c, ws in words.items():
            self.kept_ids[c] = " ".join([self.kept_ids[w] for w in ws])

    def _learn_words(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, ends = self.first[data], np.cumsum(length)
        ids[ends - 1] = self.last[data[ends - 1]]
        merged, n = merge_words(ids, length, self.table)
        numbers = [self.numbers[i] for i in merged.tolist()]
        first = 0
        for w, last in zip(words, np.cumsum(n).tolist(), strict=True):
            self.kept_ids[w] = " ".join(numbers[first:last])
            first = last

    def split(self, text: str) -> list[str]:
        """The chunks of a text; special tokens are chunks of their own, marked by a leading space."""
        if "<|" in text:
            parts = self.split_special.split(text)
            return [c for x in parts for c in ([" " + x] if x in self.special else self.split_plain(x))]
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        # split() also splits at these four, which the vocabulary's pattern takes for words
        return self.words.findall(self.normal(text)) if SEPARATORS.search(text) else self.normal(text).split()

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimal numbers joined by spaces."""
        if len(self.kept_ids) > KEPT_WORDS:
            self.kept_ids.clear()
        for x, i in self.special.items():
            self.kept_ids[" " + x] = str(i)
        parts = [self.split(t) for t in texts]
        if new := list(set().union(*parts) - self.kept_ids.keys()):
            self.learn(new)
        ids_of = self.kept_ids.__getitem__
        return [" ".join(map(ids_of, own)) for own in parts]

    def decode(self, ids: str) -> str:
        """The tokens of ids (decimal numbers joined by spaces) joined by spaces, as a vocabulary without a decoder has it."""
        return " ".join(map(self.token_of.__getitem__, ids.split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, vocabulary: str, digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded text of each document, or SHA-256 of the last two.

    vocabulary: path of a tokenizers file, which each executor has.
    """

    def run(batches):
        import pyarrow as pa

        own = encoder(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in pieces(batch):
                ids = own.encode([t or "" for t in part.column("text").to_pylist()])
                decoded = map(own.decode, ids)
                n = pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64())
                if digests_only:
                    rest = [pa.array(map(sha, ids), pa.string()), pa.array(map(sha, decoded), pa.string())]
                else:
                    rest = [pa.array([[int(i) for i in row.split()] for row in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, *rest], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded"))]
    kinds = ("string", "string") if digests_only else ("array<int>", "string")
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, ("bigint", "bigint", *kinds), strict=True))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
