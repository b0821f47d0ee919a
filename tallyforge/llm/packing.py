"""Packing token sequences by vector bin packing with the dot-product heuristic.

Each example asks for tokens, one segment and loss-bearing tokens; each sequence has a limit for all three.
A sequence is filled by taking, again and again, the example with the largest dot product of what it asks
for and what the sequence has left (both as shares of the limits), among those that fit. Where examples may
be cut, a last one is cut to fill the sequence to its end; what remains of it stays to be placed.

Documents are tokenized and packed as they come, by a task at a time: a task holds one block of documents
and what the last block left over. At the end of a task the last sequence is cut at powers of two, which
need no padding. Sequence ids hold the number of Spark's partition, so that none is used twice.

Null and empty texts have their closing id alone. Documents of any length are cut into whole sequences and
a rest. Repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import byte_letters
from tallyforge.llm.common import pieces

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 1024, 64, 1024
#: Documents packed together.
BLOCK = 512
SHAPE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class TextEncoder:
    """Ids of whole texts by a byte-level tokenizers file.

    tiktoken does the work: in such a vocabulary a token's id is the rank of its merge, so both libraries
    give the same ids. Where it gives up (on extremely long runs of white space), tokenizers takes its place.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except BaseException as error:  # a panic of the library is no Exception, and its type has no public name
            if type(error).__name__ != "PanicException":
                raise
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(self.path)
            own.no_truncation()
            own.no_padding()
            return np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def fill(need: np.ndarray, limits: np.ndarray, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length) for examples that need (tokens, loss-bearing tokens) each.

    An example has at most as many tokens as a sequence. Where ``cut`` is true, the loss-bearing tokens of a
    piece are taken to be in proportion. The last sequence may be short; without ``cut``, others may be too.
    """
    left = np.column_stack([need[:, 0], np.ones(len(need)), need[:, 1]]).astype(float)
    start = np.zeros(len(need), np.int64)
    alive = np.ones(len(need), bool)
    out = []
    while alive.any():
        room, own = limits.astype(float), []
        while True:
            fits = alive & (left <= room + 1e-9).all(1)
            if not fits.any():
                break
            i = int(np.argmax(np.where(fits, (left / limits) @ (room / limits), -1.0)))
            own.append((i, int(start[i]), int(left[i, 0])))
            room -= left[i]
            alive[i] = False
        if cut and room[0] >= 1 and room[1] >= 1 and room[2] >= 1 and alive.any():
            i = int(np.argmax(np.where(alive, left[:, 0], -1.0)))
            share = left[i, 2] / left[i, 0]
            n = int(min(room[0], room[2] / share if share else room[0], left[i, 0]))
            if n:
                own.append((i, int(start[i]), n))
                start[i] += n
                left[i, 0] -= n
                left[i, 2] = max(0.0, left[i, 2] - n * share)
                alive[i] = left[i, 0] >= 1
        if not own:
            raise ValueError("an example is larger than a sequence")
        out.append(own)
    return out


class _Packer:
    """Packs the documents of one task."""

    def __init__(self, first: int, limits: tuple[int, int, int]):
        self.next, self.limits, self.rest = first, np.array(limits), []

    def sequence(self, parts: list[tuple]) -> list[tuple]:
        """Rows of one sequence. parts: (doc_id, start, ids as bytes, tokens of the document)."""
        rows, offset = [], 0
        for doc_id, start, ids, total in parts:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1
        return rows

    def add(self, documents: list[tuple]) -> list[tuple]:
        """Rows of the sequences that (doc_id, ids as bytes) fill, with what was left before."""
        rows, size = [], int(self.limits[0])
        parts = self.rest
        for doc_id, ids in documents:
            total = len(ids) // 4
            whole = total - total % size
            for start in range(0, whole, size):
                rows += self.sequence([(doc_id, start, ids[4 * start : 4 * (start + size)], total)])
            if whole < total:
                parts.append((doc_id, whole, ids[4 * whole :], total))
        self.rest = []
        if parts:
            need = np.array([[len(p[2]) // 4] * 2 for p in parts])
            for own in fill(need, self.limits, cut=True):
                chosen = [(parts[i][0], parts[i][1] + s, parts[i][2][4 * s : 4 * (s + n)], parts[i][3]) for i, s, n in own]
                if sum(n for _, _, n in own) == size or len(own) >= self.limits[1]:
                    rows += self.sequence(chosen)
                else:
                    self.rest += chosen
        return rows

    def close(self) -> list[tuple]:
        """Rows of what is left, in sequences whose lengths are powers of two."""
        rows, parts = [], self.rest
        while parts:
            size = 1 << (min(sum(len(p[2]) // 4 for p in parts), int(self.limits[0])).bit_length() - 1)
            own, later, room = [], [], size
            for doc_id, start, ids, total in parts:
                n = min(room, len(ids) // 4) if len(own) < self.limits[1] else 0
                if n:
                    own.append((doc_id, start, ids[: 4 * n], total))
                    room -= n
                if 4 * n < len(ids):
                    later.append((doc_id, start + n, ids[4 * n :], total))
            rows += self.sequence(own)
            parts = later
        self.rest = []
        return rows


_ENCODERS: dict[str, TextEncoder] = {}


def packed_documents(docs: DataFrame, vocabulary: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), end: int = 0) -> DataFrame:
    """A row for each piece of a document: see SHAPE. Each document's ids are followed by the id ``end``."""

    def run(batches):
        import pyarrow as pa

        own = _ENCODERS.setdefault(vocabulary, None) or TextEncoder(vocabulary)
        _ENCODERS[vocabulary] = own
        packer = _Packer(TaskContext.get().partitionId() << 36, limits)
        last = np.array([end], "<u4").tobytes()
        kinds = pa.schema([(n.split()[0], pa.int64()) for n in SHAPE.split(", ")])
        waiting: list[tuple] = []

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kinds)

        for batch in batches:
            for part in pieces(batch):
                waiting += [(d, own.encode(t) + last) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                while len(waiting) >= BLOCK:
                    if rows := packer.add(waiting[:BLOCK]):
                        yield batch_of(rows)
                    waiting = waiting[BLOCK:]
        if rows := [*packer.add(waiting), *packer.close()]:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SHAPE)


#: Limits of a sequence of instruction data.
INSTRUCTION_LIMITS = (2048, 8, 768)


def instruction_sizes(turns: DataFrame, vocabulary: str, key: str = "conv_id") -> DataFrame:
    """example_id, n_tokens, n_loss of each conversation: a turn's ids and one that closes it; loss is borne by those of the assistant.

    A null text has its closing id alone; turns without a conversation are one example of a null id.
    """

    def run(batches):
        import pyarrow as pa

        own = _ENCODERS.setdefault(vocabulary, None) or TextEncoder(vocabulary)
        _ENCODERS[vocabulary] = own
        for batch in batches:
            for part in pieces(batch):
                n = np.array([len(own.encode(t)) // 4 + 1 for t in part.column("text").to_pylist()], np.int64)
                loss = np.array([r == "assistant" for r in part.column("role").to_pylist()], bool)
                yield pa.RecordBatch.from_arrays([part.column("example_id"), pa.array(n), pa.array(n * loss)], ["example_id", "n_tokens", "n_loss"])

    counted = turns.select(turns[key].cast("bigint").alias("example_id"), "role", "text").mapInArrow(run, "example_id bigint, n_tokens bigint, n_loss bigint")
    return counted.groupBy("example_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_loss")])


def packed_examples(examples: DataFrame, limits: tuple[int, int, int] = INSTRUCTION_LIMITS) -> DataFrame:
    """Instruction data, whole examples: columns example_id, n_tokens, n_loss, with sequence_id and offset.

    A sequence keeps all three limits: tokens, segments and loss-bearing tokens. Nulls count as 0 tokens. An
    example beyond a limit stands alone in a sequence of its own. Repeated rows are packed as often as they occur.
    """
    names = ["example_id", "n_tokens", "n_loss", "sequence_id", "offset"]

    def run(batches):
        import pyarrow as pa

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column("example_id").to_pylist()
            need = np.array([[t or 0, n or 0] for t, n in zip(batch.column("n_tokens").to_pylist(), batch.column("n_loss").to_pylist(), strict=True)], np.int64).reshape(-1, 2)
            large = (need > np.array([limits[0], limits[2]])).any(1)
            groups = [[int(i)] for i in np.flatnonzero(large)]
            for first in range(0, len(ids), BLOCK):
                rows = first + np.flatnonzero(~large[first : first + BLOCK])
                groups += [[int(rows[i]) for i, _, _ in own] for own in fill(need[rows], np.array(limits), cut=False)]
            out = []
            for own in groups:
                offset = 0
                for i in own:
                    out.append((ids[i], *need[i].tolist(), number, offset))
                    offset += int(need[i, 0])
                number += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    source = examples.selectExpr("CAST(example_id AS bigint) AS example_id", "n_tokens", "n_loss")
    return source.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
