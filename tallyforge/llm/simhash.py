"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints at three or fewer differing bits have a value between them: at most one bit from one and two
from the other. Every fingerprint emits all values within one bit, those with an odd number of set bits also
all at two bits; the ends of a distance of three differ in that parity, so nothing is lost. Values are dealt
to classes by a linear hash, for which hash(x ^ m) = hash(x) ^ hash(m): a class is told the fingerprint
alone and works out which of its values it holds, so that a shuffled value costs a fraction of its size.
Colliding values are verified, and each value links its fingerprints by a star, not by all pairs.

Fingerprints are made distinct before, so copies cost nothing. The number of classes grows with the
fingerprints, so that about PER_CLASS of them reach a class at every size; a fingerprint is sent to the classes
that it reaches and to no other (at most 65 with an even number of set bits, 2,081 with an odd one).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import pieces, written
from tallyforge.llm.graph import components

RADIUS = 3
#: Fewest classes of values, fingerprints that reach a class before there are more, and fingerprints dealt at once.
CLASSES, PER_CLASS, DEALT = 64, 1 << 20, 1 << 12
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([np.zeros(1, np.int64), end[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    starts, ends = start[:n].tolist(), end[len(words) - n :].tolist()
    for first in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[first : first + (1 << 15)], ends[first : first + (1 << 15)], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in range(64) if 2 * counts[k] > n)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (as a signed long) and a key of each document's text; doc_id and key tell rows apart."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                prints = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints), part.column("row_key")], ["doc_id", "fp", "row_key"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    return keyed.mapInArrow(run, "doc_id bigint, fp bigint, row_key bigint")


class Ball:
    """The values within one bit, and at two bits, by the class of a linear hash."""

    def __init__(self, classes: int):
        self.bits = classes.bit_length() - 1
        rng = np.random.default_rng(20240917)
        self.rows = rng.integers(1, 1 << 63, self.bits, dtype=np.uint64) * _U(2) + _U(1)
        one = np.array([0] + [1 << i for i in range(64)], _U)
        two = np.array([1 << i | 1 << j for i in range(64) for j in range(i)], _U)
        self.one, self.two = self._by_class(one), self._by_class(two)
        #: Classes that the values of a fingerprint of class 0 are in: for an even and for an odd number of set bits.
        near = np.array(sorted(self.one), np.int64)
        self.reach = [near, np.union1d(near, np.array(sorted(self.two), np.int64))]

    def _by_class(self, masks: np.ndarray) -> dict[int, np.ndarray]:
        own = self.hash(masks)
        return {int(c): masks[own == c] for c in np.unique(own)}

    def hash(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k, row in enumerate(self.rows):
            out |= (np.bitwise_count(x & row) & 1).astype(np.int64) << k
        return out


_NO_MASKS = np.zeros(0, _U)


def class_links(prints: np.ndarray, own: int, ball: Ball) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints (two arrays) by the values that class ``own`` holds."""
    prints = np.unique(prints)
    where, odd = ball.hash(prints), (np.bitwise_count(prints) & 1).astype(bool)
    by_class = np.argsort(where, kind="stable")
    groups = np.split(by_class, np.flatnonzero(np.diff(where[by_class])) + 1)
    near, near_of = [_NO_MASKS], [_NO_MASKS]
    for at in groups:
        masks = ball.one.get(own ^ int(where[at[0]]), _NO_MASKS)
        near.append((prints[at, None] ^ masks).ravel())
        near_of.append(np.repeat(prints[at], len(masks)))
    near, near_of = np.concatenate(near), np.concatenate(near_of)
    order = np.lexsort((near_of, near))
    near, near_of = near[order], near_of[order]
    a, b = [], []
    new = np.concatenate([np.ones(min(1, len(near)), bool), near[1:] != near[:-1]])
    head = near_of[new][np.cumsum(new) - 1] if len(near) else near_of
    a.append(head[~new])
    b.append(near_of[~new])
    even = (np.bitwise_count(near_of) & 1) == 0
    values, first = np.unique(near[even], return_index=True)
    heads = near_of[even][first]
    for at in groups if len(values) else ():
        x, masks = prints[at[odd[at]]], ball.two.get(own ^ int(where[at[0]]), _NO_MASKS)
        step = max(1, (1 << 21) // max(1, len(masks)))
        for k in range(0, len(x) if len(masks) else 0, step):
            far = (x[k : k + step, None] ^ masks).ravel()
            at_value = np.minimum(np.searchsorted(values, far), len(values) - 1)
            hit = np.flatnonzero(values[at_value] == far)
            a.append(heads[at_value[hit]])
            b.append(x[k : k + step][hit // len(masks)])
    a, b = np.concatenate(a), np.concatenate(b)
    true = np.bitwise_count(a ^ b) <= RADIUS
    pairs = np.unique(np.column_stack([np.minimum(a, b)[true], np.maximum(a, b)[true]]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def classes_for(number: int) -> int:
    """A power of two of classes, so that about PER_CLASS of so many fingerprints reach each of them."""
    classes = CLASSES
    while number * sum(len(r) for r in Ball(classes).reach) / 2 > classes * PER_CLASS:
        classes *= 2
    return classes


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints (column fp, distinct) lie within the radius of each other."""
    classes = classes_for(prints.count())

    def deal(batches):
        import pyarrow as pa

        ball = Ball(classes)
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(_U)
            for first in range(0, len(every), DEALT):
                x = every[first : first + DEALT]
                where, odd = ball.hash(x), (np.bitwise_count(x) & 1).astype(bool)
                own = np.concatenate([(where[o][:, None] ^ r).ravel() for o, r in ((~odd, ball.reach[0]), (odd, ball.reach[1]))])
                value = np.concatenate([np.repeat(x[o], len(r)) for o, r in ((~odd, ball.reach[0]), (odd, ball.reach[1]))])
                order = np.argsort(own, kind="stable")
                own, value = own[order], value[order]
                start = np.flatnonzero(np.diff(own, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(own[start]), pa.array([v.tobytes() for v in np.split(value, start[1:])], pa.binary())], ["own", "prints"])

    def meet(table):
        import pyarrow as pa

        prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), _U)
        a, b = class_links(prints, table.column("own")[0].as_py(), Ball(classes)) if len(prints) else (prints, prints)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(deal, "own bigint, prints binary").groupBy("own").applyInArrow(meet, "a bigint, b bigint")


def _keyed_links(docs: DataFrame, shingle: int) -> DataFrame:
    prints = written(fingerprints(docs, shingle))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named)
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key")


def linked(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of each document.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id counts as largest: it
    names a component only if all its members have none. Repeated rows give repeated rows.
    """
    return _keyed_links(docs, shingle).drop("row_key")


def survivors(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Documents but those whose component (of doc_id, component_id, row_key) has a smaller doc_id."""
    larger = F.col("component_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("component_id")))
    gone = keyed.filter(larger).select(F.col("row_key").alias("key"), F.col("doc_id").alias("id")).distinct()
    return docs.join(gone, (F.xxhash64(docs["text"]) == gone["key"]) & docs["doc_id"].eqNullSafe(gone["id"]), "left_anti")


def deduplicated(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Of each group of linked documents those with the smallest doc_id, with all their columns.

    Rows are judged one by one: of two texts under one doc_id, one may go and the other stay. A null doc_id
    counts as largest; in a group where all are null, all rows stay, as do repeated rows of the smallest doc_id.
    """
    return survivors(docs, _keyed_links(docs, shingle))
