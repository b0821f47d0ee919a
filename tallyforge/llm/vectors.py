"""Embedding near-dedup by spherical-cap filters.

A filter direction joins one codeword of each of a few random codes, one for each part of the rotated vector.
A vector passes all filters whose direction has an inner product of at least the cap's height with it; they
are found by list decoding: part by part, keeping the beginnings that can still get there. Vectors that pass
a common filter are compared exactly, in double precision. A pair that shares several filters is taken in
the first of them alone.

Equal vectors are one class and are compared once; their number weighs in n_links. Filters that many classes
pass are split into sub-blocks that meet in pairs, so that a group's size is bounded and nothing is lost. A
group returns the number of links of each class and a spanning forest of them, never all pairs.

The number of filters follows the largest group of one label, and how many of them a vector passes follows a
measurement on random pairs at the threshold (``design``): RECALL of them share a filter, for every length
of vectors and number of filters. No pair below the threshold is linked.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
with nothing; so do vectors of different length. Repeated rows count as vectors of their own. Other columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written
from tallyforge.llm.graph import components

#: Classes of one label for each filter, codewords of a code at most by the number of codes, components that a code
#: needs at least, classes of a filter's block.
SPREAD, MOST_WORDS, LEAST_SIZE, BLOCK = 16, {1: 512, 2: 256, 3: 128, 4: 256}, 4, 1024
#: Share of random pairs at the threshold that have to meet, and pairs measured.
RECALL, MEASURED = 0.99, 600


class Filters:
    """Random product codes for vectors of ``size`` components; a vector passes about ``passed`` filters, half of them at least."""

    def __init__(self, size: int, words: int, passed: float, parts: int = 2):
        self.least = max(2, int(passed / 2))
        rng = np.random.default_rng(7919 + size)
        self.size, self.parts = size, min(parts, size)
        self.turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        self.cuts = np.linspace(0, size, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            code = rng.standard_normal((words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True))
        share = min(0.5, passed / words**self.parts)
        self.height = NormalDist().inv_cdf(1 - share) * np.sqrt(self.parts / size)

    def passed(self, unit: np.ndarray, least: int | None = None) -> list[np.ndarray]:
        """The filters that each row of unit vectors passes, sorted: the exceeding ones, or else the ``least`` best."""
        turned = unit @ self.turn
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
        return [self._decoded([s[i] for s in scores], least or self.least) for i in range(len(unit))]

    def _decoded(self, scores: list[np.ndarray], least: int) -> np.ndarray:
        height = self.height
        while True:
            rest = np.cumsum([s.max() for s in scores[::-1]])[::-1][1:].tolist() + [0.0]
            code, total = np.zeros(1, np.int64), np.zeros(1)
            for s, best in zip(scores, rest, strict=True):
                total = (total[:, None] + s).ravel()
                code = (code[:, None] * len(s) + np.arange(len(s))).ravel()
                kept = total >= height - best
                code, total = code[kept], total[kept]
            if len(code) >= least or len(code) == np.prod([float(len(s)) for s in scores]):
                return np.sort(code if height == self.height else code[np.argsort(-total, kind="stable")[:least]])
            height -= 0.1 * abs(height) + 1e-3



@lru_cache
def design(size: int, number: int, threshold: float) -> tuple[int, float, int]:
    """(codewords, filters to pass, codes) for ``number`` classes of one label, so that RECALL of the pairs at the threshold meet."""
    wanted = max(16, -(-number // SPREAD))
    parts = min(next((p for p, words in MOST_WORDS.items() if p > 1 and words**p >= wanted), 4), max(1, size // LEAST_SIZE))
    words = min(MOST_WORDS[parts], int(np.ceil(wanted ** (1 / parts) - 1e-9)))
    passed = 8.0
    if size < 2:
        return words, passed, parts
    rng = np.random.default_rng(104729)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, MEASURED, size)))
    z -= (z * x).sum(1, keepdims=True) * x
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    while passed < words**parts / 2:
        own = Filters(size, words, passed, parts)
        if np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(own.passed(x), own.passed(y), strict=True)]) >= RECALL:
            break
        passed *= 1.4
    return words, passed, parts


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least the threshold."""
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]) >= threshold


def shared_before(filters: list[np.ndarray], x: np.ndarray, y: np.ndarray, own: int) -> np.ndarray:
    """Whether rows x and y have a filter in common that comes before ``own``: they were compared there."""
    before = [f[: np.searchsorted(f, own)] for f in filters]
    names, column = np.unique(np.concatenate([before[i] for i in (*x, *y)]), return_inverse=True)
    has = np.zeros((len(x) + len(y), len(names)), np.float32)
    has[np.repeat(np.arange(len(x) + len(y)), [len(before[i]) for i in (*x, *y)]), column] = 1
    return (has[: len(x)] @ has[len(x) :].T) > 0


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix of links connects, and no more."""
    edges, unseen = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        waiting = [root] if unseen[root] else []
        unseen[waiting] = False
        while waiting:
            x = waiting.pop()
            new = np.flatnonzero(linked[x] & unseen)
            unseen[new] = False
            edges += [(x, int(y)) for y in new]
            waiting += new.tolist()
    return edges


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """What groups find about classes (class_id, label, size, embedding): rows (a, null, n), a number of links of a, and (a, b, 0), edges of a forest."""
    sized = classes.withColumn("length", F.size("embedding")).groupBy("label", "length").count().groupBy("length").agg(F.max("count").alias("n"))
    designs = {r["length"]: design(r["length"], r["n"], threshold) for r in sized.collect()}

    def decode(batches):
        import pyarrow as pa

        kept: dict[int, Filters] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                lists = [np.array(v, np.float64) for v in part.column("embedding").to_pylist()]
                found: list[np.ndarray] = [None] * len(lists)
                for size in {len(v) for v in lists}:
                    if size not in kept:
                        kept[size] = Filters(size, *designs[size])
                    own = [i for i, v in enumerate(lists) if len(v) == size]
                    x = np.array([lists[i] / np.abs(lists[i]).max() for i in own])
                    for i, f in zip(own, kept[size].passed(x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True):
                        found[i] = f
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], [*names, "filters"])

    names = ["class_id", "label", "size", "embedding"]
    kinds = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", filters array<bigint>"
    coded = written(classes.select(*names).mapInArrow(decode, schema)).withColumn("length", F.size("embedding"))
    key = ["label", "length", "filter"]
    spread = coded.withColumn("filter", F.explode("filters"))
    crowded = spread.groupBy(*key).count().filter(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = spread.join(crowded, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("class_id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*key, F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "class_id", "size", "embedding", "filters")

    def meet(table):
        import pyarrow as pa

        sub, ids, sizes = (table.column(c).to_numpy() for c in ("sub", "class_id", "size"))
        i, j, own = (table.column(c)[0].as_py() for c in ("i", "j", "filter"))
        data = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        data /= np.abs(data).max(1, keepdims=True)
        left, right = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
        found = near(data[left], data[right], threshold)
        if i == j:
            np.fill_diagonal(found, False)
        left, right, found = left[found.any(1)], right[found.any(0)], found[found.any(1)][:, found.any(0)]
        if found.any():
            lists = table.column("filters").combine_chunks()
            starts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
            filters = np.split(lists.flatten().to_numpy(), starts)
            found &= ~shared_before(filters, left, right, own)
        every = np.concatenate([left, right]) if i != j else left
        square = found
        if i != j:
            square = np.zeros((len(every), len(every)), bool)
            square[: len(left), len(left) :] = found
            square[len(left) :, : len(left)] = found.T
        n = square.astype(np.int64) @ sizes[every]
        some = np.flatnonzero(n)
        edges = np.array(forest(square), np.int64).reshape(-1, 2)
        a = np.concatenate([ids[every[some]], ids[every[edges[:, 0]]]])
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[every[edges[:, 1]]], pa.int64())])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": np.concatenate([n[some], np.zeros(len(edges), np.int64)])})

    return rows.groupBy(*key, "i", "j").applyInArrow(meet, "a bigint, b bigint, n bigint")


def linked(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector; links need equal labels and a cosine of ``threshold``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    valid = valid & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding").withColumn("valid", F.coalesce(valid, F.lit(False)))
    sound = rows.filter("valid")
    numbered = sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
    classes = written(numbered.withColumn("class_id", F.monotonically_increasing_id()))
    found = written(links(classes, threshold))
    counts = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = written(classes.join(counts, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id")))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = named.join(least, "root").select("label", "embedding", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    known = sound.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
