"""Whitening of embeddings by singular value decompositions that are merged in a tree.

A part of the vectors is held as its number, its exact sums and the factor of its centred scatter: all singular values
with their right vectors, as many as there are dimensions. Parts are merged by stacking their factors with one
mean-correction row each and decomposing again, which loses nothing. Partitions make parts, groups of parts are merged
by key, and the last one gives the components. A part has at most as many rows as dimensions, whatever it was made of.

Vectors that are null, empty, or hold null or non-finite entries are dropped, as are those of another length than most
distinct vectors have (of equally many, the longer): a covariance has one set of dimensions. Components of no variance
have no scale and are left out, so a table of one distinct vector gives no rows. Repeated rows count once in the fit
and each get their own result. Entries beyond a long take its ends.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tallyforge.llm.common import discarded, written

SCALE, COMPONENTS = 256, 4
#: Parts that are merged at once.
FAN = 16
#: Rows that are stacked under a part's factor at once, at least.
BLOCK = 4096
_PART = "part bigint, n bigint, sums string, factor binary"
_LONG = 1 << 62


class Part:
    """n vectors: exact sums of their dimensions, and a factor F whose F'F is their scatter about their mean."""

    def __init__(self, n: int, sums: list[int], factor: np.ndarray):
        self.n, self.sums, self.factor = n, sums, factor

    @classmethod
    def of(cls, x: np.ndarray) -> Part:
        """A block of vectors; its factor is the centred block itself."""
        wide = x.astype(object) if len(x) * int(np.abs(x.astype(float)).max(initial=0)) >= _LONG else x
        sums = [int(s) for s in wide.sum(axis=0)]
        return cls(len(x), sums, x - np.array([s / len(x) for s in sums]))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def merged(parts: list[Part]) -> Part:
    """One part of several: factors over mean-correction rows, decomposed; every singular value is kept."""
    n = sum(p.n for p in parts)
    sums = [sum(s) for s in zip(*(p.sums for p in parts))]
    mean = np.array([s / n for s in sums])
    corrections = [np.sqrt(p.n) * (p.mean() - mean)[None] for p in parts] if len(parts) > 1 else []
    _, values, vectors = np.linalg.svd(np.concatenate([*(p.factor for p in parts), *corrections]), full_matrices=False)
    return Part(n, sums, values[:, None] * vectors)


def _packed(number: int, part: Part) -> tuple:
    return number, part.n, json.dumps(part.sums), part.factor.astype("<f8").tobytes()


def _unpacked(n: int, sums: str, factor: bytes) -> Part:
    own = json.loads(sums)
    return Part(n, own, np.frombuffer(factor, "<f8").reshape(-1, len(own)))


def _matrix(column, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _parts(dimensions: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = None
        for batch in batches:
            x = _matrix(batch.column("x"), dimensions)
            step = max(BLOCK, dimensions)
            for at in range(0, len(x), step):
                block = Part.of(x[at : at + step])
                part = merged([part, block] if part else [block])
        if part:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in _packed(TaskContext.get().partitionId(), part)], ["part", "n", "sums", "factor"])

    return run


def _gathered(key, rows):
    import pandas as pd

    part = merged([_unpacked(*r) for r in zip(rows["n"].tolist(), rows["sums"], rows["factor"])])
    return pd.DataFrame([_packed(int(key[0]), part)], columns=["part", "n", "sums", "factor"])


def fitted(fit: DataFrame, dimensions: int, fan: int = FAN) -> Part | None:
    """The part of all vectors x (arrays of longs of one length), by rounds of merging groups of ``fan`` parts."""
    parts = written(fit.select("x").mapInArrow(_parts(dimensions), _PART))
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while last > 0:
        before = parts
        parts = written(parts.groupBy(F.floor(F.col("part") / fan).alias("part")).applyInPandas(_gathered, _PART))
        discarded(before)
        last //= fan
    only = parts.first()
    return _unpacked(only["n"], only["sums"], bytes(only["factor"]))


class Model:
    """The mean and the first components of a part: unit vectors, eigenvalues, shares of the whole variance."""

    def __init__(self, part: Part, components: int):
        _, values, vectors = np.linalg.svd(part.factor, full_matrices=False)
        kept = int(np.count_nonzero(values > values[:1].max(initial=0) * 8 * len(part.sums) * np.finfo(float).eps))
        kept = min(kept, components)
        self.n, self.sums, self.mean = part.n, part.sums, part.mean()
        self.vectors, self.values = vectors[:kept], values[:kept] ** 2 / part.n
        self.explained = values[:kept] ** 2 / max(float((values**2).sum()), np.finfo(float).tiny)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n*x-S)^2 of each vector; null where a long can't hold it."""
        most = self.n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, self.sums))
        exact = np.int64 if len(self.sums) * most * most < _LONG else object
        away = x.astype(exact) * self.n - np.array(self.sums, exact)
        return [int(v) if v < 1 << 63 else None for v in (away * away).sum(axis=1)]


def integers(vector, scale: int = SCALE):
    """floor(scale * c) of each entry c, as an array of longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def usable(vector):
    """Whether a vector is there, not empty, and all its entries are finite numbers."""
    finite = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """For each usable row and component: the id, component, n, deviation, whitened, explained and identity_error."""
    schema = StructType([vectors.schema[id_column], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    rows = vectors.filter(usable(F.col(vector_column))).select(F.col(id_column).alias("id"), integers(F.col(vector_column)).alias("x"))
    fit = written(rows.select("x").distinct())
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema)
    fit, rows = (t.filter(F.size("x") == length["d"]) for t in (fit, rows))
    model = Model(fitted(fit, length["d"], fan), components)
    if not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_projected(model, identity_error(fit, model), schema), schema)


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.values)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            z = model.whitened(_matrix(batch.column("x"), len(model.sums)))
            yield pa.RecordBatch.from_arrays([pa.array(z[:, c]) for c in range(k)], [f"z{c}" for c in range(k)])

    z = fit.select("x").mapInArrow(run, ", ".join(f"z{c} double" for c in range(k)))
    error = [F.abs(F.covar_pop(f"z{a}", f"z{b}") - float(a == b)) for a in range(k) for b in range(a, k)]
    return max(z.agg(*(e.alias(f"e{i}") for i, e in enumerate(error))).first())


def _projected(model: Model, error: float, schema: StructType):
    names, k = schema.names, len(model.values)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("x"), len(model.sums))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n, np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(each), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
