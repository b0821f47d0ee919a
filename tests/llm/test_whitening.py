"""Whitening against a plain eigendecomposition of the distinct vectors, and on nulls, ties, ragged and empty tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallyforge.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "c", 1) for i, v in rows], SCHEMA)


def expected(rows, length):
    """(n, S, distinct x, x of each row) by plain Python."""
    own = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in own})
    return len(fit), [sum(c) for c in zip(*fit)], np.array(fit, float), own


def vectors(seed, count, length):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, length)) @ rng.normal(size=(length, length)) * 0.3 + rng.normal(size=length)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("fan", [2, 16])
def test_whitening_is_the_eigendecomposition(spark, fan, monkeypatch):
    monkeypatch.setattr(w, "BLOCK", 7)
    plain = vectors(1, 150, 6)
    rows = [*plain, *((1000 + k, plain[3][1]) for k in range(80)), plain[5], (None, plain[6][1]), (2000, None), (2001, []), (2002, [1.0] * 5 + [None]), (2003, [1.0] * 5 + [float("nan")]), (2004, [float("inf")] * 6), (2005, [1.0, 2.0]), (2006, [-0.0] * 6)]
    n, sums, fit, own = expected(rows, 6)
    df = w.whitened(table(spark, rows).repartition(9), fan=fan)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = df.collect()
    assert len(got) == 4 * len(own) and {r["n"] for r in got} == {n}
    covariance = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1].T
    by = {}
    for i, x in own:
        by.setdefault(i, []).append(x)
    signs = {}
    for r in got:
        x = by[r["vec_id"]][0]
        k = r["component"] - 1
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-10
        z = (np.array(x) - np.array(sums) / n) @ axes[k] / math.sqrt(values[k])
        if abs(z) > 1e-6:
            signs.setdefault(k, set()).add(round(r["whitened"] / z, 8))
        assert r["identity_error"] < 1e-9
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 4


def test_merging_keeps_every_dimension():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(400, 12)) * 1000 + 50_000).astype(np.int64)
    parts = [w.Part.of(x[a:b]) for a, b in ((0, 1), (1, 5), (5, 200), (200, 400))]
    whole = w.merged([w.merged(parts[:2]), w.merged([parts[3], parts[2]])])
    assert whole.n == 400 and whole.sums == x.sum(axis=0).tolist()
    centred = x - x.mean(axis=0)
    assert np.allclose(whole.factor.T @ whole.factor, centred.T @ centred, rtol=1e-10, atol=1e-3)
    assert whole.factor.shape == (12, 12)


def test_a_large_mean_costs_no_digits(spark):
    rows = [(i, [1e6 + v[0], 1e6 + v[1]]) for i, v in vectors(4, 60, 2)]
    n, sums, fit, own = expected(rows, 2)
    got = w.whitened(table(spark, rows)).collect()
    values = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1]
    assert {r["component"] for r in got} == {1, 2}
    for r in got:
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-8


def test_exact_deviations_beyond_floats():
    model = w.Model(w.Part.of(np.array([[3, 1 << 40], [5, -(1 << 40)], [8, 12345678901]])), 2)
    x = np.array([[3, 1 << 40], [1 << 62, 7]])
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(v, model.sums)) for v in x]
    assert model.deviations(x) == [v if v < 1 << 63 else None for v in exact]
    assert model.deviations(np.array([[4, 5]])) == [v if v < 1 << 63 else None for v in [sum((3 * a - s) ** 2 for a, s in zip((4, 5), model.sums))]]


def test_no_variance_and_no_rows(spark):
    assert w.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert w.whitened(table(spark, [])).collect() == []
    assert w.whitened(table(spark, [(1, None), (2, [])])).collect() == []
    line = w.whitened(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)


def test_query_over_its_whole_table(spark):
    from tallyforge.llm import catalog

    got = catalog.op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    raw = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    fit = np.unique(np.floor(256 * np.stack(raw["embedding"]).astype(float)).astype(np.int64), axis=0)
    values = np.linalg.eigvalsh(np.cov(fit.T.astype(float), bias=True))[::-1]
    assert len(got) == 4 * len(raw) and (got["n"] == len(fit)).all()
    for k in range(4):
        own = got[got["component"] == k + 1]
        assert np.allclose(own["explained"], values[k] / values.sum(), rtol=1e-9)
        assert abs(own["whitened"].var(ddof=0) - 1) < 1e-6 or len(fit) < len(raw)
