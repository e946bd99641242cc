"""Whitening against dense eigenvectors, with nulls, odd lengths, repeats, huge entries and empty tables."""

import math
from collections import defaultdict

import numpy as np
import pytest

from trajstats.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def dense(vectors, count=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    y = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x], dtype=float)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    return n, [int(((n * r - sums) ** 2).sum()) for r in x], y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


def by_row(rows):
    out = defaultdict(dict)
    for r in rows:
        out[r.vec_id][r.component] = r
    return out


def test_against_dense_eigenvectors(spark):
    got = by_row(queries.op13_whitening(spark, SF).collect())
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(given)
    n, deviation, whitened, explained = dense([given[i] for i in ids])
    assert sorted(got) == ids and all(sorted(c) == list(range(1, 9)) for c in got.values())
    for k in range(8):
        column = np.array([got[i][k + 1].whitened for i in ids])
        sign = np.sign(column @ whitened[:, k])
        assert np.abs(column * sign - whitened[:, k]).max() < 1e-9
        assert got[ids[0]][k + 1].explained == pytest.approx(explained[k], rel=1e-12)
    assert [got[i][1].deviation for i in ids] == deviation and {r.n for c in got.values() for r in c.values()} == {n}
    assert max(r.identity_error for c in got.values() for r in c.values()) < 1e-10


def test_solver_on_close_and_tied_eigenvalues():
    draws = np.random.default_rng(1)
    turn = np.linalg.qr(draws.normal(size=(200, 200)))[0]
    for values in (np.linspace(1.0, 0.9, 200), np.repeat([5.0, 3.0, 3.0, 1.0], 50), np.geomspace(1e6, 1e-6, 200)):
        matrix = turn * values @ turn.T
        calls = []
        found, axes, residuals = whitening.jacobi_davidson(lambda c: calls.append(c.shape[1]) or matrix @ c, 200, 8)
        assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-12 * values.max()
        assert residuals.max() < 1e-12 * values.max() and np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12
        assert len(calls) < 400


def test_defined_cases(spark):
    schema = "vec_id long, embedding array<float>, key string, x int, component int"
    draws = np.random.default_rng(2)
    good = [[float(np.float32(c)) for c in v] for v in draws.normal(size=(30, 3))]
    bad = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [1.0, math.inf, 2.0], [1.0, 2.0]]
    ids = [*range(27), None, None, 5]
    rows = [(i, v, "k", 1, 2) for i, v in zip(ids, good)] + [(100 + i, v, None, None, None) for i, v in enumerate(bad)]
    got = whitening.components(spark.createDataFrame(rows, schema).repartition(3)).collect()
    n, deviation, _, explained = dense(good)
    assert n == 30 and len(got) == 90 and {r.n for r in got} == {30} and not any(r.vec_id and r.vec_id >= 100 for r in got)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert all(r.explained == pytest.approx(explained[1], rel=1e-12) for r in got if r.component == 2)
    none = spark.createDataFrame(rows, schema)
    assert whitening.components(none.limit(0)).count() == 0
    assert whitening.components(none.filter("vec_id >= 100 and vec_id < 105")).count() == 0
    one = whitening.components(none.filter("vec_id = 3")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, 0.0) for k in (1, 2, 3)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in huge] == [str((2 * 1024 * 2**40) ** 2 + 1024**2)] * 2
