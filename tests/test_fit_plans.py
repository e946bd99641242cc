"""Fits as plans: planted parameters, non-negative least squares against all subsets, curves of origin windows, inefficiency by blocks of lags."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajstats.operators import blocks, features, fits, groups, lags, rollups
from trajstats.session import group_side


def test_interface_fits_of_many_groups(spark):
    draws = np.random.default_rng(0)
    r, rows, planted = np.arange(5, 300, 5.0), [], {}
    for k in range(6):
        a, b, radius, width = (float(draws.uniform(*s)) for s in ((100, 300), (320, 400), (80, 200), (8, 30)))
        planted[k] = (a, b, radius, width)
        rows += [(k, float(x), b - a * math.erf((x - radius) / (math.sqrt(2) * width)) + float(draws.normal(0, 0.5)), 1.0) for x in r]
    rows += [(90, 5.0, 1.0, 1.0), (90, 10.0, None, 1.0)] + [(91, float(x), 0.0, None) for x in range(8)]
    found = {f.k: f for f in fits.interface_fit(spark.createDataFrame(rows, "k int, r_mid double, density double, sem double"), ["k"]).collect()}
    for k, want in planted.items():
        f = found[k]
        assert f.status == "unweighted" and f.rmse < 0.8
        for value, error, true in zip((f.a, f.b, f.r_fit, f.w_fit), (f.se_a, f.se_b, f.se_r, f.se_w), want):
            assert abs(value - true) < 5 * error + 1e-6
    assert found[90].status == "too_few_points" and found[90].a is None
    assert found[91].status in ("unweighted", "bounded", "failed")


def test_confined_fits_and_gate(spark):
    t = np.arange(0, 200.0)
    draws = np.random.default_rng(1)
    frames = [pd.DataFrame({"k": k, "lag": t, "msd": l * l * (1 - np.exp(-t / tau)) + draws.normal(0, 0.1, 200)}) for k, (l, tau) in enumerate([(8, 12), (5, 40), (20, 3.5)])]
    frames += [pd.DataFrame({"k": 7, "lag": t, "msd": draws.uniform(0, 1, 200)}), pd.DataFrame({"k": 8, "lag": t[:5], "msd": t[:5]})]
    found = {f.k: f for f in fits.confined_fit(spark.createDataFrame(pd.concat(frames)), ["k"]).collect()}
    for k, (l, tau) in enumerate([(8, 12), (5, 40), (20, 3.5)]):
        assert found[k].status == "ok" and abs(found[k].l - l) < 5 * found[k].l_sem and abs(found[k].tau - tau) < 5 * found[k].tau_sem
    assert found[7].status == "poor_fit" and found[7].l is None and found[7].r2 < 0.85
    assert found[8].status == "too_few_points"


def test_mode_path_reaches_the_best_subset():
    draws = np.random.default_rng(2)
    for _ in range(30):
        x = np.exp(-np.linspace(0.1, 30, 60)[:, None] / np.geomspace(0.3, 60, 6))
        y = x @ np.maximum(draws.normal(0, 1, 6), 0) + draws.normal(0, 0.05, 60)
        gram, right = x.T @ x, x.T @ y
        error = lambda a: float(((x @ a - y) ** 2).sum())
        best = math.inf
        for size in range(1, 7):
            for some in itertools.combinations(range(6), size):
                a = np.zeros(6)
                a[list(some)] = np.linalg.lstsq(x[:, some], y, rcond=None)[0]
                if (a >= 0).all():
                    best = min(best, error(a))
        path = fits.mode_path(gram, right, 6)
        assert all((p >= 0).all() for p in path) and min(map(error, path)) <= best * (1 + 1e-6) + 1e-12


def test_assembly_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, calls = 2000, []
    x = np.arange(n) * 3.0
    rows = pd.DataFrame({"frame": 0, "chain_id": np.arange(n), "x": x % 100, "y": 1.0, "z": 2.0, "lx": 100.0, "ly": 100.0, "lz": 120.0})
    draws = np.random.default_rng(3)
    shuffled = draws.permutation(n)
    for name in (np.arange(n), shuffled):
        calls.clear()
        pos = rows.assign(chain_id=name)
        edges = spark.createDataFrame(pd.DataFrame({"frame": 0, "u": name[:-1], "v": name[1:]}))
        label = spark.createDataFrame(pd.DataFrame({"frame": 0, "chain_id": np.arange(n), "label": 0}))
        keep = groups.cut_lineage
        monkeypatch.setattr(groups, "cut_lineage", lambda df: calls.append(1) or keep(df))
        got = groups.unwrapped_groups(label, edges, spark.createDataFrame(pos), ["frame"]).toPandas().set_index("chain_id").loc[name]
        monkeypatch.setattr(groups, "cut_lineage", keep)
        at = got["x"].to_numpy()
        root = int(np.flatnonzero(name == 0)[0])
        assert np.abs(at - (x - x[root] + x[root] % 100)).max() < 1e-6
        assert len(calls) <= (18 if name is not shuffled else 60)


def test_origin_curves_by_brute_force(spark):
    draws = np.random.default_rng(4)
    rows = [(k, t, float(draws.normal())) for k in (0, 1) for t in range(3, 260) if draws.random() < 0.8]
    curves, held = lags.origin_curves(spark.createDataFrame(rows, "k int, t int, x double"), ["k"], "t", [40, 75], 20, 5, ["x"], min_rows=20)
    got = {(r.k, r.length, r.origin, r.lag): r.msd for r in curves.collect()}
    want, windows = {}, set()
    for k in (0, 1):
        series = {t: x for kk, t, x in rows if kk == k}
        first, last = min(series), max(series)
        for length in (40, 75):
            for o in range(first, last - length + 1, 20):
                inside = {t: x for t, x in series.items() if o <= t <= o + length}
                if len(inside) >= 20:
                    windows.add((k, float(length), float(o)))
                    for lag in range(0, length + 1, 5):
                        d = [(inside[t + lag] - inside[t]) ** 2 for t in inside if t + lag in inside]
                        if d:
                            want[k, float(length), float(o), lag] = np.mean(d)
    assert {(r.k, r.length, float(r.origin)) for r in held.collect()} == windows
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)


def test_inefficiency_by_blocks_of_lags(spark):
    draws = np.random.default_rng(5)
    n, rho = 100_000, math.exp(-1 / 10)
    x = np.zeros(n)
    noise = draws.normal(size=n)
    for i in range(1, n):
        x[i] = rho * x[i - 1] + noise[i]
    long = spark.createDataFrame(pd.DataFrame({"k": 0, "n": n, "i": np.arange(n), "value": x}))
    g = blocks.series_inefficiency(long, ["k"], first=16).first()
    c = x - x.mean()
    total, s0 = 0.0, float(c @ c)
    for lag in range(1, n - 1):
        a = float(c[:-lag] @ c[lag:]) / s0
        if lag > 3 and a <= 0:
            break
        total += a
    assert g.g == pytest.approx(1 + 2 * total, rel=1e-9) and 15 < g.g < 25
    short = pd.concat([pd.DataFrame({"k": k, "n": m, "i": np.arange(m), "value": draws.normal(size=m).cumsum() if k % 2 else np.full(m, 2.0)}) for k, m in ((1, 300), (2, 50), (3, 2), (4, 1), (5, 9))])
    pos = spark.createDataFrame(short)
    want = {r.k: r.g for r in blocks.inefficiency(blocks.autocorrelation(pos, ["k"]), ["k"]).collect()}
    assert {r.k: pytest.approx(r.g) for r in blocks.series_inefficiency(pos, ["k"], first=4).collect()} == want


def test_permutations_by_brute_force(spark):
    draws = np.random.default_rng(6)
    label = np.arange(14) % 2
    x = np.column_stack([label + draws.normal(0, 0.4, 14), draws.normal(0, 1, 14)])
    units = spark.createDataFrame([(i, int(label[i]), float(x[i, 0]), float(x[i, 1])) for i in range(14)], "unit int, label int, a double, b double")
    got = {r.permutation: r.accuracy for r in features.permutation_null(units, ["a", "b"], "label", "unit", 9, seed=3, starts=5).collect()}
    dealt = features.shuffled_labels(units, "label", "unit", 9, 3).toPandas()
    assert len(got) == 10 and dealt.groupby("permutation")["label"].sum().eq(7).all() and len({tuple(g.sort_values("unit")["label"]) for _, g in dealt.groupby("permutation")}) > 5
    for k, part in dealt.groupby("permutation"):
        y = part.sort_values("unit")["label"].to_numpy()
        hits = 0
        for h in range(14):
            keep = np.arange(14) != h
            fit = features._fit_two(x[keep], 0, starts=5)
            inside, guess = fit(x[keep]), int(fit(x[[h]])[0])
            guess = 1 - guess if (inside != y[keep]).sum() > (inside == y[keep]).sum() else guess
            hits += guess == y[h]
        assert got[k] == pytest.approx(hits / 14)
    assert (dealt[dealt.permutation == -1].sort_values("unit")["label"].to_numpy() == label).all()


def test_sources_count_in_their_order(spark):
    long = lambda *rows: spark.createDataFrame(rows, "id string, column string, value double")
    master = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("K", 5)], "id string, x int")
    classes = spark.createDataFrame([("a", "K"), ("b", "K"), ("c", "none")], "id string, class_id string")
    first = long(("a", "tc", 1.0), ("a", "SIGtc", 0.1), ("b", "tc", None), ("K", "tc", 9.0), ("K", "SIGtc", 0.9))
    second = long(("a", "tc", 2.0), ("a", "tc", 3.0), ("d", "tc", 4.0), ("d", "tc", 6.0), ("x", "tc", 7.0))
    third = long(("b", "other", 5.0), ("K", "tc", 8.0))
    got = {r.id: tuple(r)[1:] for r in rollups.augmented_master(master, [first, second, third], ["tc", "other"], classes).collect()}
    assert got == {"a": (1, 1.0, 0.1, None, None), "b": (2, 9.0, 0.9, 5.0, 0.0), "c": (3, None, None, None, None), "d": (4, 6.0, 0.0, None, None), "K": (5, 9.0, 0.9, None, None)}


def test_rows_of_many_chains_are_not_broadcast(spark, tmp_path):
    """A small file may hold many rows: neither the pairs of times nor the rows of many groups go through the driver."""
    rows = spark.range(3000).selectExpr("id AS chain", "explode(sequence(0, 11)) AS frame").selectExpr("chain", "frame", "double(frame * (chain % 7)) AS x", "0.0D AS y", "0.0D AS z")
    rows.write.parquet(f"{tmp_path}/rows")
    curve = lags.displacement_curve(spark.read.parquet(f"{tmp_path}/rows"), ["chain"], "frame", F.sequence(F.lit(0), F.lit(10)))
    assert "BroadcastHashJoin" not in curve._jdf.queryExecution().executedPlan().toString()
    groups = spark.range(3000).withColumnRenamed("id", "chain")
    joined = spark.read.parquet(f"{tmp_path}/rows").join(group_side(groups), "chain")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in rows.join(group_side(groups.limit(5)), "chain")._jdf.queryExecution().executedPlan().toString()
