"""Block statistics, lags, joins in time, fits, features and sources by analytic cases."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajstats.functions.stats import t975
from trajstats.operators import asof, binodal, blocks, features, fits, lags, sequences, windows
from trajstats.sources import dumps


def test_student_quantiles():
    assert [t975(1), t975(3), t975(10), t975(100)] == pytest.approx([12.7062047, 3.1824463, 2.2281389, 1.9839715], abs=1e-6)


def series_frame(spark):
    rng = np.random.default_rng(0)
    n = 600
    noise = rng.normal(size=n)
    ar = np.zeros(n)
    for i in range(1, n):
        ar[i] = 0.5 * ar[i - 1] + rng.normal()
    rows = [(k, i, float(v)) for k, xs in (("white", noise), ("ar", ar), ("flat", np.ones(40))) for i, v in enumerate(xs)]
    rows += [("white", 1000, float("nan")), ("white", 1001, float("inf"))]
    return spark.createDataFrame(rows, "key string, idx int, value double")


def test_inefficiency_and_corrected_stats(spark):
    df = series_frame(spark)
    out = {r.key: r for r in blocks.corrected_stats(df.filter("idx < 120 OR idx >= 1000"), ["key"], "idx").collect()}
    assert out["flat"].sem == 0.0 and out["flat"].mean == 1.0 and out["flat"].ci95 == 0.0
    assert out["white"].n == 120
    pos = blocks.positioned(df, ["key"], "idx")
    g = {r.key: r.g for r in blocks.inefficiency(blocks.autocorrelation(pos, ["key"], 60), ["key"]).collect()}
    assert g["white"] == pytest.approx(1.0, abs=0.6)
    assert g["ar"] == pytest.approx(3.0, rel=0.4)  # (1 + phi) / (1 - phi)


def test_equilibration_finds_the_jump(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.linspace(30, 5, 15), rng.normal(size=45)])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "key string, idx int, value double")
    t0 = blocks.equilibration(blocks.positioned(df, ["key"], "idx"), ["key"]).first().t0
    assert 13 <= t0 <= 18


def test_nearest_in_time_ties_and_gaps(spark):
    rng = np.random.default_rng(2)
    frames = sorted(set(rng.integers(0, 400, 40).tolist()) | {2000, 2010})
    steps = sorted(set(rng.integers(0, 2500, 120).tolist()) | {2005, frames[0] - 1, 5000})
    left = spark.createDataFrame([("s", t) for t in steps], "system string, step long")
    right = spark.createDataFrame([("s", t, k) for k, t in enumerate(frames)], "system string, ft long, frame int")
    got = {r.step: r.ft for r in asof.nearest_in_time(left, right, ["system"], "step", "ft", ["frame"], 37).collect()}
    assert got == {t: min(frames, key=lambda f: (abs(f - t), -f)) for t in steps}


def test_msd_of_constant_velocity_and_fft(spark):
    rng = np.random.default_rng(4)
    walk = rng.normal(size=(50, 3)).cumsum(axis=0)
    rows = [("line", t, 2.0 * t, 0.0, 1.0) for t in range(50)] + [("walk", t, *map(float, walk[t])) for t in range(50)]
    df = spark.createDataFrame(rows, "chain string, t int, x double, y double, z double")
    joined = {(r.chain, r.lag): r.msd for r in lags.displacement_curve(df, ["chain"], "t", F.sequence(F.lit(0), F.lit(49))).collect()}
    assert joined[("line", 7)] == pytest.approx(4.0 * 49)
    fft = {(r.chain, r.lag): r.msd for r in lags.displacement_curve_fft(df, ["chain"], "t").collect()}
    assert all(fft[k] == pytest.approx(v, abs=1e-6) for k, v in joined.items())


def test_random_effects_pool_of_equal_units(spark):
    df = spark.createDataFrame([("g", 1.0, 0.5), ("g", 1.0, 0.5), ("h", 3.0, 0.2)], "grp string, v double, s double")
    out = {r.grp: r for r in lags.random_effects_pool(df, ["grp"], "v", "s").collect()}
    assert out["g"].mean == pytest.approx(1.0) and out["g"].sem == pytest.approx(0.5 / math.sqrt(2)) and out["g"].tau2 == 0
    assert out["h"].mean == 3.0 and out["h"].sem == pytest.approx(0.2)


def test_fits_recover_parameters(spark):
    r = np.arange(5, 300, 5.0)
    rho = np.array([300 - 290 * math.erf((x - 120) / (math.sqrt(2) * 15)) for x in r])
    prof = spark.createDataFrame(pd.DataFrame({"k": 1, "r_mid": r, "density": rho, "sem": 1.0}))
    for start in ("fixed", "data"):
        f = fits.interface_fit(prof, ["k"], start=start).first()
        assert [f.a, f.b, f.r_fit, f.w_fit] == pytest.approx([290, 300, 120, 15], rel=1e-3)
    t = np.arange(0, 200.0)
    c = fits.confined_fit(spark.createDataFrame(pd.DataFrame({"k": 1, "lag": t, "msd": 64 * (1 - np.exp(-t / 12))})), ["k"]).first()
    assert [c.l, c.tau] == pytest.approx([8, 12], rel=1e-3)
    acf = 4 * (0.7 * np.exp(-t / 5) + 0.3 * np.exp(-t / 40))
    m = fits.maxwell_fit(spark.createDataFrame(pd.DataFrame({"k": 1, "lag": t, "acf": acf})), ["k"], max_modes=3).first()
    assert m.modes >= 2 and m.amplitude_tau == pytest.approx(0.7 * 5 + 0.3 * 40, rel=0.05)


def test_binodal_recovers_parameters(spark):
    rows = []
    for t in (285, 290, 295, 300, 305, 310, 315):
        x = 330.0 - t
        rows.append(("a", float(t), 200 + 3 * x + 80 * x**0.325, 200 + 3 * x - 80 * x**0.325, 1.0, 1.0))
    df = spark.createDataFrame(rows, "k string, temperature_k double, c_sg double, c_dil_inf double, c_sg_sd double, c_dil_inf_sd double")
    f = binodal.binodal_fit(df, ["k"]).first()
    assert [f.tc, f.c_c, f.a, f.b] == pytest.approx([330, 200, 160, 3], rel=2e-3) and f.at_bound == "inside"
    two = binodal.two_step_fit(df, ["k"]).first()
    assert two.tc == pytest.approx(330, rel=2e-3) and two.a == pytest.approx(160, rel=1e-2)


def test_features_on_planted_groups(spark):
    rng = np.random.default_rng(6)
    y = np.repeat([0, 1], 12)
    pdf = pd.DataFrame({"unit": range(24), "label": y, "good": y * 6 + rng.normal(size=24), "also": -y * 5 + rng.normal(size=24), "noise": rng.normal(size=24), "flat": 1.0})
    df = spark.createDataFrame(pdf)
    ranked = [r.feature for r in features.ranked_features(df, ["noise", "good", "also", "flat"], "label").orderBy("rank").collect()]
    assert set(ranked[:2]) == {"good", "also"} and ranked[3] == "flat"
    clustered = features.cluster_two(df, ["good", "also"], seeds=(0, 1))
    assert features.confusion(clustered, []).first().accuracy == 1.0
    loo = features.leave_one_out(df, ["good", "also"], "label", "unit").toPandas()
    assert len(loo) == 24 and loo.correct.all()
    p = features.permutation_p_value(features.permutation_null(df, ["good", "also"], "label", "unit", 12)).first()
    assert p.observed == 1.0 and p.p_value == pytest.approx(1 / 13)
    s = features.silhouette(df, "unit", ["good", "also"], "label", tile_rows=5).toPandas()
    assert len(s) == 24 and s.s.mean() > 0.6


def _rows_of_python(df):
    """Rows that a query's Python steps gave, read from its plan after it ran."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            found += node.metrics().apply("pythonNumRowsReceived").value() if node.metrics().contains("pythonNumRowsReceived") else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_silhouette_sends_rows_in_proportion_to_points(spark):
    """Sums of distances against plain ones; twice the points give twice the rows, not four times, and copies none."""
    rng = np.random.default_rng(11)
    sent = []
    for n in (100, 200):
        x, y = rng.normal(size=(n, 2)), rng.integers(0, 3, n)
        pdf = pd.DataFrame({"unit": range(n), "label": [f"c{v}" for v in y], "f": x[:, 0], "g": x[:, 1]})
        pdf = pd.concat([pdf, pdf.iloc[: n // 2].assign(unit=lambda t: t.unit + n)], ignore_index=True)
        out = features.silhouette(spark.createDataFrame(pdf), "unit", ["f", "g"], "label", tile_rows=4)
        sent.append(_rows_of_python(out))
        z, lab = pdf[["f", "g"]].to_numpy(), pdf.label.to_numpy()
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
        to = {c: d[:, lab == c] for c in np.unique(lab)}
        a = np.array([to[c][i].sum() / (to[c].shape[1] - 1) for i, c in enumerate(lab)])
        b = np.array([min(to[o][i].mean() for o in to if o != c) for i, c in enumerate(lab)])
        got = out.toPandas().set_index("unit").s.loc[pdf.unit].to_numpy()
        assert got == pytest.approx((b - a) / np.maximum(a, b), abs=1e-12)
    # At most one row for a point, a cluster and a block.
    assert 0 < sent[0] <= 100 * 3 * 16 and sent[0] < sent[1] <= 200 * 3 * 16


def test_windows_reflection_and_intervals(spark):
    df = spark.createDataFrame([("a", i, float(i == 0)) for i in range(30)], "k string, i int, y double")
    out = windows.smoothed(df, ["k"], "i", "y", 2.0).toPandas().sort_values("i")
    w = dict(windows.gaussian_weights(2.0))
    want = np.array([w.get(i, 0.0) for i in range(30)])
    assert out.y.to_numpy() == pytest.approx(want[: len(out)] / want.sum())
    iv = spark.createDataFrame([("a", 3, 5), ("a", 6, 8), ("a", 12, 15)], "k string, start long, end long")
    length = spark.createDataFrame([("a", 20)], "k string, n long")
    gaps = windows.interval_complement(iv, length, ["k"], "n").collect()
    assert sorted((r.start, r.end) for r in gaps) == [(1, 2), (9, 11), (16, 20)]
    # Buckets smaller than the intervals: islands run across several of them.
    long = iv.unionByName(spark.createDataFrame([("a", 14, 17)], "k string, start long, end long"))
    assert sorted((r.start, r.end) for r in windows.merged_intervals(long, ["k"], bucket=2).collect()) == [(3, 8), (12, 17)]
    assert sorted((r.start, r.end) for r in windows.interval_complement(long, length, ["k"], "n", bucket=2).collect()) == [(1, 2), (9, 11), (18, 20)]


def test_dump_readers(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(os.path.join(folder, "a.dump"), "w") as f:
        for step in (0, 10000, 20000):
            f.write(f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n2\n")
            for atom in (1, 2):
                f.write(" ".join([str(atom), "x", "1", "2", "3", "4", *[str(step + atom + k) for k in range(6)], "0", "0", "0", "0"]) + "\n")
    rows = dumps.stress_rows(dumps.read_frames(spark, folder)).collect()
    assert len(rows) == 6 and {r.step for r in rows} == {0, 10000, 20000}
    assert next(r for r in rows if r.step == 10000 and r.atom == 2).pyz == 10007.0
    with open(os.path.join(folder, "b.txt"), "w") as f:
        f.write("".join(f"time {t}\n" + "".join(f"{i} {t * 10 + i}\n" for i in range(50)) for t in range(40)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        lines = dumps.read_lines(spark, os.path.join(folder, "b.txt"))
        assert lines.select("split").distinct().count() > 3  # frames cross split borders
        out = dumps.framed_rows(lines, F.col("value").startswith("time"), ["i", "v"], ["int", "int"], F.regexp_extract("value", r"time (\d+)", 1).try_cast("int")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(out) == 2000 and all(r.v == r.time * 10 + r.i for r in out)


def test_sequence_counts(spark):
    seqs = spark.createDataFrame([("rna", True, "AUUCCCGGGG"), ("p", False, "MKKA")], "m string, rna boolean, seq string")
    out = {(r.m, r.letter): r["count"] for r in sequences.composition(seqs, ["m"], "seq", "rna").collect()}
    assert len(out) == 24 and {k[1] for k in out if k[0] == "rna"} == set("AUCG")
    assert [out[("rna", c)] for c in "AUCG"] == [1, 2, 3, 4] and out[("p", "K")] == 2 and out[("p", "W")] == 0
    b = {(r.a, r.b): r["count"] for r in sequences.bonds(seqs.filter("NOT rna"), [], "seq", F.lit(2), F.lit(1)).collect()}
    assert b == {("K", "M"): 2, ("K", "K"): 1, ("A", "K"): 2}


def test_block_means_by_running_sums(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    pos = blocks.positioned(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "key string, idx int, value double"), ["key"], "idx")
    few = {(r.b, r.offset, r.block): r.block_mean for r in blocks.block_means(pos, ["key"], 9).collect()}
    want = {(b, o, k): x[o + k * b : o + (k + 1) * b].mean() for b in range(1, 10) for o in range(b) for k in range((300 - o) // b)}
    assert few.keys() == want.keys() and all(math.isclose(few[k], want[k], abs_tol=1e-10) for k in want)
    got = blocks.sized_block_means(pos, ["key"], F.sequence(F.lit(1), F.expr("n div 4"))).groupBy("b", "offset").agg(F.count("block_mean").alias("n"), F.stddev_samp("block_mean").alias("sd")).collect()
    assert len(got) == sum(range(1, 76))
    for r in got[::97]:
        means = x[r.offset : r.offset + (300 - r.offset) // r.b * r.b].reshape(-1, r.b).mean(1)
        assert r.n == len(means) and math.isclose(r.sd, means.std(ddof=1), abs_tol=1e-9)


def test_maxwell_query_tries_all_modes(spark, monkeypatch):
    from trajstats.operators import fits
    from trajstats.plans import QUERIES

    def short(acf, keys, **given):
        return given

    monkeypatch.setattr(fits, "maxwell_fit", short)
    assert QUERIES["maxwell_fit"].plan(spark, "/root/testdata/sf0.001") == {"points": 1000, "max_modes": 10}
