"""Model fits, one per group, over many groups, as plans.

Interface and confinement curves are fitted by ``separable``. A sum of exponentials is fitted by non-negative least squares on a log
grid of times: Spark sums the products of the exponentials, and the active-set loop sees one small matrix for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trajstats.operators import separable
from trajstats.session import cut_lineage, group_side


def interface_fit(profiles: DataFrame, keys: Sequence[str], r: str = "r_mid", density: str = "density", sem: str = "sem", *, start: str = "fixed", normalised: bool = False) -> DataFrame:
    """rho = B - A erf((r-R)/(sqrt(2) W)) per group; the first bin is left out.

    A fit weighted by the SEMs (floored against vanishing tails), with A and B not below 0 unless ``start='data'``, and an unweighted
    one are done together; the unweighted one counts where its errors are finite. R lies inside the profile and W
    between a quarter of a bin and twice the profile. ``normalised`` divides by the largest density.
    """
    keys = list(keys)
    rows = profiles.filter(F.col(r).isNotNull() & F.col(density).isNotNull()).select(*keys, F.col(r).cast("double").alias("x"), F.col(density).cast("double").alias("y"), F.col(sem).cast("double").alias("s"))
    first = rows.groupBy(*keys).agg(F.min("x").alias("_first"))
    rows = cut_lineage(rows.join(first, keys).filter("x > _first").drop("_first"))
    top = F.max(F.abs("y"))
    weigh = F.lit(not normalised) & (F.count(F.when(F.col("s") > 0, 1)) == F.count(F.lit(1)))
    about = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_a"), F.max("x").alias("_b"), (F.when(top > 0, top).otherwise(1.0) if normalised else F.lit(1.0)).alias("_scale"),
        weigh.alias("_weighted"), F.greatest(F.lit(1e-3) * F.coalesce(F.max("s"), F.lit(0.0)), F.lit(1e-3) * top).alias("_floor"))
    about = cut_lineage(about)
    used = rows.join(about.filter("_n >= 5"), keys).withColumn("kind", F.explode(F.array(F.lit("bounded"), F.lit("unweighted"))))
    w = F.when((F.col("kind") == "bounded") & F.col("_weighted"), F.pow(F.greatest("s", "_floor"), F.lit(-2.0))).otherwise(1.0)
    used = used.select(*keys, "kind", "x", (F.col("y") / F.col("_scale")).alias("y"), w.alias("w"))
    span = F.col("_b") - F.col("_a")
    domain = about.filter("_n >= 5").withColumn("kind", F.explode(F.array(F.lit("bounded"), F.lit("unweighted")))).select(
        *keys, "kind", ((F.col("kind") == "bounded") & F.lit(start != "data")).alias("_positive"), F.col("_a").alias("_lo_r_fit"), F.col("_b").alias("_hi_r_fit"),
        F.log(span / (4 * F.col("_n"))).alias("_lo_w_fit"), F.log(2 * span).alias("_hi_w_fit"))
    found = separable.separable_fit(used, [*keys, "kind"], separable.INTERFACE, domain)
    unit = F.col("sse") / F.greatest(F.col("n") - 4, F.lit(1))
    error = lambda c: F.when(F.col(c) * unit >= 0, F.sqrt(F.col(c) * unit))
    found = found.select(*keys, "kind", "a", "b", "r_fit", "w_fit", error("c11").alias("se_a"), error("c00").alias("se_b"), error("c22").alias("se_r"), error("c33").alias("se_w"), (F.col("c01") * unit).alias("cov_ab"), F.sqrt(F.col("plain") / F.col("n")).alias("rmse"))
    finite_errors = F.col("se_a").isNotNull() & F.col("se_b").isNotNull() & F.col("se_r").isNotNull() & F.col("se_w").isNotNull()
    rank = F.when((F.col("kind") == "unweighted") & finite_errors, 2).when(F.col("kind") == "bounded", 1).otherwise(0)
    names = ["a", "b", "r_fit", "w_fit", "se_a", "se_b", "se_r", "se_w", "cov_ab", "rmse"]
    best = found.groupBy(*keys).agg(F.max_by(F.struct("kind", *names), rank).alias("f")).select(*keys, "f.*")
    status = F.when(F.coalesce(F.col("_n"), F.lit(0)) < 5, "too_few_points").when(F.col("kind").isNull(), "failed").when((F.col("kind") == "bounded") & F.col("_weighted"), "weighted").otherwise(F.col("kind"))
    return profiles.select(*keys).distinct().join(about, keys, "left").join(best, keys, "left").select(*keys, *names, status.alias("status"))


def confined_fit(curves: DataFrame, keys: Sequence[str], t: str = "lag", y: str = "msd", *, skip: float = 5.0, r2_min: float = 0.85, min_points: int = 15) -> DataFrame:
    """msd = l^2 (1 - exp(-t/tau)) per group; NULL results below the R^2 gate. tau lies between 1 and 5 times the last lag."""
    keys = list(keys)
    rows = cut_lineage(curves.filter((F.col(t) > skip) & (F.col(y) > 0)).select(*keys, F.col(t).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w")))
    about = cut_lineage(curves.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("x").alias("_b"), (F.var_pop("y") * F.count(F.lit(1))).alias("_ss")), keys, "left"))
    enough = about.filter(F.col("_n") >= min_points)
    domain = enough.select(*keys, F.lit(True).alias("_positive"), F.lit(0.0).alias("_lo_tau"), F.log(F.greatest(5 * F.col("_b"), F.lit(2.0))).alias("_hi_tau"))
    found = separable.separable_fit(rows.join(group_side(enough.select(*keys)), keys), keys, separable.CONFINED, domain)
    r2 = 1 - F.col("sse") / F.greatest(F.col("_ss"), F.lit(1e-300))
    unit = F.col("sse") / F.greatest(F.col("n") - 2, F.lit(1))
    status = F.when(F.coalesce(F.col("_n"), F.lit(0)) < min_points, "too_few_points").when(F.coalesce(F.col("l2"), F.lit(0.0)) <= 0, "failed").when(r2 < r2_min, "poor_fit").otherwise("ok")
    out = about.join(group_side(cut_lineage(found)), keys, "left").withColumn("status", status)
    ok = F.col("status") == "ok"
    return out.select(
        *keys, F.when(ok, F.sqrt("l2")).alias("l"), F.when(ok, F.sqrt(F.greatest(F.col("c00") * unit, F.lit(0.0))) / (2 * F.sqrt("l2"))).alias("l_sem"), F.when(ok, F.col("tau")).alias("tau"),
        F.when(ok, F.sqrt(F.greatest(F.col("c11") * unit, F.lit(0.0)))).alias("tau_sem"), F.when(F.col("status").isin("ok", "poor_fit"), r2).alias("r2"), "status")


def per_chain_summary(fits: DataFrame, keys: Sequence[str], min_chains: int = 5) -> DataFrame:
    """Mean and median of per-chain fits, reported only where enough chains fit."""
    ok = F.count("l") >= min_chains
    return fits.groupBy(*keys).agg(
        F.count("l").alias("n_fit"), F.count(F.lit(1)).alias("n_chains"), F.when(ok, F.avg("l")).alias("l_mean"), F.when(ok, F.median("l")).alias("l_median"),
        F.when(ok, F.avg("tau")).alias("tau_mean"), F.when(ok, F.median("tau")).alias("tau_median"),
    )


def mode_path(gram: np.ndarray, right: np.ndarray, max_modes: int) -> list[np.ndarray]:
    """Non-negative least squares by an active set that grows by one column at a time: the amplitudes after each column, at most ``max_modes`` active.

    Works on the Gram matrix alone. The last entry is the optimum wherever it has at most ``max_modes`` columns.
    """
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g, v = gram / np.outer(scale, scale), right / scale
    x, active, path = np.zeros(len(v)), [], []
    for _ in range(6 * max_modes):
        slope = v - g @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-10 * max(1e-300, np.abs(v).max()) or len(active) == max_modes:
            break
        active.append(best)
        while True:
            part = np.linalg.lstsq(g[np.ix_(active, active)], v[active], rcond=1e-13)[0]
            if (part > 0).all() or not active:
                break
            now = x[active]
            down = part <= 0
            step = min((now[down] / np.maximum(now[down] - part[down], 1e-300)).min(), 1.0)
            x[active] = now + step * (part - now)
            gone = [a for a, p in zip(active, part) if p <= 0 and x[a] <= 1e-12]
            gone = gone or [min((a for a, p in zip(active, part) if p <= 0), key=lambda a: x[a])]
            active = [a for a in active if a not in gone]
            x[gone] = 0.0
        x = np.zeros(len(v))
        x[active] = part
        path.append(x / scale)
        if gone_back(path):
            break
    return path


def gone_back(path: list[np.ndarray]) -> bool:
    """Whether the last step returned to a set of columns that was there before: rounding has been reached."""
    sets = [tuple(np.flatnonzero(p)) for p in path]
    return sets[-1] in sets[:-1]


def merged_modes(amplitudes: np.ndarray, taus: np.ndarray) -> tuple[list[float], list[float]]:
    """One mode for each run of neighbouring active times of a grid: the sum of amplitudes at their mean time, which keeps the sum of amplitude x time."""
    active = np.flatnonzero(amplitudes > 0)
    sets = np.split(active, np.flatnonzero(np.diff(active) > 1) + 1) if len(active) else []
    total = [float(amplitudes[k].sum()) for k in sets]
    return total, [float((amplitudes[k] * taus[k]).sum() / a) for k, a in zip(sets, total)]


def _tau_grid(low: float, high: float, candidates: int) -> np.ndarray:
    return np.geomspace(low, high, candidates)


def _gram_sums(keys: Sequence[str], candidates: int) -> Callable:
    """Sums of products of the exponentials for each group of a task, flushed by Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for key, part in pdf.groupby(list(keys), dropna=False, sort=False):
                x = np.exp(-part["x"].to_numpy()[:, None] / _tau_grid(part["_a"].iloc[0], part["_b"].iloc[0], candidates))
                sums = np.concatenate([(x.T @ x).ravel(), x.T @ part["y"].to_numpy()])
                head = part.iloc[:1]
                yield pa.RecordBatch.from_arrays([pa.array(head[k], batch.schema.field(k).type) for k in (*keys, "_a", "_b", "_v0")] + [pa.array([sums.tolist()], pa.list_(pa.float64()))], [*keys, "_a", "_b", "_v0", "sums"])

    return run


def maxwell_fit(curves: DataFrame, keys: Sequence[str], t: str = "lag", y: str = "acf", *, points: int = 200, max_modes: int = 10, candidates: int = 40) -> DataFrame:
    """Sum of 1..max_modes exponentials to the normalised correlation at ``points`` log-spaced times; best mean absolute error.

    Relaxation times come from a log grid of ``candidates`` between the first and the last time. Products of the exponentials are summed
    for each group over all tasks; amplitudes follow from these sums by an active-set loop, one mode more at a time. Of the unlimited solution
    neighbouring times count as one mode between them.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("x")
    rows = curves.filter(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(t).cast("double").alias("x"), F.col(y).cast("double").alias("v"))
    about = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("x") > 0, F.col("x"))).alias("_a"), F.max("x").alias("_b"), F.min_by("v", "x").alias("_v0"))
    about = cut_lineage(about)
    good = (F.col("_n") >= 3) & (F.col("_v0") != 0) & (F.col("_a") < F.col("_b"))
    # Each piece between neighbouring times carries the log-spaced times inside it.
    pieces = rows.withColumns({"_x1": F.lead("x").over(order), "_v1": F.lead("v").over(order)}).filter("_x1 IS NOT NULL AND _x1 > 0").join(about.filter(good), keys)
    h = F.log(F.col("_b") / F.col("_a")) / (points - 1)
    place = lambda c: F.log(F.greatest(c, F.col("_a")) / F.col("_a")) / h
    first, last = F.ceil(place(F.col("x")) - 1e-9), F.when(F.col("_x1") == F.col("_b"), F.lit(points - 1)).otherwise(F.ceil(place(F.col("_x1")) - 1e-9) - 1)
    grid = pieces.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("_a") * F.exp(F.col("_k") * h)
    target = (F.col("v") + (F.col("_v1") - F.col("v")) * (at - F.col("x")) / (F.col("_x1") - F.col("x"))) / F.col("_v0")
    grid = cut_lineage(grid.select(*keys, "_a", "_b", "_v0", at.alias("x"), target.alias("y")))
    kinds = ", ".join(f"{k} {grid.schema[k].dataType.simpleString()}" for k in keys)
    sums = grid.mapInArrow(_gram_sums(keys, candidates), f"{kinds}, _a double, _b double, _v0 double, sums array<double>")
    size = candidates * (candidates + 1)
    total = sums.select(*keys, "_a", "_b", "_v0", F.posexplode("sums").alias("_i", "_s")).groupBy(*keys, "_a", "_b", "_v0", "_i").agg(F.sum("_s").alias("_s"))
    total = total.groupBy(*keys, "_a", "_b", "_v0").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda e: e["_s"]).alias("sums"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                flat = np.array(one.column("sums")[0].as_py())
                taus = _tau_grid(one.column("_a")[0].as_py(), one.column("_b")[0].as_py(), candidates)
                gram, right = flat[: size - candidates].reshape(candidates, candidates), flat[size - candidates :]
                out = [(int((x > 0).sum()), x[x > 0].tolist(), taus[x > 0].tolist()) for x in mode_path(gram, right, max_modes) if (x > 0).any()]
                # A time between two of the grid takes both; merged they are one mode.
                for whole in mode_path(gram, right, candidates)[-1:]:
                    amplitudes, times = merged_modes(whole, taus)
                    if 0 < len(times) <= max_modes:
                        out.append((len(times), amplitudes, times))
                if out:
                    cols = [pa.concat_arrays([one.column(k)] * len(out)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))))], [*keys, "modes", "amplitudes", "taus"])

    tried = cut_lineage(total.mapInArrow(paths, f"{kinds}, modes int, amplitudes array<double>, taus array<double>").dropDuplicates([*keys, "taus"]))
    model = F.aggregate(F.arrays_zip("amplitudes", "taus"), F.lit(0.0), lambda s, m: s + m["amplitudes"] * F.exp(-F.col("x") / m["taus"]))
    errors = grid.select(*keys, "x", "y").join(tried, keys).groupBy(*keys, "modes", "amplitudes", "taus").agg(F.avg(F.abs(model - F.col("y"))).alias("mae"))
    best = errors.groupBy(*keys).agg(F.min_by(F.struct("modes", "mae", "amplitudes", "taus"), F.struct("mae", "modes")).alias("f")).select(*keys, "f.*")
    weight = F.aggregate(F.arrays_zip("amplitudes", "taus"), F.lit(0.0), lambda s, m: s + m["amplitudes"] * m["taus"])
    status = F.when(~F.coalesce(good, F.lit(False)), "too_few_points").when(F.col("modes").isNull(), "failed").otherwise("ok")
    return about.join(best, keys, "left").select(*keys, "modes", weight.alias("amplitude_tau"), F.when(status != "too_few_points", F.col("_v0")).alias("acf0"), "mae", "amplitudes", "taus", status.alias("status"))
