"""Lag statistics: displacement curves, stress correlation, confinement, resampling, pooling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajstats.functions.draws import normal, uniform
from trajstats.functions.scalars import GREEN_KUBO_BOLTZMANN
from trajstats.functions.stats import quadrature, sem
from trajstats.operators import windows
from trajstats.session import cut_lineage


def comoving(com: DataFrame, keys: Sequence[str], t: str, pos: Sequence[str] = ("x", "y", "z"), members: Column | None = None) -> DataFrame:
    """Positions relative to the mean position of the frame (of the ``members``, if given)."""
    picked = [F.when(members, F.col(p)) if members is not None else F.col(p) for p in pos]
    centre = com.groupBy(*keys, t).agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate(picked)])
    joined = com.join(centre, [*keys, t])
    return joined.withColumns({p: F.col(p) - F.col(f"_m{k}") for k, p in enumerate(pos)}).drop(*[f"_m{k}" for k in range(len(pos))])


def displacement_curve(series: DataFrame, keys: Sequence[str], t: str, lags: Column, pos: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(keys, lag, msd, n): mean squared displacement over all pairs t, t + lag.

    Each lag is an equi-join on the time, spread over (keys, t), followed by a partial
    aggregation; ``lags`` is an array column.
    """
    start = series.withColumn("lag", F.explode(lags)).select(*keys, "lag", (F.col(t) + F.col("lag")).alias(t), *[F.col(p).alias(f"_{p}") for p in pos])
    d2 = sum(((F.col(p) - F.col(f"_{p}")) ** 2 for p in pos), F.lit(0.0))
    # Both sides have all rows; their size is not that of the files they come from, so neither may be broadcast.
    return start.join(series.select(*keys, t, *pos).hint("merge"), [*keys, t]).groupBy(*keys, "lag").agg(F.avg(d2).alias("msd"), F.count(F.lit(1)).alias("n"))


def displacement_curve_fft(series: DataFrame, keys: Sequence[str], t: str, pos: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The same at every lag by FFT, one evenly spaced trajectory of one chain per group."""
    schema = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys) + ", lag long, msd double, n long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(t)[list(pos)].to_numpy(float)
        n = len(x)
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(x, n=size, axis=0)
        cross = np.fft.irfft((f * f.conj()).real, n=size, axis=0)[:n].sum(axis=1)
        square = (x * x).sum(axis=1)
        head, tail = np.cumsum(square), np.cumsum(square[::-1])
        pairs = n - np.arange(n)
        # Squares of the first and of the last n - lag points.
        msd = np.maximum((head[pairs - 1] + tail[pairs - 1] - 2 * cross) / pairs, 0.0)
        msd[0] = 0.0
        out = pd.DataFrame({"lag": np.arange(n), "msd": msd, "n": pairs})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "lag", "msd", "n"]]

    return series.select(*keys, t, *pos).groupBy(*keys).applyInPandas(one, schema)


def stress_correlation(segments: DataFrame, keys: Sequence[str], components: Sequence[str] = ("pxy", "pxz", "pyz"), kernel: str = "block") -> DataFrame:
    """(keys, segment, lag, acf) for lags below half the segment, averaged over components.

    ``block``: product of adjacent means over blocks of the lag length. ``plain``: product
    of samples a lag apart. Needs ``segment`` and the position ``pos`` in it.
    """
    group = [*keys, "segment"]
    width = segments.groupBy(*group).agg((F.max("pos") + 1).alias("_w"))
    rows = segments.join(width, group)
    zero = rows.groupBy(*group).agg(*[F.avg(F.col(c) * F.col(c)).alias(c) for c in components]).withColumn("lag", F.lit(0))
    lagged = rows.filter("_w div 2 > 1").withColumn("lag", F.explode(F.sequence(F.lit(1), F.expr("cast(_w div 2 as int) - 1"))))
    if kernel == "block":
        means = lagged.withColumn("b", F.expr("pos div lag")).filter("b < _w div lag").groupBy(*group, "lag", "b").agg(*[F.avg(c).alias(c) for c in components])
        key = [*group, "lag", "b"]
        after = means.select(*group, "lag", (F.col("b") - 1).alias("b"), *[F.col(c).alias(f"_{c}") for c in components])
    else:
        means = lagged.withColumn("b", F.col("pos"))
        key = [*group, "b"]
        means = means.select(*group, "lag", (F.col("pos") + F.col("lag")).alias("b"), *components)
        after = rows.select(*group, F.col("pos").alias("b"), *[F.col(c).alias(f"_{c}") for c in components])
    products = means.join(after, key).groupBy(*group, "lag").agg(*[F.avg(F.col(c) * F.col(f"_{c}")).alias(c) for c in components])
    mean = sum((F.col(c) for c in components), F.lit(0.0)) / len(components)
    return zero.select(*group, "lag", *components).unionByName(products).select(*group, "lag", mean.alias("acf"))


def green_kubo(acf: DataFrame, keys: Sequence[str], volume_m3: Column, temp_k: Column, dt_s: float) -> DataFrame:
    """Running viscosity integral: dt * V / kT times the trapezoid of the correlation."""
    factor = F.lit(dt_s) * volume_m3 / (F.lit(GREEN_KUBO_BOLTZMANN) * temp_k)
    return windows.cumulative_trapezoid(acf.withColumn("acf", F.col("acf") * factor), keys, "lag", "acf", "eta")


# --- resampling ------------------------------------------------------------------------

def resample_weights(units: DataFrame, keys: Sequence[str], n_boot: int, seed: int, index: str = "i", n: str = "n") -> DataFrame:
    """(keys, replicate, index, weight): how often each unit is drawn with replacement.

    Draws are hashed from (seed, replicate, slot), so they do not depend on partitioning.
    """
    slots = units.select(*keys, F.col(index).alias("slot"), n).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    drawn = F.floor(uniform(F.lit(seed), F.col("replicate"), F.col("slot")) * F.col(n)).cast("long")
    return slots.groupBy(*keys, "replicate", drawn.alias(index)).agg(F.count(F.lit(1)).alias("weight"))


def bootstrap_means(units: DataFrame, keys: Sequence[str], value: str, n_boot: int, seed: int = 0, index: str = "i", n: str = "n") -> DataFrame:
    """(keys, replicate, mean) of resampled units; units carry their index and number per key."""
    weights = resample_weights(units, keys, n_boot, seed, index, n)
    joined = weights.join(units.select(*keys, F.col(index).cast("long").alias(index), value), [*keys, index])
    return joined.groupBy(*keys, "replicate").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("mean"))


def bootstrap_curves(curves: DataFrame, keys: Sequence[str], unit: str, x: str, y: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(keys, replicate, x, y): mean curve of resampled members."""
    w = W.partitionBy(*keys)
    members = curves.select(*keys, unit).distinct().withColumn("i", (F.row_number().over(w.orderBy(unit)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    weights = resample_weights(members, keys, n_boot, seed).join(members.select(*keys, "i", unit), [*keys, "i"])
    joined = weights.join(curves, [*keys, unit])
    return joined.groupBy(*keys, "replicate", x).agg((F.sum(F.col("weight") * F.col(y)) / F.sum("weight")).alias(y))


def truncated_normal(mean: Column, sd: Column, lower: float, *labels: Column) -> Column:
    """Normal draw cut at ``lower``; the mean itself where sd is missing or 0."""
    draw = F.when(sd > 0, mean + sd * normal(*labels)).otherwise(mean)
    return F.greatest(draw, F.lit(lower))


# --- pooling ---------------------------------------------------------------------------

def random_effects_pool(units: DataFrame, keys: Sequence[str], value: str, own_sem: str) -> DataFrame:
    """DerSimonian-Laird pooled mean, SEM and between-unit variance; k counts usable units."""
    usable = units.filter(F.col(value).isNotNull() & (F.col(own_sem) > 0)).withColumn("_v", F.col(value)).withColumn("_s2", F.col(own_sem) ** 2)
    w = 1 / F.col("_s2")
    fixed = usable.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), (F.sum(w * F.col("_v")) / F.sum(w)).alias("_mu"), F.count(F.lit(1)).alias("k"))
    with_mu = usable.join(fixed, list(keys))
    q = with_mu.groupBy(*keys).agg(F.sum(w * (F.col("_v") - F.col("_mu")) ** 2).alias("_q"), F.max("_w").alias("_w"), F.max("_w2").alias("_w2"), F.max("k").alias("k"))
    c = F.col("_w") - F.col("_w2") / F.col("_w")
    tau2 = q.select(*keys, "k", F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), F.try_divide(F.col("_q") - (F.col("k") - 1), c))).otherwise(0.0).alias("tau2"))
    ws = 1 / (F.col("_s2") + F.col("tau2"))
    pooled = usable.join(tau2, list(keys))
    return pooled.groupBy(*keys).agg((F.sum(ws * F.col("_v")) / F.sum(ws)).alias("mean"), F.try_divide(F.lit(1.0), F.sqrt(F.sum(ws))).alias("sem"), F.max("tau2").alias("tau2"), F.max("k").alias("k"))


# --- confinement -----------------------------------------------------------------------

def plateau(curve: DataFrame, keys: Sequence[str], t: str = "lag", y: str = "msd", *, skip: float = 5.0, first: float = 0.30, last: float = 0.85,
            cv_max: float = 0.20, min_points: int = 30, min_plateau: int = 20) -> DataFrame:
    """Confinement length from the median of the curve between 30 % and 85 % of its span.

    A key appears only if enough points are there and their variation is below ``cv_max``.
    """
    used = curve.filter((F.col(t) > skip) & (F.col(y) > 0))
    span = used.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    lo, hi = F.col("_a") + first * (F.col("_b") - F.col("_a")), F.col("_a") + last * (F.col("_b") - F.col("_a"))
    inside = used.join(span, list(keys)).filter((F.col(t) >= lo) & (F.col(t) <= hi))
    v = F.col(y)
    stats = inside.groupBy(*keys).agg(F.median(v).alias("l_sq"), F.stddev_samp(v).alias("plateau_sd"), F.count(v).alias("n_plateau"))
    stats = stats.withColumn("plateau_cv", F.try_divide("plateau_sd", "l_sq")).filter((F.col("n_plateau") >= min_plateau) & (F.col("plateau_cv") <= cv_max))
    stats = stats.withColumn("l", F.sqrt("l_sq")).withColumn("l_sem", F.col("plateau_sd") / F.sqrt("n_plateau") / (2 * F.col("l")))
    onset = used.join(stats.select(*keys, "l_sq"), list(keys)).filter(v >= 0.9 * F.col("l_sq")).groupBy(*keys).agg(F.min(t).alias("plateau_start"))
    return stats.join(onset, list(keys), "left")


def confinement(curve: DataFrame, keys: Sequence[str], t: str = "lag", y: str = "msd", *, threshold: float = 0.6321, **options) -> DataFrame:
    """Two stages: length l from the plateau, time tau where the curve crosses 63.21 % of l^2, D = l^2/(6 tau).

    The error of tau is the plateau noise over the local slope (three points either side).
    """
    flat = plateau(curve, keys, t, y, **options)
    joined = curve.select(*keys, F.col(t).alias("t"), F.col(y).alias("y")).join(flat.select(*keys, "l_sq", "plateau_sd"), list(keys)).withColumn("level", threshold * F.col("l_sq"))
    order = W.partitionBy(*keys).orderBy("t")
    near = order.rowsBetween(-3, 3)
    local = joined.withColumn("slope", F.when(F.count("t").over(near) >= 4, F.regr_slope(F.col("y"), F.col("t")).over(near)))
    local = local.withColumn("_t0", F.lag("t").over(order)).withColumn("_y0", F.lag("y").over(order)).filter("y >= level")
    at = F.when(F.col("_y0") < F.col("level"), F.col("_t0") + (F.col("level") - F.col("_y0")) / (F.col("y") - F.col("_y0")) * (F.col("t") - F.col("_t0"))).otherwise(F.col("t"))
    first = local.groupBy(*keys).agg(F.min_by(F.struct(at.alias("tau"), F.when((F.col("slope") > 0) & (F.col("plateau_sd") > 0), F.col("plateau_sd") / F.col("slope")).alias("tau_sem")), "t").alias("_f"))
    out = flat.join(first.select(*keys, F.col("_f.tau").cast("double").alias("tau"), F.col("_f.tau_sem").alias("tau_sem")), list(keys), "left")
    d = F.when(F.col("tau") > 0, F.col("l_sq") / (6 * F.col("tau")))
    rel = quadrature(2 * F.col("l_sem") / F.col("l"), F.col("tau_sem") / F.col("tau"))
    return out.withColumn("d", d).withColumn("d_sem", F.col("d") * rel)


def linearised_tau(curve: DataFrame, flat: DataFrame, keys: Sequence[str], t: str = "lag", y: str = "msd", *, skip: float = 5.0, max_share: float = 0.9, min_points: int = 10) -> DataFrame:
    """tau = -1/slope of ln(1 - msd/l^2) against t below the plateau, with its error and R^2."""
    joined = curve.join(flat.select(*keys, "l_sq"), list(keys)).filter((F.col(t) > skip) & (F.col(y) > 0) & (F.col(y) < max_share * F.col("l_sq")))
    z = F.log(1 - F.col(y) / F.col("l_sq"))
    rows = joined.filter(1 - F.col(y) / F.col("l_sq") > 0.01).select(*keys, F.col(t).cast("double").alias("_t"), z.alias("_z"))
    fit = rows.groupBy(*keys).agg(F.regr_slope("_z", "_t").alias("slope"), F.regr_r2("_z", "_t").alias("r2"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_points) & (F.col("slope") < 0))
    slope_se = F.abs("slope") * F.sqrt(F.try_divide(F.try_divide(F.lit(1.0), F.col("r2")) - 1, F.col("n") - 2))
    return fit.select(*keys, (-1 / F.col("slope")).alias("tau"), (slope_se / (F.col("slope") ** 2)).alias("tau_sem"), "r2", "n")


def origin_curves(series: DataFrame, keys: Sequence[str], t: str, lengths: Sequence[float], stride: float, lag_step: int, pos: Sequence[str], min_rows: int = 30) -> tuple[DataFrame, DataFrame]:
    """Displacement curves (keys, length, origin, lag, msd) of the windows [origin, origin + length] every ``stride``, and the windows (keys, length, origin).

    A pair t, t + lag belongs to every window that holds both ends. Pairs are formed once for each lag and added up by cells of one stride: a
    window is some whole cells and the head of one more, whose size follows from length and lag. So rows are times x lags, whatever
    the number of origins and lengths.
    """
    keys = list(keys)
    span = series.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    rel = series.join(span, keys).select(*keys, (F.col(t) - F.col("_t0")).cast("long").alias("_r"), *pos)
    rel = cut_lineage(rel)
    cell, inside = F.floor(F.col("_r") / stride).cast("long"), F.col("_r") - F.floor(F.col("_r") / stride) * stride

    def heads(lag: Column, value: Column, how) -> list[Column]:
        out = []
        for i, length in enumerate(lengths):
            room = F.lit(length) - lag
            out.append(how(F.when(inside <= room - F.floor(room / stride) * stride, value)).alias(f"_h{i}"))
        return out

    last = F.floor((F.col("_t1") - F.col("_t0") - F.col("length")) / stride + 1e-9).cast("long")
    listed = span.withColumn("length", F.explode(F.array(*[F.lit(float(x)) for x in lengths]))).filter(last >= 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    number = lambda: F.array_position(F.array(*[F.lit(float(x)) for x in lengths]), F.col("length")) - 1
    # Rows of each window, from cells as well.
    zero = F.lit(0)
    counted = rel.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_full"), *heads(zero, F.lit(1), F.count))
    reach = listed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / stride).cast("long")))).withColumn("_cell", F.col("_c") + F.col("_k"))
    part = lambda full, names: F.when(F.col("_k") < F.floor((F.col("length") - F.col("lag")) / stride), F.col(full)).otherwise(F.element_at(F.array(*[F.col(n) for n in names]), (number() + 1).cast("int")))
    heads_ = [f"_h{i}" for i in range(len(lengths))]
    held = reach.withColumn("lag", F.lit(0)).join(counted, [*keys, "_cell"]).groupBy(*keys, "length", "_c", "_t0").agg(F.sum(part("_full", heads_)).alias("_m")).filter(F.col("_m") >= min_rows)
    held = cut_lineage(held.select(*keys, "length", "_c", (F.col("_t0") + F.col("_c") * stride).alias("origin")))
    top = int(max(lengths))
    start = rel.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(top), F.lit(lag_step)))).select(*keys, "lag", (F.col("_r") + F.col("lag")).alias("_to"), "_r", *[F.col(p).alias(f"_{p}") for p in pos])
    d2 = sum(((F.col(p) - F.col(f"_{p}")) ** 2 for p in pos), F.lit(0.0))
    pairs = start.join(rel.select(*keys, F.col("_r").alias("_to"), *pos), [*keys, "_to"])
    lag = F.col("lag")
    counts = [c.alias(f"_n{i}") for i, c in enumerate(heads(lag, F.lit(1), F.count))]
    cells = cut_lineage(pairs.groupBy(*keys, "lag", cell.alias("_cell")).agg(F.sum(d2).alias("_full"), F.count(F.lit(1)).alias("_nfull"), *heads(lag, d2, F.sum), *counts))
    wide = held.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / stride).cast("long")))).withColumn("_cell", F.col("_c") + F.col("_k"))
    met = wide.join(cells, [*keys, "_cell"]).filter((lag <= F.col("length")) & (F.col("_k") <= F.floor((F.col("length") - lag) / stride)))
    total = met.groupBy(*keys, "length", "origin", "lag").agg(F.sum(part("_full", heads_)).alias("_s"), F.sum(part("_nfull", [f"_n{i}" for i in range(len(lengths))])).alias("_n"))
    return total.filter("_n > 0").select(*keys, "length", "origin", "lag", (F.col("_s") / F.col("_n")).alias("msd")), held.select(*keys, "length", "origin")


def origin_resample(series: DataFrame, keys: Sequence[str], t: str, lengths: Sequence[float], stride: float, lag_step: int, pos: Sequence[str], *,
                    members: Sequence[str] = (), min_share: float = 0.70, min_count: int = 3, min_rows: int = 30, **options) -> tuple[DataFrame, DataFrame]:
    """Fit every origin window of every candidate length; pick the shortest reliable length.

    Gives the per-length summary with the ``chosen`` flag, and the fits by origin. With ``members`` (further keys of the series)
    the curve of a window is the mean over the members that fill it.
    """
    keys = list(keys)
    curves, held = origin_curves(series, [*keys, *members], t, lengths, stride, lag_step, pos, min_rows)
    if members:
        curves = curves.groupBy(*keys, "length", "origin", "lag").agg(F.avg("msd").alias("msd"))
        held = held.select(*keys, "length", "origin").distinct()
    fits = confinement(cut_lineage(curves), [*keys, "length", "origin"], **options).select(*keys, "origin", "l", "tau", "d", "length")
    totals = held.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("n_total"))
    good = fits.groupBy(*keys, "length").agg(F.count("l").alias("n_success"))
    summary = totals.join(good, [*keys, "length"], "left").withColumn("n_success", F.coalesce("n_success", F.lit(0)))
    summary = summary.withColumn("success_share", F.col("n_success") / F.col("n_total"))
    enough = F.col("n_success") >= min_count
    accepted = enough & (F.col("success_share") >= min_share)
    # Reliable lengths come first and shortest wins; else the best share, then count, then length.
    rank = F.struct(
        accepted.cast("int").alias("ok"), F.when(accepted, -F.col("length")).otherwise(F.col("success_share")).alias("a"),
        F.when(accepted, F.lit(0)).otherwise(F.col("n_success")).alias("b"), (-F.col("length")).alias("c"),
    )
    best = summary.filter(enough).groupBy(*keys).agg(F.max_by("length", rank).alias("_best"))
    return summary.join(best, keys, "left").withColumn("chosen", F.coalesce(F.col("length") == F.col("_best"), F.lit(False))).drop("_best"), fits


def diffusion_errors(series: DataFrame, curves: DataFrame, keys: Sequence[str], unit: str, t: str, pos: Sequence[str], *, lengths: Sequence[float], stride: float, n_boot: int = 200, seed: int = 0, min_rows: int = 30, **options) -> DataFrame:
    """(keys, d, analytic, bootstrap, origin, error) of the mean curve of all units.

    ``analytic`` is the error of the two-stage fit, ``bootstrap`` the deviation over ``n_boot`` draws of units, ``origin`` the standard error over the origin
    windows of the chosen length; ``error`` combines them. ``series`` has the positions of the units, ``curves`` their (lag, msd).
    """
    keys = list(keys)
    curves = cut_lineage(curves.select(*keys, unit, "lag", "msd"))
    mean = confinement(cut_lineage(curves.groupBy(*keys, "lag").agg(F.avg("msd").alias("msd"))), keys, **options).select(*keys, "d", F.col("d_sem").alias("analytic"))
    drawn = confinement(cut_lineage(bootstrap_curves(curves, keys, unit, "lag", "msd", n_boot, seed)), [*keys, "replicate"], **options)
    boot = drawn.groupBy(*keys).agg(F.stddev_samp("d").alias("bootstrap"))
    summary, fits = origin_resample(series, keys, t, lengths, stride, 1, pos, members=[unit], min_rows=min_rows, **options)
    chosen = fits.join(summary.filter("chosen").select(*keys, "length"), [*keys, "length"])
    origin = chosen.groupBy(*keys).agg(sem(F.col("d")).alias("origin"))
    out = mean.join(boot, keys, "left").join(origin, keys, "left")
    return out.withColumn("error", combined_error(F.col("analytic"), F.col("bootstrap"), F.col("origin")))


def pooled_confinement(per_chain: DataFrame, keys: Sequence[str], value: str, own_sem: str) -> DataFrame:
    """Random-effects pool of per-chain values; plain mean and SEM where no chain has an error."""
    pooled = random_effects_pool(per_chain, keys, value, own_sem)
    plain = per_chain.groupBy(*keys).agg(F.avg(value).alias("_m"), sem(F.col(value)).alias("_s"), F.count(value).alias("_k"))
    out = plain.join(pooled, list(keys), "left")
    return out.select(*keys, F.coalesce("mean", "_m").alias("mean"), F.when(F.col("k").isNull(), F.col("_s")).otherwise(F.col("sem")).alias("sem"), "tau2", F.coalesce("k", "_k").alias("k"))


def combined_error(analytic: Column, bootstrap: Column, origin: Column) -> Column:
    """max(analytic, bootstrap), then in quadrature with the origin-resampling error."""
    return quadrature(F.greatest(analytic, bootstrap), origin)


def diffusive_slopes(curve: DataFrame, keys: Sequence[str], t: str, y: str, points: int, tolerance: float, n_boot: int, seed: int = 0, min_r: float = 0.9) -> DataFrame:
    """D = mean resampled slope / 6 over the regions where the log-log slope is near one."""
    rows = curve.filter((F.col(t) > 0) & (F.col(y) > 0)).withColumn("lx", F.log(t)).withColumn("ly", F.log(y))
    slopes = windows.moving_slope(rows, keys, "lx", "ly", points)
    runs = windows.merged_runs(slopes, keys, points, 1.0, tolerance)
    inside = slopes.join(runs, list(keys)).filter("i >= first AND i < last").withColumn("slot", (F.col("i") - F.col("first")).cast("long")).withColumn("n", F.col("last") - F.col("first"))
    group = [*keys, "first"]
    weights = resample_weights(inside, group, n_boot, seed, "slot", "n")
    drawn = weights.join(inside.select(*group, "slot", t, y, "lx", "ly"), [*group, "slot"])
    def moments(x: str, z: str, name: str) -> list[Column]:
        w = F.col("weight")
        return [F.sum(w * F.col(x)).alias(f"{name}x"), F.sum(w * F.col(z)).alias(f"{name}y"), F.sum(w * F.col(x) * F.col(x)).alias(f"{name}xx"),
                F.sum(w * F.col(x) * F.col(z)).alias(f"{name}xy"), F.sum(w * F.col(z) * F.col(z)).alias(f"{name}yy")]
    m = drawn.groupBy(*group, "replicate").agg(F.sum("weight").alias("w"), *moments("lx", "ly", "l"), *moments(t, y, "r"))
    def cov(name: str, pair: str) -> Column:
        return F.col(f"{name}{pair}") - F.col(f"{name}{pair[0]}") * F.col(f"{name}{pair[1]}") / F.col("w")
    log_slope = F.when(cov("l", "xx") > 0, F.try_divide(cov("l", "xy"), cov("l", "xx")))
    r = F.try_divide(cov("l", "xy"), F.sqrt(F.greatest(cov("l", "xx") * cov("l", "yy"), F.lit(0.0))))
    real_slope = F.when(cov("r", "xx") > 0, F.try_divide(cov("r", "xy"), cov("r", "xx")))
    good = m.select(*keys, real_slope.alias("slope"), log_slope.alias("_ls"), r.alias("_r")).filter((F.abs("_r") > min_r) & (F.abs(F.col("_ls") - 1) <= tolerance) & (F.col("slope") > 0))
    return good.groupBy(*keys).agg((F.avg("slope") / 6).alias("d"), (sem(F.col("slope")) / 6).alias("d_sem"), F.count(F.lit(1)).alias("n_slopes"))

