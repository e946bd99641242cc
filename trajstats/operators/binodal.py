"""Coexistence curves: dense and dilute branches that meet at a critical temperature.

    c = c_c + B (Tc - T) +/- A/2 (Tc - T)^0.325

For a fixed Tc the model is linear in c_c, B and A. So a fit is: list Tc values, sum the
normal equations per (group, Tc) with one aggregation, solve them in closed form, keep
the best Tc, and repeat on a finer list around it. Everything is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trajstats.session import cut_lineage

# The critical exponent, the sigma floor and the range of Tc above the data.
BETA = 0.325
SIGMA_FLOOR = 0.05
TC_RANGE = (0.1, 100.0)
LEVELS = 3
POINTS = 161


def effective_sigma(value: Column, sd: Column, floor: float = SIGMA_FLOOR) -> Column:
    """The given error, but at least ``floor`` of the value."""
    least = F.lit(floor) * F.greatest(F.abs(value), F.lit(1e-6))
    return F.greatest(F.when(sd > 0, sd).otherwise(least), least)


def branch_model(temp: Column, tc: Column, c_c: Column, a: Column, b: Column) -> tuple[Column, Column]:
    delta = F.greatest(tc - temp, F.lit(1e-12))
    half = a * F.pow(delta, F.lit(BETA)) / 2
    return c_c + b * delta + half, c_c + b * delta - half


def _best_at(rows: DataFrame, keys: Sequence[str], fixed_cc: Column | None, fixed_b: Column | None, tc_steps: tuple[Column, Column]) -> DataFrame:
    """Best Tc of one list per group, with its linear parameters and squared error."""
    lo, step = tc_steps
    grid = rows.withColumn("tc", F.explode(F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda k: lo + k * step)))
    delta = F.greatest(F.col("tc") - F.col("temperature_k"), F.lit(1e-12))
    q = F.pow(delta, F.lit(BETA)) / 2
    shift = (fixed_cc if fixed_cc is not None else F.lit(0.0)) + (fixed_b * delta if fixed_b is not None else F.lit(0.0))
    y1, y2 = F.col("c_sg") - shift, F.col("c_dil_inf") - shift
    w1, w2 = F.col("_w1"), F.col("_w2")
    s, m = w1 + w2, w1 - w2
    sums = {
        "s0": s, "sd": s * delta, "sdd": s * delta * delta, "mq": m * q, "mdq": m * delta * q, "sqq": s * q * q,
        "y0": w1 * y1 + w2 * y2, "yd": (w1 * y1 + w2 * y2) * delta, "yq": (w1 * y1 - w2 * y2) * q, "yy": w1 * y1 * y1 + w2 * y2 * y2,
    }
    g = grid.groupBy(*keys, "tc").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("n"))
    c = {n: F.col(n) for n in sums}
    free_cc, free_b = fixed_cc is None, fixed_b is None
    zero = F.lit(0.0)
    if free_cc and free_b:
        m11, m12, m13, m22, m23, m33, v1, v2, v3 = c["s0"], c["sd"], c["mq"], c["sdd"], c["mdq"], c["sqq"], c["y0"], c["yd"], c["yq"]
        det = m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13)
        cc = F.try_divide(v1 * (m22 * m33 - m23 * m23) - m12 * (v2 * m33 - m23 * v3) + m13 * (v2 * m23 - m22 * v3), det)
        b = F.try_divide(m11 * (v2 * m33 - m23 * v3) - v1 * (m12 * m33 - m23 * m13) + m13 * (m12 * v3 - v2 * m13), det)
        a = F.try_divide(m11 * (m22 * v3 - v2 * m23) - m12 * (m12 * v3 - v2 * m13) + v1 * (m12 * m23 - m22 * m13), det)
        det0 = m11 * m22 - m12 * m12
        cc0, b0 = F.try_divide(v1 * m22 - m12 * v2, det0), F.try_divide(m11 * v2 - m12 * v1, det0)
    elif free_cc:
        det = c["s0"] * c["sqq"] - c["mq"] * c["mq"]
        cc, b, a = F.try_divide(c["y0"] * c["sqq"] - c["mq"] * c["yq"], det), zero, F.try_divide(c["s0"] * c["yq"] - c["mq"] * c["y0"], det)
        cc0, b0 = c["y0"] / c["s0"], zero
    else:
        cc, b, a = zero, zero, F.try_divide(c["yq"], c["sqq"])
        cc0, b0 = zero, zero
    ok = a > 0
    out = g.select(*keys, "tc", "n", *sums, F.when(ok, cc).otherwise(cc0).alias("cc"), F.when(ok, b).otherwise(b0).alias("b"), F.when(ok, a).otherwise(0.0).alias("a"))
    cc, b, a = F.col("cc"), F.col("b"), F.col("a")
    sse = (c["yy"] - 2 * (cc * c["y0"] + b * c["yd"] + a * c["yq"]) + cc * cc * c["s0"] + b * b * c["sdd"] + a * a * c["sqq"] + 2 * (cc * b * c["sd"] + cc * a * c["mq"] + b * a * c["mdq"]))
    best = out.withColumn("sse", F.greatest(sse, F.lit(0.0)))
    return best.groupBy(*keys).agg(F.min_by(F.struct("tc", "cc", "b", "a", "sse", "n"), F.struct("sse", "tc")).alias("f"))


def binodal_fit(rows: DataFrame, keys: Sequence[str], *, c_c: str | None = None, b: str | None = None, bound: float | str = TC_RANGE[1], min_points: int = 3) -> DataFrame:
    """(keys, tc, c_c, a, b, rmse, n_points, at_bound).

    Rows need temperature_k, c_sg, c_dil_inf and c_sg_sd, c_dil_inf_sd. ``c_c`` and ``b``
    name columns with values to hold fixed (constrained variants); ``bound`` is the span
    of Tc above the data, or a column with it. Keys below ``min_points`` do not appear.
    """
    used = rows.filter("c_sg IS NOT NULL AND c_dil_inf IS NOT NULL AND temperature_k IS NOT NULL")
    span = F.col(bound) if isinstance(bound, str) else F.lit(float(bound))
    top = used.groupBy(*keys).agg(F.max("temperature_k").alias("_top"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    extra = [x for x in dict.fromkeys((c_c, b, bound if isinstance(bound, str) else None)) if x and x not in keys]
    base = used.join(top, list(keys)).select(
        *keys, *extra, "temperature_k", "c_sg", "c_dil_inf", "_top",
        F.pow(effective_sigma(F.col("c_sg"), F.col("c_sg_sd")), F.lit(-2)).alias("_w1"), F.pow(effective_sigma(F.col("c_dil_inf"), F.col("c_dil_inf_sd")), F.lit(-2)).alias("_w2"),
    )
    first, last = F.col("_top") + TC_RANGE[0], F.col("_top") + span
    # One row per point of a reduced curve; every level starts from a written table, so
    # the plan of a level does not hold the plans of the levels before it.
    base = cut_lineage(base)
    rows_now = base.withColumn("_lo", first).withColumn("_step", (last - first) / (POINTS - 1))
    found = None
    for level in range(LEVELS):
        widths = rows_now.groupBy(*keys).agg(F.max("_step").alias("_half"))
        found = _best_at(rows_now, keys, F.col(c_c) if c_c else None, F.col(b) if b else None, (F.col("_lo"), F.col("_step")))
        if level < LEVELS - 1:
            near = cut_lineage(found.join(widths, list(keys)).select(*keys, F.col("f.tc").alias("_tc"), "_half"))
            rows_now = base.join(near, list(keys)).withColumn("_lo", F.greatest(F.col("_tc") - F.col("_half"), first))
            rows_now = rows_now.withColumn("_step", (F.least(F.col("_tc") + F.col("_half"), last) - F.col("_lo")) / (POINTS - 1)).drop("_tc", "_half")
    found = cut_lineage(found)
    marks = base.groupBy(*keys).agg(*[F.max(x).alias(x) for x in extra], F.max("_top").alias("_top"))
    f = F.col("f")
    out = found.join(marks, list(keys))
    high = F.col("_top") + (F.col(bound) if isinstance(bound, str) else F.lit(float(bound)))
    at_bound = F.when(f["tc"] >= high - 1e-6, "upper").when(f["tc"] <= F.col("_top") + TC_RANGE[0] + 1e-6, "lower").otherwise("inside")
    return out.select(
        *keys, f["tc"].alias("tc"), (F.col(c_c) if c_c else f["cc"]).alias("c_c"), f["a"].alias("a"), (F.col(b) if b else f["b"]).alias("b"),
        F.sqrt(f["sse"] / (2 * f["n"])).alias("rmse"), f["n"].alias("n_points"), at_bound.alias("at_bound"),
    )


def robust_binodal_fit(rows: DataFrame, keys: Sequence[str], rounds: int = 3, scale: float = 1.0) -> DataFrame:
    """Huber-weighted variant: residuals beyond ``scale`` sigma lose weight, a few reweighted fits."""
    fit = binodal_fit(rows, keys)
    current = rows
    for _ in range(rounds):
        joined = rows.join(fit.select(*keys, "tc", "c_c", "a", "b"), list(keys))
        dense, dilute = branch_model(F.col("temperature_k"), F.col("tc"), F.col("c_c"), F.col("a"), F.col("b"))
        s1, s2 = effective_sigma(F.col("c_sg"), F.col("c_sg_sd")), effective_sigma(F.col("c_dil_inf"), F.col("c_dil_inf_sd"))
        z1, z2 = F.abs(F.col("c_sg") - dense) / s1, F.abs(F.col("c_dil_inf") - dilute) / s2
        current = joined.withColumn("c_sg_sd", s1 * F.sqrt(F.greatest(z1 / scale, F.lit(1.0)))).withColumn("c_dil_inf_sd", s2 * F.sqrt(F.greatest(z2 / scale, F.lit(1.0)))).drop("tc", "c_c", "a", "b")
        fit = binodal_fit(current, keys)
    return fit


def two_step_fit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fallback: A and Tc from the width alone, then c_c and B from the diameter at that Tc."""
    width = F.sqrt(F.coalesce(F.col("c_sg_sd"), F.lit(0.0)) ** 2 + F.coalesce(F.col("c_dil_inf_sd"), F.lit(0.0)) ** 2)
    d = rows.withColumn("_d", F.col("c_sg") - F.col("c_dil_inf")).withColumn("_m", (F.col("c_sg") + F.col("c_dil_inf")) / 2).withColumn("_sd", width)
    half = d.select(*keys, "temperature_k", (F.col("_d") / 2).alias("c_sg"), (-F.col("_d") / 2).alias("c_dil_inf"), (F.col("_sd") / 2).alias("c_sg_sd"), (F.col("_sd") / 2).alias("c_dil_inf_sd"), F.lit(0.0).alias("_zero"))
    gap = binodal_fit(half, keys, c_c="_zero", b="_zero").select(*keys, "tc", "a", "n_points", "at_bound")
    joined = d.join(gap, list(keys)).withColumn("_x", F.greatest(F.col("tc") - F.col("temperature_k"), F.lit(0.0))).withColumn("_w", F.pow(effective_sigma(F.col("_m"), F.col("_sd") / 2), F.lit(-2)))
    w, x, m = F.col("_w"), F.col("_x"), F.col("_m")
    sums = joined.groupBy(*keys, "tc", "a", "n_points", "at_bound").agg(F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(w * m).alias("sy"), F.sum(w * x * m).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") ** 2
    return sums.select(*keys, "tc", F.try_divide(F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy"), det).alias("c_c"), "a", F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), det).alias("b"), "n_points", "at_bound")


def curve_table(fits: DataFrame, keys: Sequence[str], t_min: Column, points: int = 250) -> DataFrame:
    """Both branches on an even temperature list from ``t_min`` to Tc."""
    at = fits.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("temperature_k", t_min + (F.col("tc") - t_min) * F.col("_k") / (points - 1))
    dense, dilute = branch_model(F.col("temperature_k"), F.col("tc"), F.col("c_c"), F.col("a"), F.col("b"))
    return at.select(*keys, F.col("_k").alias("k"), "temperature_k", dense.alias("dense"), dilute.alias("dilute"), (dense - dilute).alias("delta_c"), ((dense + dilute) / 2).alias("c_bar"))


def resample_summary(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, mean and 95 % interval of resampled parameters, and the shares at the bounds of Tc."""
    aggs = []
    for p in ("tc", "c_c", "a", "b"):
        aggs += [F.median(p).alias(f"{p}_median"), F.avg(p).alias(f"{p}_mean"), F.percentile(p, 0.025).alias(f"{p}_low"), F.percentile(p, 0.975).alias(f"{p}_high")]
    return fits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_success"), *aggs,
        F.avg((F.col("at_bound") == "upper").cast("double")).alias("share_upper"), F.avg((F.col("at_bound") == "lower").cast("double")).alias("share_lower"),
    )
