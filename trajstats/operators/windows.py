"""Ordered operators on reduced series: crossings, slopes, smoothing, integrals, intervals.

A series here is a profile, a curve over lags or a row of windows. Its length is set by
the number of bins, lags or windows, not by the number of raw frames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def first_crossing(curve: DataFrame, keys: Sequence[str], x: str, y: str, level: str) -> DataFrame:
    """First x where y reaches the level column, linear between the two points around it."""
    w = W.partitionBy(*keys).orderBy(x)
    steps = curve.withColumn("_x0", F.lag(x).over(w)).withColumn("_y0", F.lag(y).over(w))
    hits = steps.filter(F.col(y) >= F.col(level))
    at = F.when(F.col("_y0") < F.col(level), F.col("_x0") + (F.col(level) - F.col("_y0")) / (F.col(y) - F.col("_y0")) * (F.col(x) - F.col("_x0"))).otherwise(F.col(x))
    return hits.groupBy(*keys).agg(F.min_by(at, x).alias("crossing"))


def half_max_radius(profile: DataFrame, keys: Sequence[str], r: str, density: str) -> DataFrame:
    """Outer radius at which a profile falls to half of its peak."""
    peak = profile.groupBy(*keys).agg(F.max(F.struct(F.col(density).alias("d"), (-F.col(r)).alias("nr"))).alias("_p"))
    beyond = profile.join(peak, list(keys)).withColumn("_half", F.col("_p.d") / 2)
    w = W.partitionBy(*keys).orderBy(r)
    steps = beyond.withColumn("_x0", F.lag(r).over(w)).withColumn("_y0", F.lag(density).over(w)).filter(F.col(r) > -F.col("_p.nr"))
    y0, y1, x0, x1 = F.col("_y0"), F.col(density), F.col("_x0"), F.col(r)
    crossed = ((y0 >= F.col("_half")) & (F.col("_half") >= y1)) | ((y1 >= F.col("_half")) & (F.col("_half") >= y0))
    at = F.when(y1 != y0, x0 + (F.col("_half") - y0) * (x1 - x0) / (y1 - y0)).otherwise(x1)
    return steps.filter(crossed).groupBy(*keys).agg(F.min_by(at, r).alias("r_half"))


def monotonicity_flags(rows: DataFrame, keys: Sequence[str], temp: str, value: str, sd: str, factor: float, rising: bool) -> DataFrame:
    """Flag a step against the expected trend by more than ``factor`` combined sigmas."""
    w = W.partitionBy(*keys).orderBy(temp)
    diff = F.col(value) - F.lag(value).over(w)
    sigma = F.coalesce(F.sqrt(F.col(sd) ** 2 + F.lag(sd).over(w) ** 2), F.lit(0.0))
    bad = diff < -factor * sigma if rising else diff > factor * sigma
    return rows.withColumn("flag_nonmonotone", F.coalesce(bad, F.lit(False)))


def moving_slope(curve: DataFrame, keys: Sequence[str], x: str, y: str, points: int) -> DataFrame:
    """Regression slope over each run of ``points`` consecutive points, at its first point."""
    order = W.partitionBy(*keys).orderBy(x)
    run = order.rowsBetween(0, points - 1)
    out = curve.withColumn("i", F.row_number().over(order) - 1).withColumn("_n", F.count(y).over(run))
    return out.withColumn("slope", F.when(F.col("_n") == points, F.regr_slope(F.col(y), F.col(x)).over(run))).drop("_n")


def merged_runs(slopes: DataFrame, keys: Sequence[str], points: int, target: float, tolerance: float) -> DataFrame:
    """Index ranges [first, last) of qualifying runs, overlapping or touching ones merged."""
    good = slopes.filter(F.abs(F.col("slope") - target) <= tolerance).select(*keys, F.col("i").alias("_s"), (F.col("i") + points).alias("_e"))
    order = W.partitionBy(*keys).orderBy("_s")
    gap = F.coalesce(F.col("_s") > F.max("_e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    islands = good.withColumn("_new", gap.cast("int")).withColumn("_g", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_g").agg(F.min("_s").alias("first"), F.max("_e").alias("last")).drop("_g")


def gaussian_weights(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight) up to three sigma, summing to one."""
    radius = max(1, round(3 * sigma))
    raw = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]
    total = sum(v for _, v in raw)
    return [(k, v / total) for k, v in raw]


def smoothed(profile: DataFrame, keys: Sequence[str], i: str, y: str, sigma: float) -> DataFrame:
    """Gaussian smoothing on positions 0..n-1 with reflected edges, clipped at 0, unit sum.

    Each value is sent to the positions its kernel reaches, directly and by reflection at
    either end, and summed there; no neighbour lookup is needed.
    """
    reach = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in gaussian_weights(sigma)])
    n = profile.groupBy(*keys).agg((F.max(i) + 1).alias("_n")) if keys else profile.agg((F.max(i) + 1).alias("_n"))
    rows = profile.join(n, list(keys)) if keys else profile.crossJoin(F.broadcast(n))
    sources = F.when((F.col(i) > 0) & (F.col(i) < F.col("_n") - 1), F.array(F.col(i), -F.col(i), 2 * (F.col("_n") - 1) - F.col(i)))
    sources = sources.when(F.col(i) > 0, F.array(F.col(i), -F.col(i))).when(F.col("_n") > 1, F.array(F.col(i), 2 * (F.col("_n") - 1) - F.col(i))).otherwise(F.array(F.col(i)))
    sent = rows.withColumn("_s", F.explode(sources)).withColumn("_w", F.explode(reach)).withColumn("_t", F.col("_s") + F.col("_w.k"))
    hits = sent.filter((F.col("_t") >= 0) & (F.col("_t") < F.col("_n"))).groupBy(*keys, F.col("_t").alias(i)).agg(F.greatest(F.sum(F.col(y) * F.col("_w.v")), F.lit(0.0)).alias(y))
    total = hits.groupBy(*keys).agg(F.sum(y).alias("_sum")) if keys else hits.agg(F.sum(y).alias("_sum"))
    out = hits.join(total, list(keys)) if keys else hits.crossJoin(F.broadcast(total))
    return out.withColumn(y, F.when(F.col("_sum") > 0, F.col(y) / F.col("_sum")).otherwise(F.col(y))).drop("_sum")


def cumulative_trapezoid(curve: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "integral") -> DataFrame:
    """Running trapezoid integral from the second point on."""
    order = W.partitionBy(*keys).orderBy(x)
    area = 0.5 * (F.col(y) + F.lag(y).over(order)) * (F.col(x) - F.lag(x).over(order))
    summed = F.sum("_a").over(order.rowsBetween(W.unboundedPreceding, 0))
    return curve.withColumn("_a", area).withColumn(out, summed).filter("_a IS NOT NULL").drop("_a")


def running_integral_summary(curve: DataFrame, keys: Sequence[str], x: str, integral: str = "integral") -> DataFrame:
    """Final and largest absolute value, time to 90 % of the final, slope over the last 20 % (at least 3 points)."""
    w = W.partitionBy(*keys)
    rows = curve.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(x)))
    rows = rows.withColumn("_final", F.max_by(F.col(integral), F.col(x)).over(w))
    late = F.col("_i") > F.col("_n") - F.greatest(F.lit(3), F.ceil(0.2 * F.col("_n")))
    late_x, late_y = F.when(late, F.col(x)), F.when(late, F.col(integral))
    reached = (F.abs("_final") > 0) & (F.abs(F.col(integral)) >= 0.9 * F.abs("_final"))
    out = rows.groupBy(*keys).agg(
        F.max("_final").alias("final"), F.max(F.abs(F.col(integral))).alias("abs_max"), F.min(F.when(reached, F.col(x))).alias("time_to_90"),
        F.when(F.max("_n") >= 3, F.regr_slope(late_y, late_x)).alias("late_slope"), (F.max(late_x) - F.min(late_x)).alias("_d"),
    )
    rel = F.when(F.abs("final") > 1e-12, F.abs("late_slope") * F.greatest(F.col("_d"), F.lit(1e-12)) / F.abs("final"))
    return out.withColumn("late_relative_slope", rel).drop("_d")


def merged_intervals(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", bucket: int = 100_000) -> DataFrame:
    """Union of closed integer intervals; adjacent ones are joined.

    Rows are ordered inside (keys, bucket of the start) only. What earlier buckets reach
    into a later one comes from the table of buckets, so a key with very many intervals
    spreads over tasks.
    """
    rows = intervals.withColumn("_b", F.floor(F.col(start) / bucket).cast("long"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    reach = rows.groupBy(*keys, "_b").agg(F.max(end).alias("_m")).select(*keys, "_b", F.max("_m").over(earlier).alias("_reach"))
    order = W.partitionBy(*keys, "_b").orderBy(start, end)
    before = F.greatest(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    marked = rows.join(reach, [*keys, "_b"]).withColumn("_first", F.when(F.coalesce(F.col(start) > before + 1, F.lit(True)), F.col(start)))
    marked = marked.withColumn("_island", F.last("_first", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    open_island = marked.groupBy(*keys, "_b").agg(F.max("_first").alias("_f")).select(*keys, "_b", F.last("_f", ignorenulls=True).over(earlier).alias("_open"))
    named = marked.join(open_island, [*keys, "_b"]).withColumn("_island", F.coalesce("_island", "_open"))
    return named.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def interval_complement(intervals: DataFrame, lengths: DataFrame, keys: Sequence[str], length: str, start: str = "start", end: str = "end", bucket: int = 100_000) -> DataFrame:
    """Closed intervals of [1, length] that the given ones leave open."""
    merged = merged_intervals(intervals, keys, start, end, bucket).withColumn("_b", F.floor(F.col(start) / bucket).cast("long"))
    firsts = merged.groupBy(*keys, "_b").agg(F.min(start).alias("_f"))
    after = firsts.select(*keys, "_b", F.lead("_f").over(W.partitionBy(*keys).orderBy("_b")).alias("_next"))
    follow = F.coalesce(F.lead(start).over(W.partitionBy(*keys, "_b").orderBy(start)), F.col("_next"), F.col("_len") + 1)
    total = lengths.select(*keys, F.col(length).cast("long").alias("_len"))
    inner = merged.join(after, [*keys, "_b"]).join(total, list(keys)).withColumn("_n", follow)
    gaps = inner.select(*keys, F.greatest(F.col(end) + 1, F.lit(1)).alias("_a"), F.least(F.col("_n") - 1, F.col("_len")).alias("_z"))
    head = total.join(firsts.groupBy(*keys).agg(F.min("_f").alias("_f")), list(keys), "left")
    head = head.select(*keys, F.lit(1).cast("long").alias("_a"), F.least(F.coalesce(F.col("_f") - 1, F.col("_len")), F.col("_len")).alias("_z"))
    return gaps.unionByName(head).filter("_a <= _z").select(*keys, F.col("_a").alias(start), F.col("_z").alias(end))


def split_near_equal(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """n contiguous segments, the first ones longer by one where it does not divide."""
    return rows.withColumn("segment", F.ntile(n).over(W.partitionBy(*keys).orderBy(order)) - 1)


def fixed_segments(rows: DataFrame, keys: Sequence[str], index: str, n: int) -> DataFrame:
    """n segments of equal width floor(N/n) on an index 0..N-1; the tail is dropped."""
    total = rows.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    out = rows.join(total, list(keys)).withColumn("_w", F.floor(F.col("_n") / n)).filter("_w > 1")
    return out.withColumn("segment", F.floor(F.col(index) / F.col("_w")).cast("int")).withColumn("pos", (F.col(index) - F.col("segment") * F.col("_w")).cast("int")).filter(F.col("segment") < n).drop("_n", "_w")


def thinned(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """At most n evenly spaced rows of a series, both ends kept."""
    w = W.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    slot = F.ceil(F.col("_i") * (n - 1) / (F.col("_n") - 1)) if n > 1 else F.lit(0)
    keep = (F.col("_n") <= n) | (F.floor(slot * (F.col("_n") - 1) / F.lit(max(n - 1, 1))) == F.col("_i"))
    return ranked.filter(keep).drop("_i", "_n")


def origin_windows(rows: DataFrame, keys: Sequence[str], t: str, length: float, stride: float, min_rows: int = 30) -> DataFrame:
    """Overlapping windows [origin, origin + length] every ``stride``, each with at least ``min_rows`` rows.

    A row lists the origins that cover it from its own time; nothing is joined by range.
    """
    span = rows.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    rel = F.col(t) - F.col("_t0")
    first = F.greatest(F.ceil((rel - length) / stride - 1e-9), F.lit(0))
    last = F.least(F.floor(rel / stride + 1e-9), F.floor((F.col("_t1") - F.col("_t0") - length) / stride + 1e-9))
    listed = rows.join(span, list(keys)).filter(first <= last).withColumn("_k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    out = listed.withColumn("origin", F.col("_t0") + F.col("_k") * stride).withColumn("lag", F.col(t) - F.col("origin")).drop("_t0", "_t1", "_k")
    full = out.groupBy(*keys, "origin").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= min_rows).drop("_m")
    return out.join(full, [*keys, "origin"], "left_semi")


def curve_crossings(curve: DataFrame, keys: Sequence[str], x: str, a: str, b: str) -> DataFrame:
    """Points where two curves on one grid change order, with the mean height there."""
    order = W.partitionBy(*keys).orderBy(x)
    d = F.col(a) - F.col(b)
    steps = curve.withColumn("_d", d).withColumn("_d0", F.lag(d).over(order)).withColumn("_x0", F.lag(x).over(order)).withColumn("_a0", F.lag(a).over(order)).withColumn("_b0", F.lag(b).over(order))
    changed = (F.col("_d0") < 0) != (F.col("_d") < 0)
    part = F.when(F.abs(F.col("_d") - F.col("_d0")) < 1e-12, 0.5).otherwise(-F.col("_d0") / (F.col("_d") - F.col("_d0")))
    height = 0.5 * (F.col("_a0") + part * (F.col(a) - F.col("_a0")) + F.col("_b0") + part * (F.col(b) - F.col("_b0")))
    return steps.filter(changed).select(*keys, (F.col("_x0") + part * (F.col(x) - F.col("_x0"))).alias("crossing"), height.alias("height"))


def outer_crossing(curve: DataFrame, keys: Sequence[str], x: str, a: str, b: str, low: float) -> DataFrame:
    """The outermost crossing with height in [0, low], else the outermost crossing, else the nearest approach."""
    hits = curve_crossings(curve, keys, x, a, b)
    calm = F.col("height").between(0.0, low)
    best = hits.groupBy(*keys).agg(F.coalesce(F.max(F.when(calm, F.col("crossing"))), F.max("crossing")).alias("_c"))
    nearest = curve.groupBy(*keys).agg(F.min_by(F.col(x), F.struct(F.abs(F.col(a) - F.col(b)).alias("d"), F.col(x).alias("x"))).alias("_n"))
    return nearest.join(best, list(keys), "left").select(*keys, F.coalesce("_c", "_n").alias("crossing"))
