"""Joins in time: nearest frame, intervals, members at the nearest frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, right_cols: Sequence[str], bucket: int) -> DataFrame:
    """Each left row with the nearest right row; a tie goes to the later one, ends are clamped.

    Work is split by (keys, time bucket), so one hot key spreads over its buckets. Each
    bucket also gets the last right row before it and the first after it, found on the
    table of bucket ends, which keeps the result exact across empty buckets.
    """
    payload = F.struct(F.col(right_time).alias("rt"), *right_cols)
    r = right.select(*keys, F.floor(F.col(right_time) / bucket).cast("long").alias("_b"), payload.alias("_r"))
    left_b = left.withColumn("_b", F.floor(F.col(left_time) / bucket).cast("long"))
    ends = r.groupBy(*keys, "_b").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    buckets = left_b.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full")
    order = W.partitionBy(*keys).orderBy("_b")
    edges = buckets.select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    extra = edges.select(*keys, "_b", F.explode(F.array_compact(F.array("_before", "_after"))).alias("_r"))
    stops = r.unionByName(extra).select(*keys, "_b", F.col("_r.rt").alias("_t"), "_r")
    cols = F.struct(*left.columns)
    merged = stops.withColumn("_l", F.lit(None).cast(left_b.select(cols).schema[0].dataType)).unionByName(
        left_b.select(*keys, "_b", F.col(left_time).alias("_t"), cols.alias("_l")).withColumn("_r", F.lit(None).cast(stops.schema["_r"].dataType))
    )
    w = W.partitionBy(*keys, "_b").orderBy("_t", F.col("_l").isNotNull())
    w_back = W.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.col("_l").isNotNull())
    both = merged.withColumn("_p", F.last("_r", ignorenulls=True).over(w)).withColumn("_n", F.last("_r", ignorenulls=True).over(w_back)).filter("_l IS NOT NULL")
    closer_before = F.col("_n").isNull() | (F.col("_p").isNotNull() & (F.col("_t") - F.col("_p.rt") < F.col("_n.rt") - F.col("_t")))
    chosen = both.withColumn("_c", F.when(closer_before, F.col("_p")).otherwise(F.col("_n")))
    return chosen.select("_l.*", F.col("_c.rt").alias(right_time), *[F.col(f"_c.{c}").alias(c) for c in right_cols])


def sum_over_members(rows: DataFrame, frames: DataFrame, membership: DataFrame, keys: Sequence[str], step: str, frame_step: str,
                     frame: str, chain: str, values: Sequence[str], bucket: int) -> DataFrame:
    """Per step, the sums of ``values`` over the chains inside at the nearest frame.

    Only the distinct steps go through the time join; the rows then meet the members by
    an equi-join and are summed with map-side partials.
    """
    steps = rows.select(*keys, step).distinct()
    matched = nearest_in_time(steps, frames.select(*keys, frame, frame_step), keys, step, frame_step, [frame], bucket)
    inside = membership.filter("inside").select(*keys, frame, chain)
    tagged = rows.join(matched.select(*keys, step, frame), [*keys, step])
    return tagged.join(inside, [*keys, frame, chain], "left_semi").groupBy(*keys, step).agg(*[F.sum(v).alias(v) for v in values])


def in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points joined to the half-open intervals [start, end) of the same keys that hold them.

    An interval is listed once per time bucket it touches, so this is an equi-join.
    """
    spans = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket).cast("long"), F.floor((F.col(end) - 1) / bucket).cast("long"))))
    tagged = points.withColumn("_b", F.floor(F.col(at) / bucket).cast("long"))
    return tagged.join(spans, [*keys, "_b"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_b")
