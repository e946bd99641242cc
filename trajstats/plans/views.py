"""The given tables seen as trajectories, profiles and observable series.

Each view has a Spark form and the same view as SQL text (a list of CTEs) for the
check queries. All views read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajstats.session import spread

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
N_FRAMES = 21
COORD_SCALE = 800.0
BOX = (100.0, 100.0, 120.0)
SPECIES = ("alpha", "beta", "gamma", "solute")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- observables_long: event types as systems, days as windows -------------------------

def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the time as integer microseconds, so that windows never round."""
    return table(spark, sf_dir, "events").withColumn(
        "t_us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    )


def daily_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, observable_key, idx, value): three observables per event type and day."""
    days = (
        event_time(spark, sf_dir)
        .groupBy(F.col("event_type").alias("system"), F.expr("t_us div 86400000000").alias("day"))
        .agg(
            F.avg("value").alias("mean_value"),
            F.max("value").alias("max_value"),
            F.count(F.lit(1)).cast("double").alias("n_events"),
        )
    )
    first = days.groupBy("system").agg(F.min("day").alias("day0"))
    return (
        days.join(first, "system")
        .select("system", (F.col("day") - F.col("day0")).alias("idx"), "mean_value", "max_value", "n_events")
        .unpivot(["system", "idx"], ["mean_value", "max_value", "n_events"], "observable_key", "value")
    )


OBS_SQL = """obs_days AS (
  SELECT event_type AS system, epoch_us(ts) // 86400000000 AS day,
         avg(value) AS mean_value, max(value) AS max_value, CAST(count(*) AS DOUBLE) AS n_events
  FROM events GROUP BY 1, 2),
obs_rel AS (SELECT system, day - min(day) OVER (PARTITION BY system) AS idx, mean_value, max_value, n_events FROM obs_days),
obs AS (
  SELECT system, idx, 'mean_value' AS observable_key, mean_value AS value FROM obs_rel
  UNION ALL SELECT system, idx, 'max_value', max_value FROM obs_rel
  UNION ALL SELECT system, idx, 'n_events', n_events FROM obs_rel)"""


def user_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, system, idx, value): users as systems in four classes, 3-day windows."""
    return (
        event_time(spark, sf_dir)
        .groupBy(
            F.concat(F.lit("class_"), (F.col("user_id") % 4).cast("string")).alias("category"),
            F.col("user_id").alias("system"),
            F.expr("t_us div 259200000000 - 6574").alias("idx"),
        )
        .agg(F.avg("value").alias("value"))
    )


USERS_SQL = """uw AS (
  SELECT 'class_' || CAST(user_id % 4 AS VARCHAR) AS category, user_id AS system,
         epoch_us(ts) // 259200000000 - 6574 AS idx, avg(value) AS value
  FROM events GROUP BY 1, 2, 3)"""


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, idx, x): hourly sums per event type on a full grid, empty hours are zero."""
    hours = event_time(spark, sf_dir).groupBy(
        F.col("event_type").alias("system"), F.expr("t_us div 3600000000").alias("hour")
    ).agg(F.sum("value").alias("x"))
    span = hours.agg(F.min("hour").alias("h0"), F.max("hour").alias("h1"))
    grid = (
        hours.select("system").distinct()
        .crossJoin(F.broadcast(span))
        .select("system", "h0", F.explode(F.sequence("h0", "h1")).alias("hour"))
    )
    return grid.join(hours, ["system", "hour"], "left").select(
        "system", (F.col("hour") - F.col("h0")).alias("idx"), F.coalesce("x", F.lit(0.0)).alias("x")
    )


HOURLY_SQL = """hr AS (SELECT event_type AS system, epoch_us(ts) // 3600000000 AS hour, sum(value) AS x FROM events GROUP BY 1, 2),
hspan AS (SELECT min(hour) AS h0, max(hour) AS h1 FROM hr),
hgrid AS (SELECT s.system, h0, unnest(range(h0, h1 + 1)) AS hour FROM (SELECT DISTINCT system FROM hr) s, hspan),
series AS (SELECT g.system, g.hour - g.h0 AS idx, coalesce(hr.x, 0.0) AS x FROM hgrid g LEFT JOIN hr ON hr.system = g.system AND hr.hour = g.hour)"""


# --- frames: embeddings as beads moving in a periodic box ------------------------------

def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, bead_id, chain_id, species, bead_type, mass, xu.., x.., lx..).

    Vector ``v`` is bead ``v``; frame ``f`` takes its components 3f..3f+2 as coordinates.
    """
    raw = spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("bead_id"), F.col("label").alias("bead_type"), "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(N_FRAMES - 1))).alias("frame"),
    )
    chain = F.expr("bead_id div 5")
    unwrapped = [
        (F.element_at("embedding", F.col("frame") * 3 + k + 1).cast("double") * COORD_SCALE).alias(c)
        for k, c in enumerate(("xu", "yu", "zu"))
    ]
    species = F.element_at(F.array(*[F.lit(s) for s in SPECIES]), (chain % 4 + 1).cast("int"))
    return raw.select(
        "frame", "bead_id", chain.alias("chain_id"), species.alias("species"), "bead_type",
        (F.lit(50.0) + F.lit(10.0) * F.col("bead_type")).alias("mass"), *unwrapped,
    ).select(
        "*",
        *[F.expr(f"pmod({c}u, {length}D)").alias(c) for c, length in zip("xyz", BOX)],
        *[F.lit(length).alias(f"l{c}") for c, length in zip("xyz", BOX)],
    )


FRAMES_SQL = """fr0 AS (
  SELECT CAST(f.f AS INTEGER) AS frame, vec_id AS bead_id, vec_id // 5 AS chain_id, label AS bead_type,
         ['alpha', 'beta', 'gamma', 'solute'][(vec_id // 5) % 4 + 1] AS species, 50.0 + 10.0 * label::DOUBLE AS mass,
         embedding[3 * f.f + 1]::DOUBLE * 800.0::DOUBLE AS xu, embedding[3 * f.f + 2]::DOUBLE * 800.0::DOUBLE AS yu, embedding[3 * f.f + 3]::DOUBLE * 800.0::DOUBLE AS zu
  FROM embeddings, range(21) f(f)),
fr AS (
  SELECT frame, bead_id, chain_id, bead_type, species, CAST(mass AS DOUBLE) AS mass, xu, yu, zu, 100.0::DOUBLE AS lx, 100.0::DOUBLE AS ly, 120.0::DOUBLE AS lz,
         ((xu % 100.0::DOUBLE) + 100.0::DOUBLE) % 100.0::DOUBLE AS x, ((yu % 100.0::DOUBLE) + 100.0::DOUBLE) % 100.0::DOUBLE AS y, ((zu % 120.0::DOUBLE) + 120.0::DOUBLE) % 120.0::DOUBLE AS z
  FROM fr0)"""

#: Brute-force pair distances under the minimum image, for the check queries only.
PAIR_DISTANCE_SQL = (
    "sqrt(pow((a.x - b.x) - 100.0::DOUBLE * round_even((a.x - b.x) / 100.0::DOUBLE, 0), 2)"
    " + pow((a.y - b.y) - 100.0::DOUBLE * round_even((a.y - b.y) / 100.0::DOUBLE, 0), 2)"
    " + pow((a.z - b.z) - 120.0::DOUBLE * round_even((a.z - b.z) / 120.0::DOUBLE, 0), 2))"
)


# --- profiles: line items as weighted radii --------------------------------------------

def line_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, frame, r, weight): quantity as radius, price as weight, month as frame."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("system"),
        F.expr("(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1").alias("frame"),
        (F.col("l_quantity") - 0.5).alias("r"),
        F.col("l_extendedprice").alias("weight"),
    )


LINES_SQL = """lr AS (
  SELECT l_returnflag AS system, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS frame,
         l_quantity - 0.5 AS r, l_extendedprice AS weight
  FROM lineitem)"""


# --- conditions: market segments over years --------------------------------------------

def condition_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, temperature_k, unit, value): segments as conditions, years as temperatures."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", (F.lit(290) + 5 * (F.year("o_orderdate") - 1995)).alias("temperature_k"),
        F.col("o_totalprice").alias("value"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("c_mktsegment").alias("condition"), "temperature_k", F.col("c_nationkey").alias("unit"), "value"
    )


CONDITIONS_SQL = """co AS (
  SELECT c_mktsegment AS condition, CAST(290 + 5 * (year(o_orderdate) - 1995) AS INTEGER) AS temperature_k,
         c_nationkey AS unit, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
