"""Streaming queries: the given tables as feeds, run until all available data is used."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from trajstats.plans.registry import query
from trajstats.plans.series_plans import rounded
from trajstats.plans.space_plans import TRACK_SQL, _groups, comp_sql
from trajstats.plans.views import table
from trajstats.session import ensure_checkpoint_dir
from trajstats.streaming import feeds


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/trajstats-feed-{uuid.uuid4().hex}"


def _feed(spark, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _run(spark, stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run what is there of a feed into a table, from where the last run in ``folder`` ended, and read the table."""
    folder = folder or _folder(spark)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@contextmanager
def _keyed_state(spark):
    """Timers and maps of keyed state need the RocksDB store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query("stream_thinning", "X1 S4", "SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_id >= 3 AND (event_id - 3) % 10 = 0")
def stream_thinning(spark, d):
    return _run(spark, feeds.thinned(_feed(spark, d, "events"), "event_id", 10, 3).select("event_id", "event_type", F.round("value", 6).alias("value")))


@query("stream_windowed_mean", "X2 W1 A24", """
WITH w AS (SELECT event_type, epoch_us(ts) // 21600000000 AS k, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(*)) AS sem, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, k * 6 AS start_h, round(mean, 8) AS mean, round(sd, 8) AS sd, round(sem, 8) AS sem, n FROM w""")
def stream_windowed_mean(spark, d):
    """The feed to its end, then its mark: the second run goes on from the checkpoint and closes the last windows."""
    folder = _folder(spark)
    feeds.make_marks(spark, f"{folder}/marks")
    feed = feeds.with_end(_feed(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", f"{folder}/marks")
    means = feeds.windowed_mean(feed, "at", ["event_type"], "value", "6 hours", "1 hour")
    _run(spark, means, folder)
    feeds.end_feed(spark, f"{folder}/marks")
    out = _run(spark, means, folder)
    return rounded(out.select("event_type", F.expr("unix_seconds(window_start) div 3600").alias("start_h"), "mean", "sd", "sem", "n"), "mean", "sd", "sem")


@query("stream_tracking", "X3 C5", comp_sql("SELECT frame, label FROM tr", TRACK_SQL))
def stream_tracking(spark, d):
    """The groups of all frames as a feed, a frame a second; the feed may arrive in any order."""
    folder = _folder(spark)
    g = _groups(spark, d).select(F.lit("all").alias("system"), F.col("frame").cast("long").alias("frame"), F.col("chain_id").alias("chain"), "label")
    g.write.parquet(f"{folder}/feed")
    feeds.make_marks(spark, f"{folder}/marks")
    stream = spark.readStream.schema(g.schema).parquet(f"{folder}/feed").withColumn("at", F.timestamp_seconds(F.col("frame") + 1))
    with _keyed_state(spark):
        path = feeds.followed(feeds.with_end(stream, "at", f"{folder}/marks"), "at", "1 hour")
        _run(spark, path, folder)
        feeds.end_feed(spark, f"{folder}/marks")
        out = _run(spark, path, folder)
    return out.select(F.col("frame").cast("int").alias("frame"), "label")


@query("titration_table", "C12", """
WITH a AS (SELECT 'wp_' || (p_size % 5 * 20) AS label, p_size AS t, p_retailprice AS v FROM part)
SELECT label, CAST(regexp_extract(label, '(\\d+)$', 1) AS DOUBLE) / 100 AS w_p, t, round(avg(v), 8) AS mean, count(*) AS n FROM a WHERE t BETWEEN 10 AND 40 GROUP BY ALL""")
def titration_table(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("wp_"), (F.col("p_size") % 5 * 20).cast("string")).alias("label"), F.col("p_size").alias("t"), F.col("p_retailprice").alias("v"))
    out = rows.filter("t BETWEEN 10 AND 40").groupBy("label", (F.regexp_extract("label", r"(\d+)$", 1).try_cast("double") / 100).alias("w_p"), "t").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "mean").orderBy("label", "t")
