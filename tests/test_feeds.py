"""Streams to their end: late rows, restarts and the end mark; files in and out."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajstats.plans import stream_plans
from trajstats.sources import summaries
from trajstats.streaming import feeds


def batch(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_windows_close_inside_the_stream(spark, tmp_path):
    folder, schema = str(tmp_path), "k string, s long, v double"
    feeds.make_marks(spark, f"{folder}/marks")
    batch(spark, f"{folder}/in", [("a", 10, 1.0), ("a", 50, 3.0), ("b", 130, 5.0)], schema)
    stream = feeds.with_end(spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("at", F.timestamp_seconds("s")), "at", f"{folder}/marks")
    means = feeds.windowed_mean(stream, "at", ["k"], "v", "1 minute", "10 seconds")
    show = lambda df: sorted((r.k, int(r.window_start.timestamp()), r.mean, r.n) for r in df.collect())
    assert show(stream_plans._run(spark, means, folder)) == [("a", 0, 2.0, 2)]
    # Restarted: a late row of a closed window is dropped, one of an open window counts.
    batch(spark, f"{folder}/in", [("a", 20, 100.0), ("b", 125, 7.0)], schema)
    assert show(stream_plans._run(spark, means, folder)) == [("a", 0, 2.0, 2)]
    feeds.end_feed(spark, f"{folder}/marks")
    assert show(stream_plans._run(spark, means, folder)) == [("a", 0, 2.0, 2), ("b", 120, 6.0, 2)]


def test_tracking_keeps_its_state(spark, tmp_path):
    folder, schema = str(tmp_path), "system string, frame long, chain long, label long"
    feeds.make_marks(spark, f"{folder}/marks")
    (tmp_path / "in").mkdir()
    frame = lambda f, *sets, s="x": [(s, f, c, min(g)) for g in sets for c in g]
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("at", F.timestamp_seconds(F.col("frame") + 1))
    steps = [
        frame(1, {1, 2, 3}, {4, 5}) + frame(2, {1, 9}, {2, 3, 4}) + frame(1, {7}, s="y"),
        frame(4, {1, 2}, {3, 4, 5, 6}) + frame(3, {1}, {2, 3, 4, 5}),
        frame(1, {1, 2, 3, 4, 5, 6, 7}) + frame(5, {8}, {9}) + frame(6, {1, 2, 3}),  # frame 1 again: late
    ]
    seen = []
    with stream_plans._keyed_state(spark):
        for rows in steps:
            batch(spark, f"{folder}/in", rows, schema)
            path = feeds.followed(feeds.with_end(stream, "at", f"{folder}/marks"), "at", "1 second")
            seen.append(sorted((r.system, r.frame, r.label) for r in stream_plans._run(spark, path, folder).collect()))
        feeds.end_feed(spark, f"{folder}/marks")
        last = sorted((r.system, r.frame, r.label) for r in stream_plans._run(spark, path, folder).collect())
    assert last == [("x", 1, 1), ("x", 2, 2), ("x", 3, 2), ("x", 4, 3), ("x", 5, 8), ("x", 6, 1), ("y", 1, 7)]
    assert seen[0] == [("x", 1, 1), ("y", 1, 7)] and set(seen[0]) < set(seen[1]) < set(last)


def test_thirty_files_of_two_kinds(spark, tmp_path):
    want, bad = set(), set()
    for i in range(30):
        folder = tmp_path / ("blocked" if i % 3 == 0 else "plain") / f"TEMP_{280 + i % 4 * 10}"
        folder.mkdir(parents=True, exist_ok=True)
        mode, temp = "correlated" if i % 3 == 0 else "legacy", 280 + i % 4 * 10
        if i % 2:
            lines = ["id,observable,value", f"m{i},C_Dense,{i}.5", f"m{i},dilute, {i} ", f"m{i},other,1", f"m{i},dilute,x"]
            want |= {("tidy", temp, mode, f"m{i}", "c_sg", i + 0.5), ("tidy", temp, mode, f"m{i}", "c_dil", float(i))}
            bad |= {(lines[3], "unknown observable"), (lines[4], "not a number")}
        else:
            lines = ["System,temperature,c_dense,dilute,beta,alpha", f"m{i},300,,2,{i},0.25", f"n{i},,7,,1,1", f"k{i},1"]
            want |= {("wide", 300, mode, f"m{i}", "c_sg", i + 0.25), ("wide", 300, mode, f"m{i}", "c_dil", 2.0), ("wide", temp, mode, f"n{i}", "c_sg", 7.0)}
            bad.add((lines[3], "number of fields"))
        (folder / f"table_{i}.csv").write_text("\n".join([*lines, ""]) if i != 5 else "\n".join([*lines[1:], lines[0]]))
    (tmp_path / "plain" / "TEMP_280" / "none.csv").write_text("m,1,2\n")
    bad.add(("m,1,2", "no header"))
    good, wrong = summaries.read_summaries(spark, str(tmp_path), {"c_sg": ["c_dense"], "c_dil": ["dilute"]}, {"c_sg": ("beta", "alpha")})
    assert {tuple(r)[1:] for r in good.collect()} == want
    assert {tuple(r)[1:] for r in wrong.collect()} == bad


def test_sink_replaces_partitions(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.createDataFrame([(t, i, float(i)) for t in (290, 300, 310) for i in range(20)], "temperature_k int, i int, v double")
    summaries.replace_partitions(rows, path, ["temperature_k"])
    new = rows.filter("temperature_k = 300 AND i < 5").withColumn("v", F.col("v") + 100)
    for _ in range(2):
        summaries.replace_partitions(new, path, ["temperature_k"])
        got = sorted((r.temperature_k, r.i, r.v) for r in spark.read.parquet(path).collect())
        assert got == sorted([(t, i, float(i)) for t in (290, 310) for i in range(20)] + [(300, i, i + 100.0) for i in range(5)])
    plan = spark.read.parquet(path).filter("temperature_k = 310")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(temperature_k" in plan
