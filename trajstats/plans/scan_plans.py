"""Scans, scalar expressions, sequences, mixing rules and phase rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from trajstats.functions import scalars
from trajstats.operators import contacts, mixing, phase, sequences
from trajstats.plans.registry import query
from trajstats.plans.series_plans import rounded
from trajstats.plans.views import CONDITIONS_SQL, FRAMES_SQL, condition_orders, event_time, frames, table, with_ctes
from trajstats.session import ensure_checkpoint_dir, small_side, spread
from trajstats.sources import dumps, summaries


@query("frame_slice", "S1 P24", with_ctes(FRAMES_SQL, select="SELECT frame, bead_id, round(x, 6) AS x FROM fr WHERE frame >= 3 AND frame < 18 AND (frame - 3) % 4 = 0"))
def frame_slice(spark, d):
    return dumps.frame_slice(frames(spark, d), "frame", 3, 18, 4).select("frame", "bead_id", F.round("x", 6).alias("x"))


@query("real_time_stride", "P24", """
WITH t AS (SELECT event_id, (epoch_us(ts) // 60000000) * 0.05::DOUBLE + CASE WHEN event_id % 7 = 0 THEN 1e-6 ELSE 0 END AS t_ns FROM events)
SELECT event_id, round(t_ns, 6) AS t_ns FROM t WHERE abs(t_ns / 0.2::DOUBLE - round_even(t_ns / 0.2::DOUBLE, 0)) < 1e-5 AND event_id % 7 <> 0""")
def real_time_stride(spark, d):
    """Minutes as 0.05 ns each, some off the grid by more than rounding; kept at multiples of 0.2 ns."""
    t = F.expr("t_us div 60000000") * F.lit(0.05) + F.when(F.col("event_id") % 7 == 0, 1e-6).otherwise(0.0)
    rows = event_time(spark, d).select("event_id", t.alias("t_ns"))
    # Times are near 1.4e6 ns, where neighbouring doubles differ by 2e-10.
    return rounded(dumps.on_multiples(rows, "t_ns", 0.2, 1e-6), "t_ns", places=6)


def _dump_lines(spark, d) -> DataFrame:
    """Line items as a dump: one frame per order with a header line, cut into splits."""
    l = table(spark, d, "lineitem")
    file, split = (F.col("l_orderkey") % 7).cast("string"), F.floor(F.col("l_orderkey") / 500).cast("long")
    head = l.select(file.alias("file"), split.alias("split"), (F.col("l_orderkey") * 100).alias("pos"), F.concat(F.lit("time "), F.col("l_orderkey").cast("string")).alias("value")).distinct()
    body = l.select(
        file.alias("file"), F.floor((F.col("l_orderkey") * 100 + F.col("l_linenumber") * 14) / 50000).cast("long").alias("split"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"),
        F.concat_ws("  ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.format_string("%.2f", "l_quantity")).alias("value"),
    )
    return head.unionByName(body)


@query("framed_rows", "S2", """
SELECT l_orderkey AS time, l_linenumber AS "row", l_partkey AS part, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem""")
def framed_rows(spark, d):
    lines = _dump_lines(spark, d)
    header = F.regexp_extract("value", r"^time (\d+)$", 1).try_cast("long")
    out = dumps.framed_rows(lines, F.col("value").startswith("time "), ["row", "part", "supp", "qty"], ["int", "long", "long", "double"], header)
    return out.select("time", "row", "part", "qty")


@query("stress_rows", "S3", """
SELECT l_orderkey AS atom, CAST(l_quantity AS DOUBLE) AS pxx, CAST(l_tax AS DOUBLE) AS pyz FROM lineitem WHERE l_linenumber > 1""")
def stress_rows(spark, d):
    l = table(spark, d, "lineitem")
    n = F.when(F.col("l_linenumber") > 1, 9).otherwise(7)
    line = F.concat_ws(" ", "l_orderkey", F.lit("1 2 3 4 5"), F.col("l_quantity").cast("string"), F.array_join(F.array_repeat(F.lit("0.5"), 4), " "), F.col("l_tax").cast("string"), F.array_join(F.array_repeat(F.lit("9"), n - 5), " "))
    out = dumps.stress_rows(l.select(F.split(line, r"\s+").alias("fields")))
    return out.select("atom", "pxx", "pyz")


@query("thinned_frames", "S4", with_ctes(FRAMES_SQL, select="SELECT frame, count(*) AS n FROM fr WHERE frame >= 2 AND (frame - 2) % 5 = 0 GROUP BY 1"))
def thinned_frames(spark, d):
    return dumps.stride(frames(spark, d), "frame", 5, 2).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("pair_blocks", "S5", """
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS i, CAST(l_quantity AS INTEGER) % 5 AS j, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)
SELECT b AS a, a AS b, j AS i, i AS j, value FROM c WHERE a IN ('R', 'A') AND b = 'F' UNION ALL SELECT a, b, i, j, value FROM c WHERE a = 'N' AND b = 'O'""")
def pair_blocks(spark, d):
    cells = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_linenumber").alias("i"), (F.col("l_quantity").cast("int") % 5).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    names = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    wanted = names.select(F.when(F.col("l_returnflag") == "N", "N").otherwise("F").alias("a"), F.when(F.col("l_returnflag") == "N", "O").otherwise(F.col("l_returnflag")).alias("b")).distinct()
    return dumps.pair_blocks(cells, "a", "b", wanted)


@query("chain_stress", "S6 W1", """
SELECT epoch_us(l_shipdate) // 86400000000 AS step, p_size AS chain_id, round(sum(l_quantity), 4) AS pxx, round(sum(l_discount), 4) AS pyy, epoch_us(l_shipdate) // 86400000000 // 50 * 50 AS window_start
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 5""")
def chain_stress(spark, d):
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")
    stress = table(spark, d, "lineitem").select(day.alias("step"), F.col("l_partkey").alias("atom"), F.col("l_quantity").alias("pxx"), F.col("l_discount").alias("pyy"))
    chains = table(spark, d, "part").select(F.col("p_partkey").alias("atom"), F.col("p_size").alias("chain_id"))
    out = dumps.chain_stress(stress, chains, [], "step", F.expr("step div 50 * 50"), ["pxx", "pyy"])
    return rounded(out, "pxx", "pyy", places=4)


def _paths(spark, d) -> DataFrame:
    ev = event_time(spark, d)
    k = F.col("event_id")
    t = F.when(k % 2 == 0, (k % 40 * 50).cast("string")).otherwise(F.concat((k % 40 * 50).cast("string"), F.lit(".0")))
    return ev.select(k, F.concat(F.lit("/data/TEMP_"), (280 + k % 5 * 5).cast("string"), F.when(k % 3 == 0, "/Corr").otherwise("/plain"), F.lit("/Profile_"), F.col("event_type"), F.lit("_"), t, F.lit(".csv")).alias("path"), "value", "t_us")


@query("path_labels", "S7 S8 P26", """
SELECT event_id, event_id % 40 * 50 AS time_label, 'Profile_' || event_type AS prefix, CAST(280 + event_id % 5 * 5 AS INTEGER) AS temperature_k, CASE WHEN event_id % 3 = 0 THEN 'correlated' ELSE 'legacy' END AS mode,
       event_type AS system, user_id AS start FROM events""")
def path_labels(spark, d):
    p = F.col("path")
    system, start = dumps.tag_parts(F.col("tag"))
    tags = table(spark, d, "events").select("event_id", F.concat("event_type", F.lit("_t"), F.col("user_id").cast("string")).alias("tag"))
    return _paths(spark, d).join(tags, "event_id").select(
        "event_id", dumps.time_label(p).alias("time_label"), dumps.path_prefix(p).alias("prefix"), dumps.path_temperature(p).alias("temperature_k"), dumps.path_mode(p).alias("mode"), system.alias("system"), start.alias("start"))


@query("alias_columns", "S9", """
SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_custkey % 2 = 0 THEN o_custkey + 0.5 END, 4) AS c_sg FROM orders""")
def alias_columns(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("c_dense"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("double")).alias("beta"), F.lit(0.5).alias("alpha"))
    value = F.coalesce(scalars.coalesce_aliases(o.columns, ["c_sg", "c_dense", "dense"]), F.col("beta") + F.col("alpha"))
    return o.select("o_orderkey", F.round(value, 4).alias("c_sg"))


SUMMARY_SQL = CONDITIONS_SQL + """,
cl AS (SELECT condition, temperature_k, unit, floor(avg(value))::BIGINT AS dense, count(*) AS n, temperature_k % 10 = 5 AS tidy FROM co GROUP BY 1, 2, 3)"""


def _summary_lines(spark, d) -> DataFrame:
    """(dir, kind, line): a folder for each condition and temperature with a tidy or a wide file of its units, some lines malformed."""
    cells = condition_orders(spark, d).groupBy("condition", "temperature_k", "unit").agg(F.floor(F.avg("value")).cast("long").alias("dense"), F.count(F.lit(1)).alias("n"))
    tidy = F.col("temperature_k") % 10 == 5
    text = lambda *parts: F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    u, dense, n = F.col("unit"), F.col("dense"), F.col("n")
    broken = F.col("unit") % 11 == 3
    tidy_lines = F.array(F.when(broken, text(u, "dense")).otherwise(text(u, "C_Dense", dense)), text(u, "dilute", n))
    wide_lines = F.array(F.when(broken, text(u, "x", n, F.lit(""), F.lit(""))).when(u % 2 == 0, text(u, dense, n, F.lit(""), F.lit(""))).otherwise(text(u, F.lit(""), n, dense, F.lit(0.5))))
    where = F.concat(F.col("condition"), F.when(F.col("unit") % 2 == 0, "/corr").otherwise("/plain"), F.lit("/TEMP_"), F.col("temperature_k").cast("string"))
    body = cells.select(where.alias("dir"), tidy.alias("tidy"), F.explode(F.when(tidy, tidy_lines).otherwise(wide_lines)).alias("line"))
    head = cells.select(where.alias("dir"), tidy.alias("tidy")).distinct().select("dir", "tidy", F.when(F.col("tidy"), "id,observable,value").otherwise("System, dense , c_dilute,beta,alpha").alias("line"))
    return body.unionByName(head).select(F.replace("dir", F.lit("/"), F.lit("_")).alias("dir"), "line")


@query("summary_files", "S8 S9", with_ctes(SUMMARY_SQL, """
rw AS (SELECT *, unit % 11 = 3 AS broken, CASE WHEN unit % 2 = 0 THEN 'correlated' ELSE 'legacy' END AS mode FROM cl),
ob AS (SELECT 'tidy' AS kind, condition, temperature_k, mode, unit, 'c_sg' AS observable, dense::DOUBLE AS value FROM rw WHERE tidy AND NOT broken UNION ALL SELECT 'tidy', condition, temperature_k, mode, unit, 'c_dil', n::DOUBLE FROM rw WHERE tidy
  UNION ALL SELECT 'wide', condition, temperature_k, mode, unit, 'c_sg', CASE WHEN unit % 2 = 0 THEN dense ELSE dense + 0.5::DOUBLE END FROM rw WHERE NOT tidy AND NOT broken UNION ALL SELECT 'wide', condition, temperature_k, mode, unit, 'c_dil', n::DOUBLE FROM rw WHERE NOT tidy),
bd AS (SELECT CASE WHEN tidy THEN 'number of fields' ELSE 'not a number' END AS kind, condition, temperature_k, mode, count(*)::DOUBLE AS value FROM rw WHERE broken GROUP BY ALL)""", select="""
SELECT kind, condition, temperature_k, mode, unit::VARCHAR AS id, observable, value FROM ob UNION ALL SELECT kind, condition, temperature_k, mode, NULL, 'malformed', value FROM bd"""))
def summary_files(spark, d):
    """Tables written as many small files of two kinds and read back as one; malformed lines are counted by reason."""
    folder = f"{ensure_checkpoint_dir(spark)}/trajstats-summaries-{uuid.uuid4().hex}"
    _summary_lines(spark, d).repartition("dir").write.partitionBy("dir").text(folder)
    good, bad = summaries.read_summaries(spark, folder, {"c_sg": ["dense", "c_dense"], "c_dil": ["dilute", "c_dilute"]}, {"c_sg": ("beta", "alpha")})
    condition = F.regexp_extract("file", "dir=([A-Z%0-9]+)_", 1)
    counted = bad.groupBy("file", "reason").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.col("reason").alias("kind"), condition.alias("condition"), dumps.path_temperature(F.col("file")).alias("temperature_k"), dumps.path_mode(F.col("file")).alias("mode"), F.lit(None).cast("string").alias("id"), F.lit("malformed").alias("observable"), "value")
    return good.select("kind", condition.alias("condition"), "temperature_k", "mode", "id", "observable", "value").unionByName(counted)


@query("partitioned_sink", "S13", with_ctes(CONDITIONS_SQL, select="""
SELECT temperature_k, condition, unit, round(CASE WHEN temperature_k = 300 THEN 2 ELSE 1 END * m, 6) AS mean, n FROM (SELECT temperature_k, condition, unit, avg(value) AS m, count(*) AS n FROM co WHERE temperature_k >= 295 GROUP BY 1, 2, 3)"""))
def partitioned_sink(spark, d):
    """Written by temperature, one temperature replaced, that written once more; read back from 295 K on."""
    path = f"{ensure_checkpoint_dir(spark)}/trajstats-sink-{uuid.uuid4().hex}"
    means = condition_orders(spark, d).groupBy("temperature_k", "condition", "unit").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    summaries.replace_partitions(means, path, ["temperature_k"])
    doubled = means.filter("temperature_k = 300").withColumn("mean", 2 * F.col("mean"))
    for _ in range(2):
        summaries.replace_partitions(doubled, path, ["temperature_k"])
    out = spark.read.parquet(path).filter("temperature_k >= 295")
    return rounded(out.select(F.col("temperature_k").cast("int").alias("temperature_k"), "condition", "unit", "mean", "n"), "mean", places=6)


IDS_SQL = "CASE c_custkey % 8 WHEN 0 THEN 'sg_X' WHEN 1 THEN 'D' || c_custkey WHEN 2 THEN 'ND' || c_custkey WHEN 3 THEN 'DSM_AVG' WHEN 4 THEN 'NDSM' WHEN 5 THEN 'dsm_' || c_name WHEN 6 THEN 'ndsm_x' ELSE 'other' END"


@query("row_mapping", "S10 U6", f"""
WITH r AS (SELECT c_custkey, {IDS_SQL} AS id, c_acctbal, c_custkey % 8 AS k FROM customer)
SELECT c_custkey, id, ['control', 'DSM', 'NDSM', 'DSM', 'NDSM', 'DSM', 'NDSM', 'unknown'][k + 1] AS condition_type, ['control', 'individual', 'individual', 'average', 'aggregate', 'individual', 'individual', 'unknown'][k + 1] AS subtype,
       ['individual_compound', 'individual_compound', 'individual_compound', 'arithmetic_class_average', 'category_aggregate', 'individual_compound', 'individual_compound', 'individual_compound'][k + 1] AS row_type,
       round(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -1 END, 4) AS c_sg FROM r WHERE k NOT IN (4, 7)""")
def row_mapping(spark, d):
    k = F.col("c_custkey") % 8
    ids = (F.when(k == 0, "sg_X").when(k == 1, F.concat(F.lit("D"), "c_custkey")).when(k == 2, F.concat(F.lit("ND"), "c_custkey")).when(k == 3, "DSM_AVG").when(k == 4, "NDSM")
           .when(k == 5, F.concat(F.lit("dsm_"), "c_name")).when(k == 6, "ndsm_x").otherwise("other"))
    rows = table(spark, d, "customer").select("c_custkey", ids.alias("id"), F.lit(-1.0).alias("c_fit"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_calc"))
    out = rows.filter(phase.kept_row(F.col("id"), "sg_X")).withColumn("r", phase.row_class(F.col("id"), "sg_X"))
    return out.select("c_custkey", "id", "r.*", F.round(F.coalesce("c_calc", "c_fit"), 4).alias("c_sg"))


@query("completeness", "S11", """
WITH e AS (SELECT u.u AS user_id, k.k AS event_type, CAST(10 AS BIGINT) AS n_expected FROM (SELECT DISTINCT user_id AS u FROM events) u, (SELECT DISTINCT event_type AS k FROM events) k),
f AS (SELECT user_id, event_type, count(*) AS n_found, count(*) FILTER (floor(value) = 0) AS n_empty, count(*) FILTER (epoch_us(ts) < 1704153600000000) AS n_stale FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n_expected, coalesce(n_found, 0) AS n_found, coalesce(n_empty, 0) AS n_empty, coalesce(n_stale, 0) AS n_stale,
       coalesce(n_found, 0) >= n_expected AND coalesce(n_empty, 0) = 0 AND coalesce(n_stale, 0) = 0 AS complete FROM e LEFT JOIN f USING (user_id, event_type)""")
def completeness(spark, d):
    ev = event_time(spark, d)
    kinds = small_side(ev.select("event_type").distinct())
    expected = ev.select("user_id").distinct().crossJoin(kinds).withColumn("n_expected", F.lit(10).cast("long"))
    found = ev.select("user_id", "event_type", F.floor("value").alias("size"), "t_us")
    return dumps.completeness(expected, found, ["user_id", "event_type"], "size", "t_us", 1704153600000000)


@query("first_failures", "S12", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT * FROM l WHERE regexp_matches(line, '(?i)the .*ing|copyright'))
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, arg_min(line, pos) AS line, count(*) AS n_hits FROM h GROUP BY 1""")
def first_failures(spark, d):
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return dumps.first_failures(lines, "doc_id", "pos", "line", "(?i)the .*ing|copyright")


@query("interval_parts", "P27", """
SELECT l_orderkey, l_linenumber, least(l_partkey, CASE WHEN l_linenumber = 1 THEN l_partkey ELSE l_suppkey END) AS "start", greatest(l_partkey, CASE WHEN l_linenumber = 1 THEN l_partkey ELSE l_suppkey END) AS "end" FROM lineitem""")
def interval_parts(spark, d):
    l = table(spark, d, "lineitem").withColumn("text", F.when(F.col("l_linenumber") == 1, F.col("l_partkey").cast("string")).otherwise(F.concat_ws("-", "l_partkey", "l_suppkey")))
    start, end = dumps.interval_parts(F.col("text"))
    return l.select("l_orderkey", "l_linenumber", start.alias("start"), end.alias("end"))


# --- species, scalars ------------------------------------------------------------------

@query("species_by_shape", "P1 M4", """
WITH c AS (SELECT l_orderkey AS chain, count(*) AS n, min(l_partkey) AS lo FROM lineitem GROUP BY 1)
SELECT CASE WHEN lo <= 5 THEN 'RNA' WHEN n = 1 THEN 'SM' WHEN n >= 6 THEN 'long' ELSE 'Protein' END AS species, count(*) AS n_chains, CAST(sum(n) AS BIGINT) AS n_beads FROM c GROUP BY 1""")
def species_by_shape(spark, d):
    chains = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("lo"))
    species = F.when(F.col("lo") <= 5, "RNA").when(F.col("n") == 1, "SM").when(F.col("n") >= 6, "long").otherwise("Protein")
    return chains.groupBy(species.alias("species")).agg(F.count(F.lit(1)).alias("n_chains"), F.sum("n").alias("n_beads"))


@query("species_by_range", "P2 M4", """
WITH w AS (SELECT max(user_id) // (SELECT count(*) FROM nation) + 1 AS w FROM events)
SELECT n.n_name AS species, count(*) AS n, count(DISTINCT user_id) AS n_chains FROM events e, w JOIN nation n ON user_id BETWEEN n_nationkey * w AND n_nationkey * w + w - 1 GROUP BY 1""")
def species_by_range(spark, d):
    n = table(spark, d, "nation")
    per_chain = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    width = per_chain.agg((F.max("user_id")).alias("top")).crossJoin(n.agg(F.count(F.lit(1)).alias("ranges"))).select(F.expr("top div ranges + 1").alias("w"))  # one row
    ranges = n.crossJoin(width).select(F.col("n_name").alias("species"), (F.col("n_nationkey") * F.col("w")).alias("lo"), (F.col("n_nationkey") * F.col("w") + F.col("w") - 1).alias("hi"))
    out = per_chain.join(small_side(ranges, 1000), (F.col("user_id") >= F.col("lo")) & (F.col("user_id") <= F.col("hi")))
    return out.groupBy("species").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_chains"))


@query("wrapped_distances", "P3 P4 P5 P6", with_ctes(FRAMES_SQL, select="""
SELECT frame, bead_id, round(sqrt(pow((x - 10) - 100.0 * round_even((x - 10) / 100.0, 0), 2) + pow((y - 20) - 100.0 * round_even((y - 20) / 100.0, 0), 2) + pow((z - 30) - 120.0 * round_even((z - 30) / 120.0, 0), 2)), 6) AS r FROM fr"""))
def wrapped_distances(spark, d):
    deltas = [scalars.minimum_image(F.col(c) - o, F.col(f"l{c}")) for c, o in (("x", 10), ("y", 20), ("z", 30))]
    return frames(spark, d).select("frame", "bead_id", F.round(scalars.distance(*deltas), 6).alias("r"))


@query("unit_factors", "P7", """
SELECT event_id, round(CASE event_type WHEN 'click' THEN value * 1e9 WHEN 'view' THEN value * 1e3 WHEN 'error' THEN value * 1e-3 ELSE value END, 6) AS t_ns, round(value * 20e-6, 9) AS step_ns, round(value * 101325e-30 / 1e-24, 10) AS pa FROM events""")
def unit_factors(spark, d):
    unit = F.when(F.col("event_type") == "click", "s").when(F.col("event_type") == "view", "us").when(F.col("event_type") == "error", "ps").otherwise("ns")
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(scalars.time_to_ns(v, unit), 6).alias("t_ns"), F.round(scalars.step_to_ns(v), 9).alias("step_ns"), F.round(scalars.stress_to_pascal(v, F.lit(1e6)), 10).alias("pa"))


@query("safe_ratios", "P8 P9", """
WITH x AS (SELECT user_id, sum(value) FILTER (event_type = 'click') AS a, coalesce(sum(value) FILTER (event_type = 'view' AND value > 100), 0) AS b FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN b <> 0 THEN a / b END, 6) AS ratio, round(coalesce(CASE WHEN b <> 0 THEN (a - b) / b END, 0), 6) AS diff, CASE WHEN b > 0 THEN round(-ln(b), 8) END AS nl, CASE WHEN a > 0 AND b > 0 THEN round(ln(a / b), 8) END AS lr FROM x""")
def safe_ratios(spark, d):
    v = F.col("value")
    x = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", v)).alias("a"), F.coalesce(F.sum(F.when((F.col("event_type") == "view") & (v > 100), v)), F.lit(0.0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select("user_id", F.round(scalars.safe_ratio(a, b), 6).alias("ratio"), F.round(scalars.normalized_difference(a, b), 6).alias("diff"), F.round(scalars.neg_log(b), 8).alias("nl"), F.round(scalars.log_ratio(a, b), 8).alias("lr"))


@query("stokes_einstein", "P12", """
SELECT event_id, round(CASE WHEN value > 0 THEN 1.380649e-23 * 300 / (6 * pi() * value * 1e-3 * 2e-9) END * 1e12, 6) AS d, round(CASE WHEN value > 0 THEN 1.380649e-23 * 300 / (6 * pi() * value * 1e-3 * 2e-9) * sqrt(pow(0.1 / value, 2) + 0.0025) END * 1e12, 6) AS d_sem FROM events""")
def stokes_einstein(spark, d):
    eta, r = F.col("value") * 1e-3, F.lit(2e-9)
    out = table(spark, d, "events").withColumn("d", scalars.stokes_einstein(F.lit(300.0), eta, r))
    err = scalars.stokes_einstein_sem(F.col("d"), eta, F.lit(1e-4), r, F.lit(1e-10))
    return out.select("event_id", F.round(F.col("d") * 1e12, 6).alias("d"), F.round(err * 1e12, 6).alias("d_sem"))


FIT_ROWS_SQL = CONDITIONS_SQL + """,
fr AS (SELECT condition, temperature_k, unit, avg(value) / 1000 AS b, avg(value) / 1000 * 0.95 AS a, stddev_samp(value) / 10000 AS se_a, stddev_samp(value) / 8000 AS se_b, count(*) / 100.0 AS cov_ab FROM co GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


def _fit_rows(spark, d) -> DataFrame:
    g = condition_orders(spark, d).groupBy("condition", "temperature_k", "unit").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.select("condition", "temperature_k", "unit", (F.col("m") / 1000).alias("b"), (F.col("m") / 1000 * 0.95).alias("a"), (F.col("s") / 10000).alias("se_a"), (F.col("s") / 8000).alias("se_b"), (F.col("n") / 100.0).alias("cov_ab"))


@query("interface_scalars", "P13 M16", with_ctes(FIT_ROWS_SQL, """
gr AS (SELECT *, abs(b + a) AS dense, abs(b - a) AS dilute, CASE WHEN b - a >= 0 THEN 1 ELSE -1 END AS sg FROM fr),
gg AS (SELECT *, -sg / dilute - 1 / dense AS ga, sg / dilute - 1 / dense AS gb FROM gr)""", select="""
SELECT condition, temperature_k, unit, round(dense, 6) AS dense, round(dilute, 6) AS dilute, round(sqrt(greatest(0, se_a * se_a + se_b * se_b + 2 * cov_ab)), 6) AS dense_sem, round(sqrt(greatest(0, se_a * se_a + se_b * se_b - 2 * cov_ab)), 6) AS dilute_sem,
       round(dense / dilute, 6) AS partition, round(1.3806e-23 * 6.022e23 * temperature_k * ln(dilute / dense), 4) AS d_g,
       round(1.3806e-23 * 6.022e23 * temperature_k * sqrt(greatest(0, ga * ga * se_a * se_a + gb * gb * se_b * se_b + 2 * ga * gb * cov_ab)), 4) AS d_g_sem FROM gg"""))
def interface_scalars(spark, d):
    out = phase.interface_scalars(_fit_rows(spark, d), F.col("temperature_k"))
    out = rounded(out.drop("a", "b", "se_a", "se_b", "cov_ab"), "dense", "dilute", "dense_sem", "dilute_sem", "partition", places=6)
    return rounded(out, "d_g", "d_g_sem", places=4)


@query("geometry_concentrations", "P14", """
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Protein' WHEN 1 THEN 'RNA' ELSE 'SG' END AS label, 100.0::DOUBLE + p_size AS r, 10.0::DOUBLE + p_size % 7 AS w, p_retailprice * 1e-18 AS im, p_retailprice * 3e-19 AS om FROM part),
q AS (SELECT *, 4.0::DOUBLE / 3 * pi() * pow((r + w) * 1e-8, 3) AS v, 4 * pi() * pow((r + w) * 1e-8, 2) * sqrt(4 + 1) * 1e-8 AS vs, CASE label WHEN 'Protein' THEN 108 WHEN 'RNA' THEN 12 ELSE 120 END AS ref FROM p)
SELECT p_partkey, round(im / v, 6) AS dense_calc, round(im / (v * v) * vs, 6) AS dense_calc_sem, round(om / abs((om + im) / ref - v), 6) AS dilute_calc, round(abs(om / pow(abs((om + im) / ref - v), 2) * vs), 6) AS dilute_calc_sem FROM q""")
def geometry_concentrations(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k, F.when(k % 3 == 0, "Protein").when(k % 3 == 1, "RNA").otherwise("SG").alias("label"), (100.0 + F.col("p_size")).alias("r_fit"), (10.0 + F.col("p_size") % 7).alias("w_fit"), F.lit(2.0).alias("se_r"), F.lit(1.0).alias("se_w"),
        (F.col("p_retailprice") * 1e-18).alias("inner_mass"), (F.col("p_retailprice") * 3e-19).alias("outer_mass"))
    out = phase.geometry_concentrations(rows)
    return rounded(out.select("p_partkey", "dense_calc", "dense_calc_sem", "dilute_calc", "dilute_calc_sem"), "dense_calc", "dense_calc_sem", "dilute_calc", "dilute_calc_sem", places=6)


@query("pair_potential", "P15 M19", """
WITH p AS (SELECT p_partkey, 0.1::DOUBLE + p_size / 50.0 AS eps, 4.0::DOUBLE + p_size / 25.0 AS sig, 12.0::DOUBLE + p_size / 25.0 AS rc FROM part),
g AS (SELECT p.*, 4.0::DOUBLE + 0.5 * k.k AS r FROM p, range(20) k(k)),
a AS (SELECT *, 2 * pow(rc / sig, 4) * pow(3.0 / (2 * (pow(rc / sig, 4) - 1)), 3) AS alpha FROM g)
SELECT p_partkey, CAST(r AS DOUBLE) AS r, round(CASE WHEN r < rc THEN eps * alpha * (pow(sig / r, 4) - 1) * pow(pow(rc / r, 4) - 1, 2) ELSE 0 END, 6) AS phi FROM a""")
def pair_potential(spark, d):
    p = table(spark, d, "part").select("p_partkey", (0.1 + F.col("p_size") / 50.0).alias("eps"), (4.0 + F.col("p_size") / 25.0).alias("sig"), (12.0 + F.col("p_size") / 25.0).alias("rc"))
    g = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("r", 4.0 + 0.5 * F.col("k"))
    phi = scalars.pair_energy(F.col("r"), F.col("eps"), F.col("sig"), F.lit(1.0), F.lit(2.0), F.col("rc"))
    return g.select("p_partkey", "r", F.round(phi, 6).alias("phi"))


PHASE_SQL = CONDITIONS_SQL + """,
ph0 AS (SELECT condition, temperature_k, unit, avg(value) / 499 AS c_sg, (avg(value) - 240000) / 999983 AS c_dil, 200.0::DOUBLE + count(*) AS r_sg, 60.0::DOUBLE + unit AS w_sg, 0.005::DOUBLE * (unit - 2) AS gamma, 50000.0::DOUBLE AS meff,
  stddev_samp(value) / 5000 AS c_sg_sd, 0.02::DOUBLE AS c_dil_sd, 2.0::DOUBLE AS r_sg_sd, 0.01::DOUBLE AS gamma_sd FROM co GROUP BY 1, 2, 3),
ph1 AS (SELECT *, concat_ws(';', CASE WHEN c_dil < 0 AND c_dil >= -0.05 THEN 'clamped_small_negative_c_dil_to_zero' END, CASE WHEN c_dil < -0.05 THEN 'hard_invalid_negative_c_dil' END, CASE WHEN gamma < 0 THEN 'hard_invalid_gamma' END) AS wt,
  c_dil < -0.05 OR gamma < 0 AS invalid, CASE WHEN c_dil < 0 AND c_dil >= -0.05 THEN 0 ELSE c_dil END AS cd FROM ph0),
ph2 AS (SELECT *, 2 * (gamma * 1e-3) * (meff * 1e-3 / c_sg) / ((r_sg * 1e-10) * 8.314462618 * temperature_k) AS s FROM ph1),
ph3 AS (SELECT *, cd * exp(-s) AS cdi, CASE WHEN gamma > 0 THEN s * sqrt(pow(gamma_sd / gamma, 2) + pow(c_sg_sd / c_sg, 2) + pow(r_sg_sd / r_sg, 2)) END AS s_sd FROM ph2),
ph AS (SELECT *, CASE WHEN cd = 0 THEN exp(-s) * c_dil_sd WHEN cd > 0 THEN cdi * sqrt(pow(c_dil_sd / cd, 2) + pow(coalesce(s_sd, 0), 2)) END AS cdi_sd FROM ph3)"""


def _phase_rows(spark, d) -> DataFrame:
    g = condition_orders(spark, d).groupBy("condition", "temperature_k", "unit").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = g.select(
        "condition", "temperature_k", "unit", (F.col("m") / 499).alias("c_sg"), ((F.col("m") - 240000) / 999983).alias("c_dil"), (200.0 + F.col("n")).alias("r_sg"), (60.0 + F.col("unit")).alias("w_sg"),
        (0.005 * (F.col("unit") - 2)).alias("gamma"), F.lit(50000.0).alias("meff"), (F.col("s") / 5000).alias("c_sg_sd"), F.lit(0.02).alias("c_dil_sd"), F.lit(2.0).alias("r_sg_sd"), F.lit(0.01).alias("gamma_sd"))
    return phase.curvature_corrected(rows, interface_limit=0.35)


@query("curvature_corrected", "P17", with_ctes(PHASE_SQL, select="""
SELECT condition, temperature_k, unit, round(s, 6) AS s, round(cdi, 8) AS c_dil_inf, round(c_sg - cdi, 6) AS delta_c, round((c_sg + cdi) / 2, 6) AS c_bar, round(w_sg / r_sg, 8) AS interface_ratio, w_sg / r_sg >= 0.35 AS flag_large_interface_ratio,
       s >= 0.1 AS flag_large_curvature, c_sg - cdi <= 0 AS flag_negative_delta_c, round(cdi_sd, 8) AS c_dil_inf_sd, round(sqrt(pow(coalesce(c_sg_sd, 0), 2) + pow(coalesce(cdi_sd, 0), 2)), 6) AS delta_c_sd FROM ph"""))
def curvature_corrected(spark, d):
    out = _phase_rows(spark, d).select("condition", "temperature_k", "unit", "s", "delta_c", "c_bar", "delta_c_sd", F.round("c_dil_inf", 8).alias("c_dil_inf"), F.round("interface_ratio", 8).alias("interface_ratio"),
                                       "flag_large_interface_ratio", "flag_large_curvature", "flag_negative_delta_c", F.round("c_dil_inf_sd", 8).alias("c_dil_inf_sd"))
    return rounded(out, "s", "delta_c_sd", "delta_c", "c_bar", places=6)


@query("validity_flags", "P18", with_ctes(PHASE_SQL, select="SELECT condition, temperature_k, unit, round(cd, 8) AS c_dil, invalid, wt AS warning_text FROM ph"))
def validity_flags(spark, d):
    return _phase_rows(spark, d).select("condition", "temperature_k", "unit", F.round("c_dil", 8).alias("c_dil"), "invalid", "warning_text")


@query("profile_quality", "P19", """
WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS sg, p_size - 5.0::DOUBLE AS r, p_size % 11 * 6.0::DOUBLE - 6 AS w, 15.0::DOUBLE AS rg, p_retailprice AS df, (p_size % 10) * 1.5::DOUBLE AS dc FROM part),
q AS (SELECT p_partkey, list_filter([CASE WHEN r > 0 THEN NULL ELSE 'r_positive' END, CASE WHEN w > 0 THEN NULL ELSE 'w_positive' END, CASE WHEN r > 0 AND w > 0 AND w / r > 3 THEN 'w_over_r' END,
  CASE WHEN sg AND r > 0 AND NOT (r / rg BETWEEN 0.05 AND 3.0) THEN 'phi_r' END, CASE WHEN sg AND dc > 0 AND df / dc > 100 THEN 'dense_ratio' END], lambda x: x IS NOT NULL) AS failed FROM p)
SELECT p_partkey, array_to_string(failed, ';') AS failed, len(failed) = 0 AS passed FROM q""")
def profile_quality(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(k, F.when(k % 2 == 0, "SG").otherwise("RNA").alias("label"), (size - 5.0).alias("r_fit"), (size % 11 * 6.0 - 6).alias("w_fit"), F.lit(15.0).alias("rg"), F.col("p_retailprice").alias("dense_fit"), (size % 10 * 1.5).alias("dense_calc"))
    return phase.profile_quality(rows).select("p_partkey", F.array_join("failed", ";").alias("failed"), "passed")


@query("equilibration_audit", "P20", """
SELECT event_id, CASE WHEN value > 400 THEN 'indeterminate' WHEN value <= 50 AND value / 300 <= 0.3 THEN 'agree_with_default' WHEN value <= 90 AND value / 300 <= 0.3 THEN 'later_than_default_soft' ELSE 'later_than_default_hard' END AS audit FROM events""")
def equilibration_audit(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", scalars.equilibration_audit(F.when(v <= 400, v), v / 300, 50, 90, 0.3).alias("audit"))


@query("complete_features", "P22", """
WITH w AS (SELECT user_id % 50 AS id, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS sem, max(value) FILTER (value > 200) AS peak FROM events GROUP BY 1)
SELECT id, round(mean, 8) AS mean_value FROM w""")
def complete_features(spark, d):
    v = F.col("value")
    wide = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("id")).agg(
        F.avg(v).alias("mean_value"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("SIGmean_value"), F.max(F.when(v > 1e9, v)).alias("peak"), F.lit(0.0).alias("SIGpeak"), F.max(v).alias("D_{raw"), F.lit(0.0).alias("SIGD_{raw"))
    names = phase.complete_features(wide, ["mean_value", "peak", "D_{raw"], denied=["D_{raw"])
    return rounded(wide.select("id", *names), *names)


# --- sequences -------------------------------------------------------------------------

SEQ_SQL = """sq AS (SELECT doc_id, lang = 'fr' AS rna, CASE WHEN lang = 'fr' THEN replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'T', 'U') ELSE upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) END AS seq FROM documents)"""


def _seqs(spark, d) -> DataFrame:
    rna = F.col("lang") == "fr"
    return spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", rna.alias("rna"), sequences.cleaned(F.col("text"), rna).alias("seq"))


@query("letter_types", "P23 M17", with_ctes(SEQ_SQL, """
lt AS (SELECT rna, unnest(string_split(seq, '')) AS letter FROM sq),
tp AS (SELECT rna, letter, CASE WHEN rna THEN CASE WHEN strpos('ACGU', letter) > 0 THEN strpos('ACGU', letter) + 20 END ELSE CASE WHEN strpos('MGKTRADEYVIQWFSHNPCL', letter) > 0 THEN strpos('MGKTRADEYVIQWFSHNPCL', letter) END END AS bead_type FROM lt WHERE letter <> '')""", select="""
SELECT rna, letter, CAST(bead_type AS INTEGER) AS bead_type, count(*) AS n FROM tp GROUP BY 1, 2, 3"""))
def letter_types(spark, d):
    letters = sequences.positions(_seqs(spark, d), ["rna"], "seq").filter("letter <> ''").groupBy("rna", "letter").agg(F.count(F.lit(1)).alias("n"))
    return letters.select("rna", "letter", sequences.letter_type(F.col("letter"), F.col("rna")).alias("bead_type"), "n")


@query("sequence_composition", "A21", with_ctes(SEQ_SQL, """
dm AS (SELECT false AS rna, unnest(string_split('RHKDESTNQCGPAVILMFYW', '')) AS letter UNION ALL SELECT true, unnest(string_split('AUCG', ''))),
cn AS (SELECT sq.rna, letter, sum(len(seq) - len(replace(seq, letter, ''))) AS n FROM sq JOIN dm ON dm.rna = sq.rna GROUP BY 1, 2)""", select="""
SELECT rna, letter, CAST(n AS BIGINT) AS count, CASE WHEN rna THEN 'Nucleotide' WHEN letter IN ('R','H','K','D','E') THEN 'Electrostatic' WHEN letter IN ('S','T','N','Q') THEN 'Polar' WHEN letter IN ('F','Y','W') THEN 'Aromatic' ELSE 'Hydrophobic' END AS residue_class FROM cn"""))
def sequence_composition(spark, d):
    return sequences.composition(_seqs(spark, d), [], "seq", "rna")


BOND_SQL = """ps AS (SELECT doc_id, rna, unnest(string_split(seq, '')) AS letter, generate_subscripts(string_split(seq, ''), 1) AS p FROM sq),
lg AS (SELECT rna, doc_id, letter, lead(letter, 1) OVER w AS l1, lead(letter, 2) OVER w AS l2, lead(letter, 3) OVER w AS l3 FROM ps WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
bp AS (SELECT rna, doc_id, letter AS x, l1 AS y FROM lg UNION ALL SELECT rna, doc_id, letter, l2 FROM lg UNION ALL SELECT rna, doc_id, letter, l3 FROM lg WHERE NOT rna),
bd AS (SELECT rna, least(x, y) AS a, greatest(x, y) AS b, CAST(sum(doc_id % 3 + 1) AS BIGINT) AS count FROM bp WHERE y IS NOT NULL AND x <> '' GROUP BY 1, 2, 3)"""


@query("neighbour_bonds", "A22", with_ctes(SEQ_SQL, BOND_SQL, select="SELECT rna, a, b, count FROM bd"))
def neighbour_bonds(spark, d):
    return sequences.bonds(_seqs(spark, d), ["rna"], "seq", F.when(F.col("rna"), 2).otherwise(3), F.col("doc_id") % 3 + 1)


@query("type_pairs_by_filter", "A17 A22", with_ctes(SEQ_SQL, BOND_SQL, """
lc AS (SELECT rna, doc_id, letter AS t, count(*)::DOUBLE AS n, any_value(doc_id % 3 + 1)::DOUBLE AS c FROM ps WHERE letter <> '' GROUP BY 1, 2, 3),
tt AS (SELECT rna, t, sum(n * c) AS n FROM lc GROUP BY 1, 2),
ev AS (SELECT x.rna, x.t AS a, y.t AS b, CASE WHEN x.t = y.t THEN x.n * greatest(x.n - 1, 0) / 2 ELSE x.n * y.n END AS total FROM tt x JOIN tt y ON x.rna = y.rna AND x.t <= y.t),
ia AS (SELECT x.rna, x.t AS a, y.t AS b, sum(x.c * CASE WHEN x.t = y.t THEN x.n * greatest(x.n - 1, 0) / 2 ELSE x.n * y.n END) AS chain FROM lc x JOIN lc y ON x.doc_id = y.doc_id AND x.t <= y.t GROUP BY 1, 2, 3)""", select="""
SELECT ev.rna, ev.a, ev.b, total - coalesce(bd.count, 0) AS n_all, total - coalesce(chain, 0) AS n_inter, coalesce(chain, 0) - coalesce(bd.count, 0) AS n_intra FROM ev LEFT JOIN ia ON ia.rna = ev.rna AND ia.a = ev.a AND ia.b = ev.b LEFT JOIN bd ON bd.rna = ev.rna AND bd.a = ev.a AND bd.b = ev.b"""))
def type_pairs_by_filter(spark, d):
    parts = []
    for rna, reach in ((False, 3), (True, 2)):
        seqs = _seqs(spark, d).filter(F.col("rna") == rna)
        counts = sequences.positions(seqs, ["doc_id"], "seq").filter("letter <> ''").groupBy("doc_id", "letter").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.col("doc_id") % 3 + 1)
        bonded = sequences.bonds(seqs, [], "seq", F.lit(reach), F.col("doc_id") % 3 + 1)
        parts.append(sequences.type_pairs_by_filter(counts, "doc_id", "letter", "n", "copies", bonded).withColumn("rna", F.lit(rna)))
    return parts[0].unionByName(parts[1])


@query("possible_position_pairs", "A19", """
WITH n AS (SELECT count(*) AS k FROM supplier)
SELECT i.i AS i, CAST(j.j AS INTEGER) AS j, k * (k - 1) / 2 AS n_inter, CASE WHEN abs(i.i - j.j) > 5 THEN k ELSE 0 END::DOUBLE AS n_intra, k * (k - 1) / 2 + CASE WHEN abs(i.i - j.j) > 5 THEN k ELSE 0 END AS n_combined FROM n, range(40) i(i), range(40) j(j)""")
def possible_position_pairs(spark, d):
    n = table(spark, d, "supplier").count()
    return contacts.possible_position_pairs(40, 40, n, n, True, spark)


# --- mixing rules ----------------------------------------------------------------------

MIX_SQL = """hm AS (SELECT n_nationkey AS type, 0.1::DOUBLE + n_nationkey / 20.0 AS eps, 4.0::DOUBLE + n_regionkey AS sig, 1.0::DOUBLE + n_nationkey % 3 AS v, 2.0::DOUBLE + n_nationkey % 5 AS mu, 12.0::DOUBLE + n_nationkey / 10.0 AS rc FROM nation),
hp AS (SELECT a.type AS i, b.type AS j, a.eps AS e1, b.eps AS e2, a.sig AS s1, b.sig AS s2, a.v AS v1, b.v AS v2, a.mu AS m1, b.mu AS m2, a.rc AS r1, b.rc AS r2 FROM hm a JOIN hm b ON a.type <= b.type),
ks AS (SELECT *, pow(pow((pow(e1 * pow(s1, 12), 1.0::DOUBLE / 13) + pow(e2 * pow(s2, 12), 1.0::DOUBLE / 13)) / 2, 13), 1.0::DOUBLE / 6) AS kong FROM hp),
mx AS (SELECT i, j, 'eps' AS parameter, 'LB' AS rule, sqrt(e1 * e2) AS mixed FROM ks UNION ALL SELECT i, j, 'eps', 'WH', 2 * sqrt(e1 * e2) * pow(s1, 3) * pow(s2, 3) / (pow(s1, 6) + pow(s2, 6)) FROM ks
 UNION ALL SELECT i, j, 'eps', 'FH', 2 * e1 * e2 / (e1 + e2) FROM ks UNION ALL SELECT i, j, 'eps', 'K', e1 * pow(s1, 6) * e2 * pow(s2, 6) / pow(kong, 6) FROM ks
 UNION ALL SELECT i, j, 'sig', 'LB', (s1 + s2) / 2 FROM ks UNION ALL SELECT i, j, 'sig', 'WH', pow((pow(s1, 6) + pow(s2, 6)) / 2, 1.0::DOUBLE / 6) FROM ks UNION ALL SELECT i, j, 'sig', 'FH', (s1 + s2) / 2 FROM ks UNION ALL SELECT i, j, 'sig', 'K', kong FROM ks
 UNION ALL SELECT i, j, 'v', 'G', sqrt(v1 * v2) FROM ks UNION ALL SELECT i, j, 'v', 'A', (v1 + v2) / 2 FROM ks UNION ALL SELECT i, j, 'mu', 'G', sqrt(m1 * m2) FROM ks UNION ALL SELECT i, j, 'mu', 'A', (m1 + m2) / 2 FROM ks
 UNION ALL SELECT i, j, 'rc', 'G', sqrt(r1 * r2) FROM ks UNION ALL SELECT i, j, 'rc', 'A', (r1 + r2) / 2 FROM ks),
rf AS (SELECT i, j, parameter, mixed * (1 + 0.01::DOUBLE * ((i + j) % 3)) AS value FROM mx WHERE rule IN ('FH', 'A') AND NOT (parameter = 'sig' AND rule = 'FH') AND i < 20
 UNION ALL SELECT i, j, parameter, mixed * (1 + 0.01::DOUBLE * ((i + j) % 3)) FROM mx WHERE parameter = 'sig' AND rule = 'WH' AND i < 20),
er AS (SELECT parameter, rule, sqrt(avg(pow(mixed - value, 2))) AS rmse FROM mx JOIN rf USING (i, j, parameter) GROUP BY 1, 2),
bs AS (SELECT parameter, rule FROM (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY rmse, rule) AS rn FROM er) WHERE rn = 1)"""


def _mixed(spark, d) -> tuple[DataFrame, DataFrame]:
    n = F.col("n_nationkey")
    homotypic = table(spark, d, "nation").select(n.alias("type"), (0.1 + n / 20.0).alias("eps"), (4.0 + F.col("n_regionkey")).alias("sig"), (1.0 + n % 3).alias("v"), (2.0 + n % 5).alias("mu"), (12.0 + n / 10.0).alias("rc"))
    rows = mixing.mixed(mixing.homotypic_pairs(homotypic))
    used = ((F.col("parameter") == "eps") & (F.col("rule") == "FH")) | ((F.col("parameter") == "sig") & (F.col("rule") == "WH")) | (F.col("rule") == "A")
    ref = rows.filter(used & (F.col("i") < 20)).select("i", "j", "parameter", (F.col("mixed") * (1 + 0.01 * ((F.col("i") + F.col("j")) % 3))).alias("value"))
    return rows, ref


@query("mixing_rules", "P16", with_ctes(MIX_SQL, select="SELECT i, j, parameter, rule, round(mixed, 8) AS mixed FROM mx"))
def mixing_rules(spark, d):
    return rounded(_mixed(spark, d)[0], "mixed")


@query("best_mixing_rule", "L13", with_ctes(MIX_SQL, select="SELECT parameter, rule, round(rmse, 8) AS rmse FROM bs JOIN er USING (parameter, rule)"))
def best_mixing_rule(spark, d):
    errors = mixing.rule_errors(*_mixed(spark, d))
    return rounded(mixing.best_rules(errors).join(errors, ["parameter", "rule"]), "rmse")


@query("mixed_pair_table", "L14", with_ctes(MIX_SQL, select="""
SELECT i, j, parameter, round(coalesce(value, CASE WHEN parameter IN ('v', 'mu') THEN round_even(mixed, 0) ELSE mixed END), 8) AS value FROM mx JOIN bs USING (parameter, rule) LEFT JOIN rf USING (i, j, parameter)"""))
def mixed_pair_table(spark, d):
    rows, ref = _mixed(spark, d)
    return rounded(mixing.full_table(rows, mixing.best_rules(mixing.rule_errors(rows, ref)), ref), "value")


@query("parameter_parity", "L15", with_ctes(MIX_SQL, select="""
SELECT parameter, count(*) AS n, round(sqrt(avg(pow(value - mixed, 2))), 8) AS rmse, round(avg(abs(value - mixed)), 8) AS mae, round(regr_r2(mixed, value), 8) AS r2 FROM mx JOIN bs USING (parameter, rule) JOIN rf USING (i, j, parameter) GROUP BY 1"""))
def parameter_parity(spark, d):
    rows, ref = _mixed(spark, d)
    mixed = rows.join(F.broadcast(mixing.best_rules(mixing.rule_errors(rows, ref))), ["parameter", "rule"]).select("i", "j", "parameter", F.col("mixed").alias("value"))
    return rounded(mixing.parity(mixed, ref), "rmse", "mae", "r2")


# --- set operations and tags -----------------------------------------------------------

@query("aligned_union", "U1", """
SELECT 'window' AS kind, event_type AS system, count(*) AS n, round(avg(value), 8) AS mean, CAST(NULL AS DOUBLE) AS peak FROM events GROUP BY 2 UNION ALL SELECT 'segment', event_type, count(*), NULL, max(value) FROM events WHERE value > 100 GROUP BY 2""")
def aligned_union(spark, d):
    ev = table(spark, d, "events")
    win = ev.groupBy(F.lit("window").alias("kind"), F.col("event_type").alias("system")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean"))
    seg = ev.filter("value > 100").groupBy(F.lit("segment").alias("kind"), F.col("event_type").alias("system")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return win.unionByName(seg, allowMissingColumns=True)


@query("distinct_conditions", "U2", "SELECT DISTINCT c_mktsegment AS condition, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey")
def distinct_conditions(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("condition"), F.col("o_orderpriority").alias("priority")).distinct()


@query("ordered_unique", "U4", """
WITH a AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(p, ',' ORDER BY k, p) AS priorities FROM a GROUP BY 1""")
def ordered_unique(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.min("o_orderkey").alias("k"))
    return first.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]), ",").alias("priorities"))


@query("provenance_tags", "U5 S13", """
SELECT event_type AS system, key, CASE WHEN key = 'n_events' THEN 'count' WHEN key LIKE 'max%' THEN 'extreme' ELSE 'average' END AS observable_family, CASE WHEN event_type IN ('click', 'view') THEN 'viscosity_segment' ELSE 'window' END AS sampling_family, count(*) AS n
FROM events, (VALUES ('n_events'), ('max_value'), ('mean_value')) v(key) GROUP BY ALL""")
def provenance_tags(spark, d):
    rules = spark.createDataFrame([("n_events", "count"), ("max_value", "extreme"), ("mean_value", "average")], "key string, observable_family string")
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("system")).agg(F.count(F.lit(1)).alias("n"))
    sampling = F.when(F.col("system").isin("click", "view"), "viscosity_segment").otherwise("window")
    return counts.crossJoin(F.broadcast(rules)).withColumn("sampling_family", sampling)
