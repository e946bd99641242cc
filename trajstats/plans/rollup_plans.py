"""Roll-ups, comparisons and ordered operators over orders, events, line items and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trajstats.operators import asof, histograms as hist, rollups, windows
from trajstats.plans.registry import query
from trajstats.plans.series_plans import rounded
from trajstats.plans.views import (
    CONDITIONS_SQL, HOURLY_SQL, LINES_SQL, OBS_SQL, USERS_SQL, condition_orders, daily_observables, event_time, hourly_series, line_radii, table, user_weeks, with_ctes,
)

# Segment means per year, with SEM over orders.
CELLS_SQL = """ce AS (SELECT condition, temperature_k, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(*)) AS sem, count(*) AS n FROM co GROUP BY 1, 2)"""


def _cells(spark, d) -> DataFrame:
    return rollups.mean_sem(condition_orders(spark, d), ["condition", "temperature_k"], "value")


@query("condition_means", "A24", with_ctes(CONDITIONS_SQL, CELLS_SQL, select="SELECT condition, temperature_k, round(mean, 4) AS mean, round(sd, 4) AS sd, round(sem, 4) AS sem, n FROM ce"))
def condition_means(spark, d):
    return rounded(_cells(spark, d), "mean", "sd", "sem", places=4)


@query("class_means_own_sem", "A25", with_ctes(CONDITIONS_SQL, """
un AS (SELECT condition, temperature_k, unit, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS own FROM co GROUP BY 1, 2, 3)""", select="""
SELECT condition, temperature_k, round(avg(mean), 4) AS mean, round(CASE WHEN count(mean) = 1 THEN max(own) ELSE stddev_samp(mean) / sqrt(count(mean)) END, 4) AS sem, count(mean) AS n FROM un GROUP BY 1, 2"""))
def class_means_own_sem(spark, d):
    units = rollups.mean_sem(condition_orders(spark, d), ["condition", "temperature_k", "unit"], "value")
    return rounded(rollups.class_means(units, ["condition", "temperature_k"], "mean", "sem"), "mean", "sem", places=4)


@query("block_then_system", "A26 J7 M15", with_ctes(OBS_SQL, """
bl AS (SELECT system, observable_key, idx // 5 AS block_id, avg(value) AS b FROM obs GROUP BY ALL)""", select="""
SELECT system, observable_key, round(avg(b), 8) AS mean, round(stddev_samp(b) / sqrt(count(b)), 8) AS sem, count(b) AS n_blocks FROM bl GROUP BY 1, 2"""))
def block_then_system(spark, d):
    obs = daily_observables(spark, d)
    layout = obs.select("system", "idx").distinct().withColumn("block_id", F.expr("idx div 5"))
    return rounded(rollups.block_then_system(obs, layout, ["system"], "idx", ["observable_key"]), "mean", "sem")


@query("random_effects_mean", "A27", with_ctes(CONDITIONS_SQL, """
un AS (SELECT condition, temperature_k, unit, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS s FROM co GROUP BY 1, 2, 3)""", select="""
SELECT condition, temperature_k, round(avg(m), 4) AS mean, round(CASE WHEN count(m) = 1 THEN max(s) ELSE sqrt(pow(coalesce(stddev_samp(m) / sqrt(count(m)), 0), 2) + coalesce(avg(s * s) / count(m), 0)) END, 4) AS sem, count(m) AS n FROM un GROUP BY 1, 2"""))
def random_effects_mean(spark, d):
    units = rollups.mean_sem(condition_orders(spark, d), ["condition", "temperature_k", "unit"], "value")
    return rounded(rollups.random_effects_mean(units, ["condition", "temperature_k"]), "mean", "sem", places=4)


PROF_SQL = """pr AS (SELECT system, CAST(floor(r / 5) AS INTEGER) AS bin, avg(weight) AS density, stddev_samp(weight) / sqrt(count(*)) AS sem FROM lr GROUP BY 1, 2)"""


def _profile(spark, d) -> DataFrame:
    rows = line_radii(spark, d).withColumn("bin", F.floor(F.col("r") / 5).cast("int"))
    return rollups.mean_sem(rows, ["system", "bin"], "weight").select("system", "bin", F.col("mean").alias("density"), "sem")


@query("additive_profile", "A28", with_ctes(LINES_SQL, PROF_SQL, select="SELECT bin, round(sum(density), 4) AS density, round(sqrt(sum(sem * sem)), 4) AS sem FROM pr GROUP BY 1"))
def additive_profile(spark, d):
    return rounded(rollups.additive_profile(_profile(spark, d), ["bin"]), "density", "sem", places=4)


@query("tile_average", "A29", """
WITH c AS (SELECT l_partkey % 20 AS i, l_suppkey % 20 AS j, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)
SELECT i % 5 AS i, j % 5 AS j, round(sum(value) / 12, 8) AS value FROM c WHERE i // 5 <> j // 5 GROUP BY 1, 2""")
def tile_average(spark, d):
    cells = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 20).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded(rollups.tile_average(cells, [], 5, 5, shape=(20, 20)), "value")


@query("two_step_mean", "A30", """
WITH u AS (SELECT n_regionkey, s_nationkey, avg(s_acctbal) AS u FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r_name AS region, round(avg(u), 6) AS mean, round(CASE WHEN count(u) = 1 THEN 0 ELSE stddev_samp(u) / sqrt(count(u)) END, 6) AS sem, count(u) AS n
FROM u JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def two_step_mean(spark, d):
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("region"), "s_nationkey", "s_acctbal")
    return rounded(rollups.two_step_mean(rows, ["s_nationkey"], ["region"], "s_acctbal"), "mean", "sem", places=6)


@query("coarsened_profile", "A31", with_ctes(LINES_SQL, """
p1 AS (SELECT system, CAST(floor(r) AS INTEGER) AS bin, avg(weight) AS density FROM lr GROUP BY 1, 2)""", select="SELECT system, CAST(bin // 3 AS INTEGER) AS bin, round(avg(density), 4) AS density FROM p1 GROUP BY 1, 2"))
def coarsened_profile(spark, d):
    rows = line_radii(spark, d).groupBy("system", F.floor("r").cast("int").alias("bin")).agg(F.avg("weight").alias("density"))
    return rounded(rollups.coarsened(rows, ["system"], "bin", 3, ["density"]), "density", places=4)


MAP_SQL = """mp AS (SELECT condition, temperature_k AS i, unit AS j, avg(value) AS value, stddev_samp(value) / sqrt(count(*)) AS sem FROM co GROUP BY 1, 2, 3)"""


def _map(spark, d) -> DataFrame:
    m = rollups.mean_sem(condition_orders(spark, d), ["condition", "temperature_k", "unit"], "value")
    return m.select("condition", F.col("temperature_k").alias("i"), F.col("unit").alias("j"), F.col("mean").alias("value"), "sem")


@query("row_collapse", "A32", with_ctes(CONDITIONS_SQL, MAP_SQL, select="SELECT condition, i, round(sum(value), 3) AS value, round(sqrt(sum(sem * sem)), 3) AS sem FROM mp GROUP BY 1, 2"))
def row_collapse(spark, d):
    return rounded(rollups.row_collapse(_map(spark, d), ["condition"]), "value", "sem", places=3)


CORE_SQL = """sp AS (SELECT l_suppkey AS unit, l_suppkey % 2 AS cls, l_returnflag AS species, CAST(floor(l_quantity / 5) AS INTEGER) AS b, sum(l_extendedprice) AS density FROM lineitem GROUP BY ALL),
inn AS (SELECT unit, cls, species, sum(density) AS dd FROM sp WHERE b <= 4 GROUP BY ALL),
sh AS (SELECT unit, cls, species, dd / sum(dd) OVER (PARTITION BY unit, cls) AS share FROM inn)"""


def _core(spark, d) -> DataFrame:
    prof = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("unit"), (F.col("l_suppkey") % 2).alias("cls"), F.col("l_returnflag").alias("species"), F.floor(F.col("l_quantity") / 5).alias("b")
    ).agg(F.sum("l_extendedprice").alias("density"))
    return rollups.core_share(prof, ["unit", "cls"], "species", "b", "density", 4)


@query("core_share", "A33", with_ctes(CORE_SQL, select="SELECT unit, cls, species, round(share, 8) AS share FROM sh"))
def core_share(spark, d):
    return rounded(_core(spark, d), "share")


@query("core_shift", "A33 A44", with_ctes(CORE_SQL, """
st AS (SELECT species, avg(share) FILTER (cls = 1) AS mean_1, avg(share) FILTER (cls = 0) AS mean_2, stddev_samp(share) FILTER (cls = 1) / sqrt(count(*) FILTER (cls = 1)) AS s1,
  stddev_samp(share) FILTER (cls = 0) / sqrt(count(*) FILTER (cls = 0)) AS s2, count(*) FILTER (cls = 1) AS n_1, count(*) FILTER (cls = 0) AS n_2 FROM sh GROUP BY 1)""", select="""
SELECT species, round(mean_1, 8) AS mean_1, round(mean_2, 8) AS mean_2, n_1, n_2, round(mean_1 - mean_2, 8) AS delta, round(sqrt(s1 * s1 + s2 * s2), 8) AS sem, round((mean_1 - mean_2) / sqrt(s1 * s1 + s2 * s2), 6) AS z FROM st"""))
def core_shift(spark, d):
    out = rollups.two_class_shift(_core(spark, d), ["species"], "cls", "share", 1, 0)
    return rounded(out, "mean_1", "mean_2", "delta", "sem").withColumn("z", F.round("z", 6))


@query("interpolated_profile", "A34", with_ctes(LINES_SQL, """
p1 AS (SELECT system, CAST(floor(r / 5) AS INTEGER) * 5.0 + 2.5 AS x, avg(weight) AS y FROM lr GROUP BY 1, 2),
gd AS (SELECT s.system, g.g * 1.0 AS x FROM (SELECT DISTINCT system FROM p1) s, range(0, 51, 2) g(g)),
lo AS (SELECT g.system, g.x, max(p.x) AS x0 FROM gd g LEFT JOIN p1 p ON p.system = g.system AND p.x <= g.x GROUP BY 1, 2),
hi AS (SELECT g.system, g.x, min(p.x) AS x1 FROM gd g LEFT JOIN p1 p ON p.system = g.system AND p.x >= g.x GROUP BY 1, 2)""", select="""
SELECT l.system, CAST(l.x AS DOUBLE) AS x, round(CASE WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL THEN a.y WHEN x0 = x1 THEN a.y ELSE a.y + (b.y - a.y) / (x1 - x0) * (l.x - x0) END, 4) AS y
FROM lo l JOIN hi h ON h.system = l.system AND h.x = l.x LEFT JOIN p1 a ON a.system = l.system AND a.x = x0 LEFT JOIN p1 b ON b.system = l.system AND b.x = x1"""))
def interpolated_profile(spark, d):
    curve = _profile(spark, d).select("system", (F.col("bin") * 5.0 + 2.5).alias("x"), F.col("density").alias("y"))
    grid = curve.select("system").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(2)))).withColumn("x", F.col("x").cast("double"))
    return rounded(hist.interpolated(curve, grid, ["system"], "x", "y"), "y", places=4)


@query("replicate_summary", "A35", """
WITH o AS (SELECT c_mktsegment AS condition, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice > 400000 AS large FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT condition, year, priority, row_number() OVER (PARTITION BY condition, year ORDER BY count(*) DESC, priority) AS rn FROM o GROUP BY 1, 2, 3)
SELECT o.condition, o.year, count(*) AS n_reps, round(avg(price), 4) AS price, round(stddev_samp(price), 4) AS price_sd, bool_or(large) AS large, any_value(m.priority) AS priority,
       string_agg(DISTINCT status, ';' ORDER BY status) AS status FROM o JOIN m ON m.condition = o.condition AND m.year = o.year AND rn = 1 GROUP BY 1, 2""")
def replicate_summary(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("condition"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 400000).alias("large"),
    )
    return rounded(rollups.replicate_summary(rows, ["condition", "year"], ["price"], ["large"], ["priority"], ["status"]), "price", "price_sd", places=4)


WIDE_SQL = """wd AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, r_name AS class, avg(c_acctbal) AS balance, CAST(count(*) AS DOUBLE) AS customers
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


def _wide(spark, d) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("c_nationkey").cast("string").alias("id"), F.col("r_name").alias("class")).agg(
        F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).cast("double").alias("customers"))


@query("class_average_rows", "A36 M14", with_ctes(WIDE_SQL, select="""
SELECT id, class, round(balance, 6) AS balance, customers, CAST(NULL AS DOUBLE) AS "SIGbalance", CAST(NULL AS DOUBLE) AS "SIGcustomers" FROM wd
UNION ALL SELECT class || '_AVE', class, round(avg(balance), 6), avg(customers), round(stddev_samp(balance) / sqrt(count(*)), 6), round(stddev_samp(customers) / sqrt(count(*)), 6) FROM wd GROUP BY class"""))
def class_average_rows(spark, d):
    out = rollups.with_class_row(_wide(spark, d), "id", "class", ["balance", "customers"], F.concat(F.col("class"), F.lit("_AVE")))
    return rounded(out, "balance", "SIGbalance", "SIGcustomers", places=6)


@query("corrected_override", "A37 J12", with_ctes(WIDE_SQL, """
fx AS (SELECT class, CASE WHEN avg(customers) > (SELECT avg(customers) FROM wd) THEN avg(balance) END AS balance FROM wd GROUP BY 1 HAVING avg(balance) > (SELECT avg(balance) FROM wd) - 100)""", select="""
SELECT id, wd.class, customers, round(CASE WHEN fx.class IS NOT NULL THEN fx.balance ELSE wd.balance END, 6) AS balance FROM wd LEFT JOIN fx ON fx.class = wd.class"""))
def corrected_override(spark, d):
    wide = _wide(spark, d)
    overall = wide.agg(F.avg("customers").alias("overall"), F.avg("balance").alias("overall_b"))
    fixes = wide.groupBy("class").agg(F.avg("customers").alias("c"), F.avg("balance").alias("b")).crossJoin(F.broadcast(overall)).filter("b > overall_b - 100")
    fixes = fixes.select("class", F.when(F.col("c") > F.col("overall"), F.col("b")).alias("balance"))
    return rounded(rollups.overridden(wide, fixes, ["class"], ["balance"]), "balance", places=6)


@query("time_thirds", "A38", with_ctes(OBS_SQL, select="""
SELECT system, observable_key, CASE WHEN idx < lo + (hi - lo) / 3.0::DOUBLE THEN 'early' WHEN idx < lo + 2 * ((hi - lo) / 3.0::DOUBLE) THEN 'middle' ELSE 'late' END AS span, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd,
       round(stddev_samp(value) / sqrt(count(*)), 8) AS sem, count(*) AS n FROM obs, (SELECT min(idx) AS lo, max(idx) AS hi FROM obs) GROUP BY 1, 2, 3"""))
def time_thirds(spark, d):
    obs = daily_observables(spark, d)
    lo, hi = obs.agg(F.min("idx"), F.max("idx")).first()
    return rounded(rollups.time_thirds(obs, ["system", "observable_key"], "idx", lo or 0, hi or 0, "value"), "mean", "sd", "sem")


@query("largest_share_series", "A39 C11", """
WITH f AS (SELECT c_mktsegment AS system, CAST(year(o_orderdate) AS INTEGER) AS frame, c_nationkey AS g, count(*) AS size, avg(o_totalprice) AS rg FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (SELECT system, frame, count(*) FILTER (rg > 0) AS n_groups, greatest(max(rg), 0) AS max_rg, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS total FROM f GROUP BY 1, 2)
SELECT system, frame, n_groups, round(max_rg, 4) AS max_rg, round(max_size / first_value(total) OVER (PARTITION BY system ORDER BY frame), 8) AS phi FROM p""")
def largest_share_series(spark, d):
    from trajstats.operators.groups import ragged_frames
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("system"), F.year("o_orderdate").alias("frame"), "c_nationkey").agg(F.count(F.lit(1)).alias("size"), F.avg("o_totalprice").alias("rg"))
    return rounded(ragged_frames(rows, ["system"], "frame"), "phi").withColumn("max_rg", F.round("max_rg", 4))


REL_SQL = CELLS_SQL + """,
rl AS (SELECT a.condition, a.temperature_k, a.mean, a.sem, CASE WHEN a.condition = 'BUILDING' THEN 0.0 ELSE a.mean - b.mean END AS delta_abs,
  CASE WHEN a.condition = 'BUILDING' THEN 0.0 WHEN abs(b.mean) >= 0.001 THEN (a.mean - b.mean) / b.mean END AS delta_rel,
  CASE WHEN a.condition = 'BUILDING' THEN 0.0 WHEN abs(b.mean) >= 0.001 THEN abs(a.sem / b.mean) + abs(a.mean * b.sem / (b.mean * b.mean)) END AS delta_rel_sd,
  a.condition <> 'BUILDING' AND NOT coalesce(abs(b.mean) >= 0.001, false) AS unstable
  FROM ce a LEFT JOIN ce b ON b.condition = 'BUILDING' AND b.temperature_k = a.temperature_k)"""


def _relative(spark, d) -> DataFrame:
    return rollups.against_reference(_cells(spark, d), ["temperature_k"], "condition", "BUILDING", "mean", "sem")


@query("against_control", "J8 P25", with_ctes(CONDITIONS_SQL, REL_SQL, select="""
SELECT condition, temperature_k, round(delta_abs, 4) AS delta_abs, round(delta_rel, 8) AS delta_rel, round(delta_rel_sd, 8) AS delta_rel_sd, unstable FROM rl"""))
def against_control(spark, d):
    out = _relative(spark, d).select("condition", "temperature_k", F.round("delta_abs", 4).alias("delta_abs"), "delta_rel", "delta_rel_sd", "unstable")
    return rounded(out, "delta_rel", "delta_rel_sd")


SUMMARY_MEANS = ("mean", "delta_rel", "delta_abs", "delta_rel_sd")
SUMMARY_SQL = "st AS (SELECT *, 'class_' || (length(condition) % 2) AS class FROM rl WHERE condition <> 'BUILDING' AND NOT unstable)"
_MEANS_SQL = ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in SUMMARY_MEANS) + ", count(*) AS n_points"


@query("two_level_summary", "A40", with_ctes(CONDITIONS_SQL, REL_SQL, SUMMARY_SQL, select=f"""
SELECT 'condition' AS level, condition AS name, class, CAST(NULL AS INTEGER) AS temperature, {_MEANS_SQL} FROM st GROUP BY condition, class
UNION ALL SELECT 'class_temperature', class || '_GROUP', class, temperature_k, {_MEANS_SQL} FROM st GROUP BY class, temperature_k"""))
def two_level_summary(spark, d):
    rel = _relative(spark, d).filter("condition <> 'BUILDING'").withColumn("class", F.concat(F.lit("class_"), (F.length("condition") % 2).cast("string")))
    out = rollups.two_level_summary(rel, "condition", "class", "temperature_k", SUMMARY_MEANS, "unstable")
    return rounded(out, *(f"mean_{m}" for m in SUMMARY_MEANS), places=6)


@query("change_ranking", "W11 A40", with_ctes(CONDITIONS_SQL, REL_SQL, """
sm AS (SELECT condition, avg(delta_rel) FILTER (NOT unstable) AS mean_rel FROM rl WHERE condition <> 'BUILDING' GROUP BY 1)""", select="""
SELECT 'condition' AS level, condition AS name, CAST(NULL AS INTEGER) AS temperature_k, round(mean_rel, 8) AS mean_rel, dense_rank() OVER (ORDER BY mean_rel) AS rank FROM sm
UNION ALL SELECT 'temperature', 'all', temperature_k, round(avg(delta_rel), 8), CAST(NULL AS BIGINT) FROM rl WHERE condition <> 'BUILDING' GROUP BY temperature_k"""))
def change_ranking(spark, d):
    from pyspark.sql import Window as W
    rel = _relative(spark, d).filter("condition <> 'BUILDING'")
    by_condition = rel.groupBy(F.lit("condition").alias("level"), F.col("condition").alias("name")).agg(F.avg(F.when(~F.col("unstable"), F.col("delta_rel"))).alias("mean_rel"))
    by_condition = by_condition.withColumn("rank", F.dense_rank().over(W.orderBy("mean_rel")).cast("long"))
    by_temp = rel.groupBy(F.lit("temperature").alias("level"), F.lit("all").alias("name"), "temperature_k").agg(F.avg("delta_rel").alias("mean_rel"))
    return rounded(by_condition.unionByName(by_temp, allowMissingColumns=True), "mean_rel")


@query("cell_difference", "J9 A44 P8", with_ctes(CONDITIONS_SQL, MAP_SQL, select="""
SELECT a.i, a.j, round(a.value - b.value, 3) AS diff, round(sqrt(a.sem * a.sem + b.sem * b.sem), 3) AS diff_sem, round((a.value - b.value) / b.value, 8) AS rel,
       round(sqrt(pow(a.sem / b.value, 2) + pow(a.value * b.sem / (b.value * b.value), 2)), 8) AS rel_sem, round((a.value - b.value) / sqrt(a.sem * a.sem + b.sem * b.sem), 6) AS z
FROM mp a JOIN mp b ON a.i = b.i AND a.j = b.j AND b.condition = 'BUILDING' WHERE a.condition = 'MACHINERY'"""))
def cell_difference(spark, d):
    m = _map(spark, d)
    out = rollups.cell_difference(m.filter("condition = 'MACHINERY'"), m.filter("condition = 'BUILDING'"), ["i", "j"], "value")
    return rounded(out, "rel", "rel_sem").withColumns({"diff": F.round("diff", 3), "diff_sem": F.round("diff_sem", 3), "z": F.round("z", 6)})


@query("log_ratio_contrast", "A51", with_ctes(CONDITIONS_SQL, MAP_SQL, """
lc AS (SELECT a.i, a.j, ln(a.value / b.value) AS ln_ratio, sqrt(pow(a.sem / a.value, 2) + pow(b.sem / b.value, 2)) AS error
  FROM mp a JOIN mp b ON a.i = b.i AND a.j = b.j AND b.condition = 'BUILDING' WHERE a.condition = 'MACHINERY')""", select="SELECT i, j, round(ln_ratio, 8) AS ln_ratio, round(error, 8) AS error, round(ln_ratio / error, 6) AS z FROM lc"))
def log_ratio_contrast(spark, d):
    m = _map(spark, d)
    out = rollups.log_ratio_contrast(m.filter("condition = 'MACHINERY'"), m.filter("condition = 'BUILDING'"), ["i", "j"], "value")
    return rounded(out, "ln_ratio", "error").withColumn("z", F.round("z", 6))


@query("log2_fold_change", "P10 P11", with_ctes("""ct AS (SELECT o_orderpriority AS i, CAST(year(o_orderdate) AS INTEGER) AS j, CAST(count(*) FILTER (c_mktsegment = 'MACHINERY') AS DOUBLE) AS num, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS DOUBLE) AS den
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
fl AS (SELECT greatest(quantile_cont(v, 0.01), 1e-12) AS eps FROM (SELECT num AS v FROM ct WHERE num > 0 UNION ALL SELECT den FROM ct WHERE den > 0))""", select="""
SELECT i, j, round(CASE WHEN greatest(num, den) > eps THEN log2((num + eps) / (den + eps)) END, 8) AS log2_fc FROM ct, fl"""))
def log2_fold_change(spark, d):
    from trajstats.functions.scalars import log2_fold_change as fold
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    cells = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("o_orderpriority").alias("i"), F.year("o_orderdate").alias("j")).agg(
        F.count(F.when(F.col("c_mktsegment") == "MACHINERY", 1)).cast("double").alias("num"), F.count(F.when(F.col("c_mktsegment") == "BUILDING", 1)).cast("double").alias("den"))
    floor = cells.select(F.explode(F.array("num", "den")).alias("v")).filter("v > 0").agg(F.greatest(F.percentile("v", 0.01), F.lit(1e-12)).alias("eps"))
    return cells.crossJoin(F.broadcast(floor)).select("i", "j", F.round(fold(F.col("num"), F.col("den"), F.col("eps")), 8).alias("log2_fc"))


@query("concatenated_systems", "A41", with_ctes(CONDITIONS_SQL, """
sy AS (SELECT condition, row_number() OVER (ORDER BY condition) - 1 AS k FROM (SELECT DISTINCT condition FROM co))""", select="""
SELECT unit + k * (SELECT max(unit) FROM co) AS unit, round(sum(value), 2) AS total, count(*) AS n FROM co JOIN sy USING (condition) GROUP BY 1"""))
def concatenated_systems(spark, d):
    out = rollups.concatenated_systems(condition_orders(spark, d), "condition", "unit").groupBy("unit").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return rounded(out.withColumn("unit", F.col("unit").cast("long")), "total", places=2)


@query("class_statistics", "A42 U2", """
WITH x AS (SELECT DISTINCT c_mktsegment AS class, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0)
SELECT class, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, count(*) AS n FROM x GROUP BY 1""")
def class_statistics(spark, d):
    rows = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("class"), "c_custkey", "c_acctbal").dropDuplicates()
    return rounded(rollups.mean_sem(rows, ["class"], "c_acctbal").drop("sem"), "mean", "sd", places=6)


STRESS_COLS = ("pxx", "pyy", "pzz", "pxy", "pxz", "pyz")


@query("mean_stress", "A43 M11", """
WITH s AS (SELECT epoch_us(ts) // 86400000000 AS step, event_type AS system, avg(value) AS pxx, min(value) AS pyy, max(value) AS pzz, avg(value * cos(value)) AS pxy, avg(value * sin(value)) AS pxz, avg(sin(value)) AS pyz FROM events GROUP BY 1, 2)
SELECT step, """ + ", ".join(f"round(avg({c}), 8) AS {c}, round(stddev_samp({c}) / sqrt(count(*)), 8) AS {c}_sem" for c in STRESS_COLS) + " FROM s GROUP BY 1")
def mean_stress(spark, d):
    from trajstats.functions.stats import sem
    v = F.col("value")
    s = event_time(spark, d).groupBy(F.expr("t_us div 86400000000").alias("step"), "event_type").agg(
        F.avg(v).alias("pxx"), F.min(v).alias("pyy"), F.max(v).alias("pzz"), F.avg(v * F.cos(v)).alias("pxy"), F.avg(v * F.sin(v)).alias("pxz"), F.avg(F.sin(v)).alias("pyz"))
    out = s.groupBy("step").agg(*[a for c in STRESS_COLS for a in (F.avg(c).alias(c), sem(F.col(c)).alias(f"{c}_sem"))])
    return rounded(out, *[x for c in STRESS_COLS for x in (c, f"{c}_sem")])


@query("temperature_trend", "A46", with_ctes(CONDITIONS_SQL, select="""
SELECT temperature_k, """ + ", ".join(f"round(avg(value) FILTER (condition = '{c}'), 4) AS \"{c}_value\", round(stddev_samp(value) FILTER (condition = '{c}') / sqrt(count(*) FILTER (condition = '{c}')), 4) AS \"{c}_sem\"" for c in ("BUILDING", "MACHINERY", "HOUSEHOLD")) + """
FROM co GROUP BY 1"""))
def temperature_trend(spark, d):
    out = rollups.trend_table(condition_orders(spark, d), ["temperature_k"], "condition", ["BUILDING", "MACHINERY", "HOUSEHOLD"], "value")
    return rounded(out, *[c for c in out.columns if c != "temperature_k"], places=4)


@query("ratio_to_reference", "A47", with_ctes(CONDITIONS_SQL, """
cn AS (SELECT temperature_k, condition, count(*) AS n FROM co GROUP BY 1, 2)""", select="""
SELECT a.temperature_k, a.condition, a.n, round(a.n / b.n, 8) AS ratio FROM cn a LEFT JOIN cn b ON b.temperature_k = a.temperature_k AND b.condition = 'BUILDING'"""))
def ratio_to_reference(spark, d):
    counts = condition_orders(spark, d).groupBy("temperature_k", "condition").agg(F.count(F.lit(1)).alias("n"))
    return rounded(rollups.ratio_to_reference(counts, ["temperature_k"], "condition", "BUILDING", "n"), "ratio")


@query("contact_rate_per_chain", "A53", """
WITH c AS (SELECT n_regionkey AS cls, s_nationkey AS sp, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
n AS (SELECT s_nationkey AS sp, count(*) AS n FROM supplier GROUP BY 1)
SELECT cls, sp, round(c / n, 6) AS rate, round(c / n - avg(c / n) OVER (PARTITION BY cls), 6) AS delta FROM c JOIN n USING (sp)""")
def contact_rate_per_chain(spark, d):
    l, s, n = table(spark, d, "lineitem").select("l_suppkey"), table(spark, d, "supplier"), table(spark, d, "nation")
    per_supplier = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    counts = per_supplier.join(s, per_supplier.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("cls"), F.col("s_nationkey").alias("sp")).agg(F.sum("k").alias("c"))
    chains = s.groupBy(F.col("s_nationkey").alias("sp")).agg(F.count(F.lit(1)).alias("n"))
    rate = counts.join(chains, "sp").withColumn("rate", F.col("c") / F.col("n"))
    mean = rate.groupBy("cls").agg(F.avg("rate").alias("m"))
    return rate.join(mean, "cls").select("cls", "sp", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("m"), 6).alias("delta"))


@query("effective_mass", "A56", """
SELECT median(CASE WHEN p_size > 25 THEN p_retailprice END) AS meff, round((max(p_retailprice) FILTER (p_size > 25) - min(p_retailprice) FILTER (p_size > 25)) / median(CASE WHEN p_size > 25 THEN p_retailprice END), 8) AS relative_spread, true AS spread_warning FROM part""")
def effective_mass(spark, d):
    rows = table(spark, d, "part").withColumn("m", F.when(F.col("p_size") > 25, F.col("p_retailprice")))
    return rounded(rollups.effective_mass(rows, "m", "p_retailprice", "p_size"), "relative_spread")


@query("member_blocks", "A23", """
WITH c AS (SELECT event_type AS species, epoch_us(ts) // 86400000000 AS w, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2),
k AS (SELECT w FROM c GROUP BY 1 HAVING sum(n) > 2), b AS (SELECT species, w // 3 AS b, avg(n) AS m FROM c JOIN k USING (w) GROUP BY 1, 2)
SELECT species, round(avg(m), 8) AS mean, round(stddev_samp(m) / sqrt(count(*)), 8) AS sem, count(*) AS n_blocks FROM b GROUP BY 1""")
def member_blocks(spark, d):
    rows = event_time(spark, d).select(F.col("event_type").alias("species"), F.expr("t_us div 86400000000").alias("w"), "user_id")
    return rounded(rollups.member_blocks(rows, [], "w", "species", "user_id", F.expr("w div 3")), "mean", "sem")


@query("latest_per_key", "W13 J10", """
SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark, d):
    ev = event_time(spark, d).select("user_id", "event_id", "t_us", "value")
    return rollups.latest_per_key(ev, ["user_id"], [F.col("t_us"), F.col("event_id")]).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("enriched_intervals", "J10", with_ctes(OBS_SQL, """
ci AS (SELECT system, observable_key, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS sem FROM obs GROUP BY 1, 2),
dg AS (SELECT system, observable_key, idx // 7 AS week, max(value) - min(value) AS spread, count(*) AS n_rows FROM obs WHERE observable_key <> 'n_events' GROUP BY 1, 2, 3),
ls AS (SELECT * FROM dg QUALIFY row_number() OVER (PARTITION BY system, observable_key ORDER BY week DESC) = 1)""", select="""
SELECT system, observable_key, round(mean, 8) AS mean, round(sem, 8) AS sem, week, round(spread, 6) AS spread, n_rows FROM ci LEFT JOIN ls USING (system, observable_key)"""))
def enriched_intervals(spark, d):
    obs, keys = daily_observables(spark, d), ["system", "observable_key"]
    intervals = rollups.mean_sem(obs, keys, "value").select(*keys, "mean", "sem")
    weekly = obs.filter("observable_key <> 'n_events'").groupBy(*keys, F.expr("idx div 7").alias("week")).agg((F.max("value") - F.min("value")).alias("spread"), F.count(F.lit(1)).alias("n_rows"))
    out = rollups.enriched(intervals, weekly, keys, [F.col("week")])
    return rounded(rounded(out, "mean", "sem"), "spread", places=6)


@query("top_prefixes", "W12", """
WITH s AS (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, brand) AS rank FROM s)
SELECT k.k AS k, brand, n FROM r, range(1, 6) k(k) WHERE rank <= k.k""")
def top_prefixes(spark, d):
    ranked = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "brand").limit(5)
    from pyspark.sql import Window as W
    rank = ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "brand")))
    return rank.withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(5)))).select(F.col("k").cast("long").alias("k"), "brand", "n")


@query("grid_mismatches", "J16 S11", with_ctes(USERS_SQL, """
pt AS (SELECT DISTINCT system, idx FROM uw)""", select="SELECT idx, count(*) AS n_series FROM pt GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT system) FROM pt)"))
def grid_mismatches(spark, d):
    return rollups.grid_mismatches(user_weeks(spark, d), "system", "idx", 0)


@query("master_table", "U3 M14 S13", with_ctes(OBS_SQL, """
ms AS (SELECT system, observable_key, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS sem FROM obs GROUP BY 1, 2)""", select="""
SELECT system, """ + ", ".join(f"round(max(mean) FILTER (observable_key = '{c}'), 8) AS {c}, round(max(sem) FILTER (observable_key = '{c}'), 8) AS \"SIG{c}\"" for c in ("mean_value", "max_value", "n_events")) + " FROM ms GROUP BY 1"))
def master_table(spark, d):
    long = rollups.mean_sem(daily_observables(spark, d), ["system", "observable_key"], "value")
    out = rollups.long_to_wide(long, ["system"], "observable_key", ["mean_value", "max_value", "n_events"])
    return rounded(out, *[c for c in out.columns if c != "system"])


@query("augmented_master", "J13", """
WITH ms AS (SELECT c_custkey::VARCHAR AS id, c_acctbal AS balance, 'seg_' || c_mktsegment AS class_id FROM customer UNION ALL SELECT DISTINCT 'seg_' || c_mktsegment, NULL::DOUBLE, NULL FROM customer),
s1 AS (SELECT o_custkey::VARCHAR AS id, 'price' AS col, avg(o_totalprice) AS value, 0 AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey::VARCHAR, 'SIGprice', stddev_samp(o_totalprice) / sqrt(count(*)), 0 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
s2 AS (SELECT o_custkey::VARCHAR AS id, 'price' AS col, max(o_totalprice) AS value, 1 AS r FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1 UNION ALL SELECT o_custkey::VARCHAR, 'orders', count(*)::DOUBLE, 1 FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
s3 AS (SELECT 'seg_' || c_mktsegment AS id, 'price' AS col, avg(o_totalprice) AS value, 2 AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT 'seg_' || c_mktsegment, 'SIGprice', stddev_samp(o_totalprice) / sqrt(count(*)), 2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT 'seg_' || c_mktsegment, 'orders', count(*)::DOUBLE, 2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
un AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, col ORDER BY r, value DESC) = 1),
wd AS (SELECT id, max(value) FILTER (col = 'price') AS p, max(value) FILTER (col = 'SIGprice') AS sp, max(value) FILTER (col = 'orders') AS o FROM un GROUP BY 1)
SELECT ms.id, round(balance, 6) AS balance, round(coalesce(m.p, c.p), 6) AS price, round(CASE WHEN m.p IS NOT NULL THEN coalesce(m.sp, 0) WHEN c.p IS NOT NULL THEN coalesce(c.sp, 0) END, 4) AS "SIGprice", coalesce(m.o, c.o) AS orders, CASE WHEN m.o IS NOT NULL OR c.o IS NOT NULL THEN 0.0::DOUBLE END AS "SIGorders"
FROM ms LEFT JOIN wd m ON m.id = ms.id LEFT JOIN wd c ON c.id = ms.class_id""")
def augmented_master(spark, d):
    """Customers and their segments as class rows; prices and counts from three sources that disagree."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key, segment = F.col("o_custkey").cast("string").alias("id"), F.concat(F.lit("seg_"), "c_mktsegment").alias("id")
    stats = {"price": F.avg("o_totalprice"), "SIGprice": F.stddev_samp("o_totalprice") / F.sqrt(F.count("o_totalprice")), "orders": F.count("o_totalprice").cast("double"), "top": F.max("o_totalprice")}

    def long(rows: DataFrame, id_, **columns: str) -> DataFrame:
        found = rows.groupBy(id_).agg(*[stats[s].alias(n) for n, s in columns.items()])
        return found.unpivot("id", list(columns), "column", "value")

    joined = o.join(c, o.o_custkey == c.c_custkey)
    sources = [
        long(o.filter("o_orderstatus = 'F'"), key, price="price", SIGprice="SIGprice"),
        long(o.filter("o_custkey % 3 = 0"), key, price="top").unionByName(long(o.filter("o_custkey % 2 = 0"), key, orders="orders")),
        long(joined, segment, price="price", SIGprice="SIGprice", orders="orders"),
    ]
    members = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("balance"))
    master = members.unionByName(c.select(segment).distinct().withColumn("balance", F.lit(None).cast("double")))
    classes = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("seg_"), "c_mktsegment").alias("class_id"))
    out = rollups.augmented_master(master, sources, ["price", "orders"], classes)
    return rounded(rounded(out, "balance", "price", places=6), "SIGprice", places=4)


@query("member_fill", "A37", """
WITH un AS (SELECT c_custkey::VARCHAR AS id, 'seg_' || c_mktsegment AS class_id, avg(o_totalprice) AS price, stddev_samp(o_totalprice) / sqrt(count(*)) AS sig FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
ag AS (SELECT 'seg_' || c_mktsegment AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN max(c_acctbal) END AS price, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE END AS sig FROM customer GROUP BY c_mktsegment),
mm AS (SELECT class_id AS id, avg(price) AS m, CASE WHEN count(price) = 1 THEN max(sig) FILTER (price IS NOT NULL) ELSE stddev_samp(price) / sqrt(count(price)) END AS s FROM un GROUP BY 1)
SELECT id, class_id, round(price, 6) AS price, round(sig, 4) AS "SIGprice" FROM un UNION ALL SELECT ag.id, NULL, round(coalesce(price, m), 6), round(CASE WHEN price IS NULL THEN s ELSE sig END, 4) FROM ag LEFT JOIN mm USING (id)""")
def member_fill(spark, d):
    """Segments without a value of their own take it from their customers."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    segment = F.concat(F.lit("seg_"), "c_mktsegment")
    members = c.join(o, o.o_custkey == c.c_custkey, "left").groupBy(F.col("c_custkey").cast("string").alias("id"), segment.alias("class_id")).agg(
        F.avg("o_totalprice").alias("price"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("o_totalprice"))).alias("SIGprice"))
    known = F.col("c_mktsegment") == "BUILDING"
    classes = c.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("top")).select(
        segment.alias("id"), F.lit(None).cast("string").alias("class_id"), F.when(known, F.col("top")).alias("price"), F.when(known, F.lit(1.0)).alias("SIGprice"))
    out = rollups.fill_from_members(members.unionByName(classes), ["price"])
    return rounded(rounded(out, "price", places=6), "SIGprice", places=4)


# --- ordered operators -----------------------------------------------------------------

CUM_SQL = """cu AS (SELECT system, idx, sum(x) OVER (PARTITION BY system ORDER BY idx) AS y FROM series),
tot AS (SELECT system, max(y) * 0.6321 AS level FROM cu GROUP BY 1)"""


def _cumulative(spark, d) -> DataFrame:
    from pyspark.sql import Window as W
    s = hourly_series(spark, d)
    return s.select("system", "idx", F.sum("x").over(W.partitionBy("system").orderBy("idx")).alias("y"))


@query("first_crossing", "W4", with_ctes(HOURLY_SQL, CUM_SQL, """
st AS (SELECT cu.*, level, lag(idx) OVER w AS x0, lag(y) OVER w AS y0 FROM cu JOIN tot USING (system) WINDOW w AS (PARTITION BY system ORDER BY idx))""", select="""
SELECT system, round(arg_min(CASE WHEN y0 < level THEN x0 + (level - y0) / (y - y0) * (idx - x0) ELSE idx END, idx), 6) AS crossing FROM st WHERE y >= level GROUP BY 1"""))
def first_crossing(spark, d):
    cu = _cumulative(spark, d)
    level = cu.groupBy("system").agg((F.max("y") * 0.6321).alias("level"))
    return rounded(windows.first_crossing(cu.join(level, "system"), ["system"], "idx", "y", "level"), "crossing", places=6)


@query("half_max_radius", "W4", with_ctes(LINES_SQL, """
p1 AS (SELECT system, CAST(floor(r) AS INTEGER) AS r, sum(weight) AS y FROM lr GROUP BY 1, 2),
p2 AS (SELECT system, r, y * (CASE WHEN r < 20 THEN r ELSE 60 - r END) AS y FROM p1),
pk AS (SELECT system, arg_max(r, y) AS rp, max(y) / 2 AS h FROM p2 GROUP BY 1),
st AS (SELECT p2.*, rp, h, lag(r) OVER w AS x0, lag(y) OVER w AS y0 FROM p2 JOIN pk USING (system) WINDOW w AS (PARTITION BY system ORDER BY r))""", select="""
SELECT system, round(arg_min(x0 + (h - y0) * (r - x0) / (y - y0), r), 6) AS r_half FROM st WHERE r > rp AND ((y0 >= h AND h >= y) OR (y >= h AND h >= y0)) GROUP BY 1"""))
def half_max_radius(spark, d):
    p = line_radii(spark, d).groupBy("system", F.floor("r").cast("int").alias("r")).agg(F.sum("weight").alias("y"))
    p = p.withColumn("y", F.col("y") * F.when(F.col("r") < 20, F.col("r")).otherwise(60 - F.col("r")))
    return rounded(windows.half_max_radius(p, ["system"], "r", "y"), "r_half", places=6)


@query("monotonicity_flags", "W5", with_ctes(CONDITIONS_SQL, CELLS_SQL, select="""
SELECT condition, temperature_k, coalesce(mean - lag(mean) OVER w < -1.0 * coalesce(sqrt(sem * sem + pow(lag(sem) OVER w, 2)), 0), false) AS flag_nonmonotone
FROM ce WINDOW w AS (PARTITION BY condition ORDER BY temperature_k)"""))
def monotonicity_flags(spark, d):
    return windows.monotonicity_flags(_cells(spark, d), ["condition"], "temperature_k", "mean", "sem", 1.0, True).select("condition", "temperature_k", "flag_nonmonotone")


SLOPE_SQL = """sl AS (SELECT system, idx, row_number() OVER (PARTITION BY system ORDER BY idx) - 1 AS i, CASE WHEN count(*) OVER w = 24 THEN regr_slope(y, idx) OVER w END AS slope
  FROM cu WINDOW w AS (PARTITION BY system ORDER BY idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))"""


@query("moving_slope", "W6", with_ctes(HOURLY_SQL, CUM_SQL, SLOPE_SQL, select="SELECT system, idx, round(slope, 4) AS slope FROM sl"))
def moving_slope(spark, d):
    return rounded(windows.moving_slope(_cumulative(spark, d), ["system"], "idx", "y", 24).select("system", "idx", "slope"), "slope", places=4)


@query("linear_regions", "W6", with_ctes(HOURLY_SQL, CUM_SQL, SLOPE_SQL, """
gd AS (SELECT system, i AS s, i + 24 AS e FROM sl WHERE abs(slope - (SELECT avg(x) FROM series)) <= (SELECT avg(x) FROM series) * 0.25),
fl AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY system ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY system ORDER BY s) = 1 THEN 1 ELSE 0 END AS nw FROM gd),
ig AS (SELECT *, sum(nw) OVER (PARTITION BY system ORDER BY s) AS g FROM fl)""", select="SELECT system, min(s) AS first, max(e) AS last FROM ig GROUP BY system, g"))
def linear_regions(spark, d):
    mean = hourly_series(spark, d).agg(F.avg("x").alias("mean"))
    slopes = windows.moving_slope(_cumulative(spark, d), ["system"], "idx", "y", 24).crossJoin(F.broadcast(mean))
    out = windows.merged_runs(slopes.withColumn("slope", F.col("slope") / F.col("mean")), ["system"], 24, 1.0, 0.25)
    return out.select("system", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


KERNEL_SQL = "kr AS (SELECT k, exp(-0.5 * pow(k / 5.0, 2)) / (SELECT sum(exp(-0.5 * pow(q / 5.0, 2))) FROM range(-15, 16) r(q)) AS w FROM range(-15, 16) r(k))"
SMOOTH_SQL = KERNEL_SQL + """,
gm AS (SELECT s.system, s.idx, k, w, CASE WHEN s.idx + k < 0 THEN -(s.idx + k) WHEN s.idx + k > m THEN 2 * m - (s.idx + k) ELSE s.idx + k END AS src FROM series s, kr, (SELECT max(idx) AS m FROM series)),
sm AS (SELECT gm.system, gm.idx, greatest(sum(w * x), 0) AS y FROM gm JOIN series s ON s.system = gm.system AND s.idx = gm.src GROUP BY 1, 2)"""


@query("smoothed_series", "W7", with_ctes(HOURLY_SQL, SMOOTH_SQL, select="SELECT system, idx, round(y / sum(y) OVER (PARTITION BY system), 10) AS x FROM sm"))
def smoothed_series(spark, d):
    return rounded(windows.smoothed(hourly_series(spark, d), ["system"], "idx", "x", 5.0), "x", places=10)


@query("stacked_profiles", "A55 W7", with_ctes(HOURLY_SQL, KERNEL_SQL.replace("5.0", "2.0").replace("-15, 16", "-6, 7"), """
bl AS (SELECT system, idx % 24 AS j, sum(x) AS x FROM series GROUP BY 1, 2), nb AS (SELECT system, j, x / sum(x) OVER (PARTITION BY system) AS x FROM bl),
gm AS (SELECT s.system, s.j, w, CASE WHEN s.j + k < 0 THEN -(s.j + k) WHEN s.j + k > 23 THEN 46 - (s.j + k) ELSE s.j + k END AS src FROM nb s, kr),
sm AS (SELECT gm.system, gm.j, sum(w * x) AS y FROM gm JOIN nb s ON s.system = gm.system AND s.j = gm.src GROUP BY 1, 2),
un AS (SELECT system, j, y / sum(y) OVER (PARTITION BY system) AS y FROM sm)""", select="SELECT system, j, round(y, 8) AS area, round(y / max(y) OVER (PARTITION BY system), 8) AS relative FROM un"))
def stacked_profiles(spark, d):
    prof = hourly_series(spark, d).groupBy("system", (F.col("idx") % 24).alias("j")).agg(F.sum("x").alias("x"))
    sm = windows.smoothed(prof, ["system"], "j", "x", 2.0)
    top = sm.groupBy("system").agg(F.max("x").alias("m"))
    return sm.join(top, "system").select("system", "j", F.round("x", 8).alias("area"), F.round(F.col("x") / F.col("m"), 8).alias("relative"))


INTEGRAL_SQL = """it AS (SELECT system, idx, sum(a) OVER (PARTITION BY system ORDER BY idx) AS integral FROM (SELECT system, idx, 0.5::DOUBLE * (x + lag(x) OVER w) * (idx - lag(idx) OVER w) AS a FROM series WINDOW w AS (PARTITION BY system ORDER BY idx)) WHERE a IS NOT NULL)"""


@query("running_integral", "W8", with_ctes(HOURLY_SQL, INTEGRAL_SQL, select="SELECT system, idx, round(integral, 4) AS integral FROM it"))
def running_integral(spark, d):
    return rounded(windows.cumulative_trapezoid(hourly_series(spark, d), ["system"], "idx", "x").drop("x"), "integral", places=4)


@query("running_integral_quality", "W9", with_ctes(HOURLY_SQL, INTEGRAL_SQL, """
nn AS (SELECT *, count(*) OVER (PARTITION BY system) AS n, row_number() OVER (PARTITION BY system ORDER BY idx) AS i, last_value(integral) OVER (PARTITION BY system ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM it),
qq AS (SELECT system, max(fin) AS final, max(abs(integral)) AS abs_max, min(CASE WHEN abs(integral) >= 0.9::DOUBLE * abs(fin) THEN idx END) AS time_to_90,
  regr_slope(integral, idx) FILTER (i > n - greatest(3, ceil(0.2::DOUBLE * n))) AS late_slope, max(idx) FILTER (i > n - greatest(3, ceil(0.2::DOUBLE * n))) - min(idx) FILTER (i > n - greatest(3, ceil(0.2::DOUBLE * n))) AS dd FROM nn GROUP BY 1)""", select="""
SELECT system, round(final, 4) AS final, round(abs_max, 4) AS abs_max, time_to_90, round(late_slope, 5) AS late_slope, round(abs(late_slope) * dd / abs(final), 8) AS late_relative_slope FROM qq"""))
def running_integral_quality(spark, d):
    it = windows.cumulative_trapezoid(hourly_series(spark, d), ["system"], "idx", "x")
    out = windows.running_integral_summary(it, ["system"], "idx")
    return out.select("system", F.round("final", 4).alias("final"), F.round("abs_max", 4).alias("abs_max"), "time_to_90", F.round("late_slope", 5).alias("late_slope"), F.round("late_relative_slope", 8).alias("late_relative_slope"))


IV_SQL = """iv AS (SELECT l_suppkey AS sp, l_orderkey * 4 + 1 AS "start", l_orderkey * 4 + 1 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem),
ln AS (SELECT max("end") + 10 AS len FROM iv),
cv AS (SELECT DISTINCT sp, unnest(range("start", "end" + 1)) AS p FROM iv),
an AS (SELECT sp, p, p - row_number() OVER (PARTITION BY sp ORDER BY p) AS g FROM cv)"""


def _intervals(spark, d) -> DataFrame:
    start = F.col("l_orderkey") * 4 + 1
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sp"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")).distinct()


@query("merged_intervals", "W10 P27 M18", with_ctes(IV_SQL, select='SELECT sp, min(p) AS "start", max(p) AS "end" FROM an GROUP BY sp, g'))
def merged_intervals(spark, d):
    return windows.merged_intervals(_intervals(spark, d), ["sp"])


@query("interval_complement", "W10", with_ctes(IV_SQL, """
isl AS (SELECT sp, min(p) AS a, max(p) AS b FROM an GROUP BY sp, g),
gp AS (SELECT sp, coalesce(lag(b) OVER (PARTITION BY sp ORDER BY a), 0) + 1 AS "start", a - 1 AS "end" FROM isl UNION ALL SELECT sp, max(b) + 1, any_value(len) FROM isl, ln GROUP BY sp)""", select='SELECT sp, "start", "end" FROM gp WHERE "start" <= "end"'))
def interval_complement(spark, d):
    iv = _intervals(spark, d)
    longest = iv.agg((F.max("end") + 10).alias("len"))
    lengths = iv.select("sp").distinct().crossJoin(F.broadcast(longest))
    return windows.interval_complement(iv, lengths, ["sp"], "len")


@query("near_equal_segments", "W15", with_ctes(HOURLY_SQL, """
sg AS (SELECT system, idx, x, ntile(7) OVER (PARTITION BY system ORDER BY idx) - 1 AS segment FROM series)""", select="SELECT system, CAST(segment AS INTEGER) AS segment, count(*) AS n, round(avg(x), 6) AS mean FROM sg GROUP BY 1, 2"))
def near_equal_segments(spark, d):
    seg = windows.split_near_equal(hourly_series(spark, d), ["system"], "idx", 7)
    return rounded(seg.groupBy("system", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")), "mean", places=6)


@query("fixed_segments", "W15", with_ctes(HOURLY_SQL, """
wd AS (SELECT system, (max(idx) + 1) // 7 AS w FROM series GROUP BY 1),
sg AS (SELECT system, idx // w AS segment, x FROM series JOIN wd USING (system))""", select="SELECT system, CAST(segment AS INTEGER) AS segment, count(*) AS n, round(avg(x), 6) AS mean FROM sg WHERE segment < 7 GROUP BY 1, 2"))
def fixed_segments(spark, d):
    seg = windows.fixed_segments(hourly_series(spark, d), ["system"], "idx", 7)
    return rounded(seg.groupBy("system", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")), "mean", places=6)


@query("thinned_series", "W14", with_ctes(HOURLY_SQL, """
nn AS (SELECT system, idx, x, count(*) OVER (PARTITION BY system) AS n FROM series),
sel AS (SELECT DISTINCT system, CAST(floor(k.k * (n - 1) / 12) AS BIGINT) AS idx FROM nn, range(13) k(k))""", select="SELECT system, idx, round(x, 6) AS x FROM series JOIN sel USING (system, idx)"))
def thinned_series(spark, d):
    return rounded(windows.thinned(hourly_series(spark, d), ["system"], "idx", 13), "x", places=6)


@query("origin_windows", "W16", with_ctes(HOURLY_SQL, """
ow AS (SELECT system, o.o AS origin, idx - o.o AS lag, x FROM series, range(0, 10000, 60) o(o), (SELECT max(idx) AS m FROM series) WHERE idx BETWEEN o.o AND o.o + 100 AND o.o + 100 <= m)""", select="""
SELECT system, CAST(origin AS DOUBLE) AS origin, count(*) AS n, round(avg(x), 6) AS mean FROM ow GROUP BY 1, 2 HAVING count(*) >= 30"""))
def origin_windows(spark, d):
    ow = windows.origin_windows(hourly_series(spark, d), ["system"], "idx", 100.0, 60.0)
    return rounded(ow.groupBy("system", F.col("origin").cast("double").alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")), "mean", places=6)


CROSS_SQL = """cc AS (SELECT p.idx, p.y AS a, q.y AS b FROM cu p JOIN cu q ON p.idx = q.idx AND p.system = 'click' AND q.system = 'view'),
cs AS (SELECT *, a - b AS dd, lag(a - b) OVER (ORDER BY idx) AS d0, lag(idx) OVER (ORDER BY idx) AS x0, lag(a) OVER (ORDER BY idx) AS a0, lag(b) OVER (ORDER BY idx) AS b0 FROM cc),
cr AS (SELECT *, CASE WHEN abs(dd - d0) < 1e-12 THEN 0.5 ELSE -d0 / (dd - d0) END AS part FROM cs WHERE (d0 < 0) <> (dd < 0))"""


def _two_curves(spark, d) -> DataFrame:
    cu = _cumulative(spark, d)
    return cu.filter("system = 'click'").select("idx", F.col("y").alias("a"), F.lit("click_view").alias("pair")).join(cu.filter("system = 'view'").select("idx", F.col("y").alias("b")), "idx")


@query("curve_crossings", "W17", with_ctes(HOURLY_SQL, CUM_SQL, CROSS_SQL, select="SELECT 'click_view' AS pair, round(x0 + part * (idx - x0), 6) AS crossing, round(0.5 * (a0 + part * (a - a0) + b0 + part * (b - b0)), 3) AS height FROM cr"))
def curve_crossings(spark, d):
    return windows.curve_crossings(_two_curves(spark, d), ["pair"], "idx", "a", "b").select("pair", F.round("crossing", 6).alias("crossing"), F.round("height", 3).alias("height"))


@query("outer_crossing", "W17", with_ctes(HOURLY_SQL, CUM_SQL, CROSS_SQL, """
cz AS (SELECT x0 + part * (idx - x0) AS crossing, 0.5 * (a0 + part * (a - a0) + b0 + part * (b - b0)) AS height FROM cr)""", select="""
SELECT 'click_view' AS pair, round(coalesce((SELECT max(crossing) FROM cz WHERE height BETWEEN 0 AND 20000), (SELECT max(crossing) FROM cz), (SELECT arg_min(idx, abs(a - b)) FROM cc)), 6) AS crossing"""))
def outer_crossing(spark, d):
    return rounded(windows.outer_crossing(_two_curves(spark, d), ["pair"], "idx", "a", "b", 20000.0), "crossing", places=6)


# --- joins in time ---------------------------------------------------------------------

NEAREST_SQL = """st AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'click'),
rf AS (SELECT user_id, epoch_us(ts) AS rt, event_id AS rid FROM events WHERE event_type = 'view'),
nr AS (SELECT st.*, rt, rid, row_number() OVER (PARTITION BY st.event_id ORDER BY abs(t - rt), rt DESC) AS rn FROM st JOIN rf USING (user_id))"""


def _clicks_and_views(spark, d):
    ev = event_time(spark, d).select("user_id", "event_type", "event_id", "t_us", "value")
    clicks = ev.filter("event_type = 'click'").select("user_id", F.col("t_us").alias("t"), "event_id", "value")
    views = ev.filter("event_type = 'view'").select("user_id", F.col("t_us").alias("rt"), F.col("event_id").alias("rid"))
    return clicks, views


@query("nearest_in_time", "J4", with_ctes(NEAREST_SQL, select="SELECT user_id, event_id, t, rt, rid FROM nr WHERE rn = 1"))
def nearest_in_time(spark, d):
    clicks, views = _clicks_and_views(spark, d)
    return asof.nearest_in_time(clicks.drop("value"), views, ["user_id"], "t", "rt", ["rid"], 86_400_000_000)


@query("member_stress", "J5", """
WITH rw AS (SELECT event_type AS system, epoch_us(ts) // 3600000000 AS step, user_id AS chain, value FROM events),
fr AS (SELECT DISTINCT event_type AS system, epoch_us(ts) // 21600000000 AS frame, epoch_us(ts) // 21600000000 * 6 + 3 AS fstep FROM events WHERE value > 120),
mb AS (SELECT DISTINCT event_type AS system, epoch_us(ts) // 21600000000 AS frame, user_id AS chain FROM events),
stp AS (SELECT DISTINCT system, step FROM rw),
nr AS (SELECT system, step, frame, row_number() OVER (PARTITION BY system, step ORDER BY abs(step - fstep), fstep DESC) AS rn FROM stp JOIN fr USING (system))
SELECT rw.system, rw.step, round(sum(value), 6) AS value FROM rw JOIN nr ON nr.system = rw.system AND nr.step = rw.step AND rn = 1
WHERE EXISTS (SELECT 1 FROM mb WHERE mb.system = rw.system AND mb.frame = nr.frame AND mb.chain = rw.chain) GROUP BY 1, 2""")
def member_stress(spark, d):
    ev = event_time(spark, d).withColumn("system", F.col("event_type"))
    rows = ev.select("system", F.expr("t_us div 3600000000").alias("step"), F.col("user_id").alias("chain"), "value")
    quarter = F.expr("t_us div 21600000000")
    frames = ev.filter("value > 120").select("system", quarter.alias("frame"), (quarter * 6 + 3).alias("fstep")).distinct()
    inside = ev.select("system", quarter.alias("frame"), F.col("user_id").alias("chain"), F.lit(True).alias("inside")).distinct()
    out = asof.sum_over_members(rows, frames, inside, ["system"], "step", "fstep", "frame", "chain", ["value"], 48)
    return rounded(out, "value", places=6)


@query("interval_means", "J6", with_ctes(USERS_SQL, """
fi AS (SELECT system, min(idx) AS first FROM uw GROUP BY 1),
seg AS (SELECT DISTINCT system, first + (idx - first) // 4 * 4 AS s, first + (idx - first) // 4 * 4 + 4 AS e FROM uw JOIN fi USING (system))""", select="""
SELECT seg.system, s AS "start", round(avg(value), 8) AS mean, count(*) AS n FROM seg JOIN uw ON uw.system = seg.system AND s <= idx AND idx < e GROUP BY 1, 2"""))
def interval_means(spark, d):
    uw = user_weeks(spark, d)
    first = uw.groupBy("system").agg(F.min("idx").alias("first"))
    seg = uw.join(first, "system").select("system", F.expr("first + (idx - first) div 4 * 4").alias("start")).distinct().withColumn("end", F.col("start") + 4)
    out = asof.in_intervals(uw.select("system", "idx", "value"), seg, ["system"], "idx", "start", "end", 4)
    return rounded(out.groupBy("system", "start").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")), "mean", places=8)
