"""Windowed observables and their block-corrected statistics over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trajstats.functions import scalars
from trajstats.functions.stats import t_multiplier_sql
from trajstats.operators import blocks, rollups
from trajstats.plans import block_sql as q
from trajstats.plans.registry import query
from trajstats.plans.views import OBS_SQL, USERS_SQL, daily_observables, event_time, user_weeks, with_ctes

KEYS = ["system", "observable_key"]
K = "system, observable_key"
POS = (OBS_SQL, q.pos_sql("obs", K), q.win_sql(K))
BLOCKS = POS + (q.offsets_sql("win", K), q.summary_sql(K), q.plateau_sql(K))
SIZES = BLOCKS + (q.acf_sql("win", K), q.g_sql(K), q.rec_sql(K))
FULL = SIZES + (q.estimate_sql("win", "rec", K), q.ci_sql(K))


def rounded(df: DataFrame, *cols: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def _pos(spark, d):
    return blocks.winsorized(blocks.positioned(daily_observables(spark, d), KEYS, "idx"), KEYS)


def _sizes(spark, d):
    pos = _pos(spark, d)
    pl = blocks.plateau_block(blocks.superblock_summary(blocks.superblock_offsets(pos, KEYS), KEYS), KEYS)
    return blocks.recommended_block(pl, blocks.series_inefficiency(pos, KEYS), KEYS)


@query("corrected_observables", "M13 W1 W2 B1 B2 B3 B4 B5 B10 B13", with_ctes(*FULL, select="""
SELECT system, observable_key, n, CAST(b AS INTEGER) AS b, correlation_flag, round(mean, 8) AS mean, round(sem, 8) AS sem, n_blocks,
       round(mean - t_multiplier * sem, 8) AS ci_low, round(mean + t_multiplier * sem, 8) AS ci_high, round(g, 8) AS g FROM ci"""))
def corrected_observables(spark, d):
    out = blocks.corrected_series(daily_observables(spark, d), KEYS, "idx")
    return rounded(out.select(*KEYS, "n", "b", "correlation_flag", "mean", "sem", "n_blocks", "ci_low", "ci_high", "g"), "mean", "sem", "ci_low", "ci_high", "g")


@query("window_means", "W1 A24 M13", """
SELECT event_type AS system, epoch_us(ts) // 21600000000 * 6 AS window_h, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd,
       round(stddev_samp(value) / sqrt(count(value)), 8) AS sem, count(value) AS n FROM events GROUP BY 1, 2""")
def window_means(spark, d):
    ev = event_time(spark, d).select(F.col("event_type").alias("system"), (F.expr("t_us div 21600000000") * 6).alias("window_h"), "value")
    return rounded(rollups.mean_sem(ev, ["system", "window_h"], "value"), "mean", "sd", "sem")


@query("winsorized_series", "W2", with_ctes(*POS, select="SELECT system, observable_key, idx, i, n, round(value, 8) AS value FROM win"))
def winsorized_series(spark, d):
    return rounded(_pos(spark, d), "value").select(*KEYS, "idx", F.col("i").cast("long").alias("i"), "n", "value")


@query("block_layout", "B1 M15", with_ctes(*POS, q.offsets_sql("win", K), select="""
SELECT system, observable_key, CAST(b AS INTEGER) AS b, CAST("offset" AS INTEGER) AS "offset", block, round(block_mean, 8) AS block_mean FROM bm"""))
def block_layout(spark, d):
    return rounded(blocks.block_means(_pos(spark, d), KEYS).drop("n"), "block_mean")


@query("superblock_offsets", "B2", with_ctes(*POS, q.offsets_sql("win", K), select="""
SELECT system, observable_key, CAST(b AS INTEGER) AS b, CAST("offset" AS INTEGER) AS "offset", n_blocks, round(mean_blocks, 8) AS mean_blocks,
       round(sd_blocks, 8) AS sd_blocks, round(se_blocks, 8) AS se_blocks, eligible FROM so"""))
def superblock_offsets(spark, d):
    return rounded(blocks.superblock_offsets(_pos(spark, d), KEYS).drop("n"), "mean_blocks", "sd_blocks", "se_blocks")


@query("superblock_summary", "B3", with_ctes(*POS, q.offsets_sql("win", K), q.summary_sql(K), select="""
SELECT system, observable_key, CAST(b AS INTEGER) AS b, n_offsets, n_eligible, round(se_mean, 8) AS se_mean, round(se_median, 8) AS se_median,
       round(se_min, 8) AS se_min, round(se_max, 8) AS se_max, round(se_choice, 8) AS se_choice FROM ss"""))
def superblock_summary(spark, d):
    out = blocks.superblock_summary(blocks.superblock_offsets(_pos(spark, d), KEYS), KEYS).drop("n")
    return rounded(out, "se_mean", "se_median", "se_min", "se_max", "se_choice")


@query("plateau_block", "B4 W3", with_ctes(*BLOCKS, select="""
SELECT system, observable_key, round(plateau, 8) AS plateau, CAST(b_max AS INTEGER) AS b_max, CAST(b_plateau AS INTEGER) AS b_plateau FROM pl"""))
def plateau_block(spark, d):
    summary = blocks.superblock_summary(blocks.superblock_offsets(_pos(spark, d), KEYS), KEYS)
    return rounded(blocks.plateau_block(summary, KEYS), "plateau")


@query("all_offset_estimate", "B5", with_ctes(*FULL, select="""
SELECT system, observable_key, CAST(est.b AS INTEGER) AS b, n_offsets, round(mean, 8) AS mean, round(sem, 8) AS sem, round(sem_min, 8) AS sem_min,
       round(sem_max, 8) AS sem_max, round(offset_mean, 8) AS offset_mean, n_blocks, n_blocks_median, n_blocks_max FROM est JOIN mn USING (system, observable_key)"""))
def all_offset_estimate(spark, d):
    out = blocks.all_offset_estimate(_pos(spark, d), _sizes(spark, d), KEYS).drop("sd", "n")
    return rounded(out, "mean", "sem", "sem_min", "sem_max", "offset_mean")


@query("autocorrelation", "B6 J15", with_ctes(*POS, q.acf_sql("win", K, "n - 1"), select="""
SELECT system, observable_key, lag, round(acf, 8) AS acf FROM ac WHERE lag <= 15"""))
def autocorrelation(spark, d):
    out = blocks.autocorrelation(_pos(spark, d), KEYS, 15)
    return rounded(out.select(*KEYS, F.col("lag").cast("long").alias("lag"), "acf"), "acf")


@query("statistical_inefficiency", "B7", with_ctes(*POS, q.acf_sql("win", K), q.g_sql(K), select="""
SELECT system, observable_key, n, round(g, 8) AS g, round((g - 1) / 2, 8) AS tau, round(n / g, 8) AS n_eff FROM gg"""))
def statistical_inefficiency(spark, d):
    return rounded(blocks.series_inefficiency(_pos(spark, d), KEYS), "g", "tau", "n_eff")


@query("decorrelated_subsample", "B8", with_ctes(*POS, q.acf_sql("win", K), q.g_sql(K), select="""
SELECT system, observable_key, idx, round(value, 8) AS value FROM win JOIN gg USING (system, observable_key) WHERE i % CAST(ceil(g) AS BIGINT) = 0"""))
def decorrelated_subsample(spark, d):
    pos = _pos(spark, d)
    g = blocks.series_inefficiency(pos, KEYS)
    return rounded(blocks.decorrelated(pos, g, KEYS).select(*KEYS, "idx", "value"), "value")


@query("equilibration_start", "B9 P20", with_ctes(*POS, """
probes AS (SELECT 1 + k * (k - 1) // 2 AS lag, k AS weight FROM range(1, 40) r(k)),
suf AS (SELECT p.system, p.observable_key, p.n, p.i AS t0, q.i - p.i AS j, q.value FROM win p JOIN win q ON p.system = q.system AND p.observable_key = q.observable_key AND q.i >= p.i),
sm AS (SELECT system, observable_key, n, t0, n - t0 AS m, avg(value) AS mu, var_pop(value) AS var FROM suf GROUP BY ALL),
pr AS (
  SELECT a.system, a.observable_key, a.n, a.t0, lag, weight, m, sum((a.value - mu) * (b.value - mu)) / ((m - lag) * any_value(var)) AS c
  FROM suf a JOIN sm USING (system, observable_key, t0), probes
  JOIN suf b ON a.system = b.system AND a.observable_key = b.observable_key AND a.t0 = b.t0 AND b.j = a.j + lag
  WHERE lag <= m - 2 GROUP BY a.system, a.observable_key, a.n, a.t0, lag, weight, m),
ps AS (SELECT *, min(CASE WHEN lag > 3 AND c <= 0 THEN lag END) OVER (PARTITION BY system, observable_key, t0) AS stop FROM pr),
pg AS (SELECT system, observable_key, n, t0, m, greatest(1.0::DOUBLE, 1.0::DOUBLE + 2.0::DOUBLE * coalesce(sum(c * (1 - lag / m) * weight) FILTER (stop IS NULL OR lag < stop), 0)) AS g FROM ps GROUP BY ALL),
pn AS (SELECT *, (m + 1) / g AS n_eff, row_number() OVER (PARTITION BY system, observable_key ORDER BY round((m + 1) / g, 9) DESC, t0) AS rn FROM pg)""", select="""
SELECT system, observable_key, t0, round(g, 8) AS g, round(n_eff, 8) AS n_eff, round(t0 / n, 8) AS fraction_discarded,
       CASE WHEN t0 <= 2 AND t0 / n <= 0.5 THEN 'agree_with_default' WHEN t0 <= 6 AND t0 / n <= 0.5 THEN 'later_than_default_soft' ELSE 'later_than_default_hard' END AS audit
FROM pn WHERE rn = 1"""))
def equilibration_start(spark, d):
    out = blocks.equilibration(_pos(spark, d), KEYS)
    out = out.withColumn("audit", scalars.equilibration_audit(F.col("t0"), F.col("fraction_discarded"), 2, 6, 0.5))
    return rounded(out.withColumn("t0", F.col("t0").cast("long")), "g", "n_eff", "fraction_discarded")


@query("recommended_block", "B10", with_ctes(*SIZES, select="""
SELECT system, observable_key, CAST(b_plateau AS INTEGER) AS b_plateau, CAST(b AS INTEGER) AS b, round(g, 8) AS g, correlation_flag FROM rec"""))
def recommended_block(spark, d):
    return rounded(_sizes(spark, d).select(*KEYS, "b_plateau", "b", "g", "correlation_flag"), "g")


@query("family_block", "B11", with_ctes(*SIZES, select="""
SELECT system, CAST(coalesce(max(b) FILTER (observable_key IN ('mean_value', 'n_events')), max(b)) AS INTEGER) AS b FROM rec GROUP BY system"""))
def family_block(spark, d):
    return blocks.family_block(_sizes(spark, d), ["system"], "observable_key", ["mean_value", "n_events"])


KC = "system, observable_key, cutoff"


@query("equilibration_sensitivity", "B12 J11", with_ctes(
    OBS_SQL, "cut AS (SELECT system, observable_key, cutoff, idx, value FROM obs, (VALUES (0), (5), (10)) v(cutoff) WHERE idx >= cutoff)",
    q.pos_sql("cut", KC), q.win_sql(KC), q.offsets_sql("win", KC), q.summary_sql(KC), q.plateau_sql(KC), q.acf_sql("win", KC), q.g_sql(KC), q.rec_sql(KC),
    q.estimate_sql("win", "rec", KC), q.ci_sql(KC), select="""
SELECT c.system, c.observable_key, c.cutoff, c.n, CAST(c.b AS INTEGER) AS b, round(c.mean, 8) AS mean, round(c.sem, 8) AS sem,
       round((c.mean - z.mean) / abs(z.mean), 8) AS relative_shift
FROM ci c LEFT JOIN ci z ON z.system = c.system AND z.observable_key = c.observable_key AND z.cutoff = 0"""))
def equilibration_sensitivity(spark, d):
    out = blocks.sensitivity(daily_observables(spark, d), KEYS, "idx", [0, 5, 10])
    return rounded(out.select(*KEYS, "cutoff", "n", "b", "mean", "sem", "relative_shift"), "mean", "sem", "relative_shift")


@query("t_intervals", "B13 S13 J10", with_ctes(*FULL, select="""
SELECT system, observable_key, n_blocks, round(t_multiplier, 8) AS t_multiplier, round(mean, 8) AS mean,
       round(mean - t_multiplier * sem, 8) AS ci_low, round(mean + t_multiplier * sem, 8) AS ci_high FROM ci"""))
def t_intervals(spark, d):
    pos = _pos(spark, d)
    est = blocks.with_interval(blocks.all_offset_estimate(pos, _sizes(spark, d), KEYS))
    return rounded(est.select(*KEYS, "n_blocks", "t_multiplier", "mean", "ci_low", "ci_high"), "t_multiplier", "mean", "ci_low", "ci_high")


KU = "category, system"
USER_POS = (USERS_SQL, q.pos_sql("uw", KU))
USER_FULL = USER_POS + (
    q.offsets_sql("pos", KU, "range(1, 51) r(b)", "r.b <= greatest(2, n // 4)", 2), q.summary_sql(KU), q.plateau_sql(KU), q.acf_sql("pos", KU), q.g_sql(KU),
    f"""cs0 AS (SELECT {KU}, gg.n, g, greatest(1, least(greatest(coalesce(b_plateau, 1), CAST(ceil(g) AS INTEGER)), greatest(gg.n // 2, 1))) AS b FROM gg LEFT JOIN pl USING ({KU}))""",
    q.estimate_sql("pos", "cs0", KU),
    f"""cs1 AS (SELECT {KU}, mn.n, mean, CASE WHEN mn.n = 1 OR sd = 0 THEN 0.0 ELSE coalesce(sem, sd * sqrt(g / mn.n)) END AS sem, CASE WHEN mn.n = 1 OR sd = 0 THEN 1.0 ELSE g END AS g,
      CAST(CASE WHEN mn.n = 1 OR sd = 0 THEN 1 ELSE est.b END AS INTEGER) AS b,
      CAST(CASE WHEN mn.n = 1 OR sd = 0 THEN mn.n WHEN sem IS NULL THEN greatest(1, floor(mn.n / g)) ELSE n_blocks END AS BIGINT) AS n_blocks
      FROM est JOIN mn USING ({KU}) JOIN cs0 USING ({KU}))""",
    f"""cs AS (SELECT *, CASE WHEN sem = 0 THEN 0.0 WHEN n_blocks > 1 THEN ({t_multiplier_sql('n_blocks - 1')}) * sem END AS ci95 FROM cs1)""")


@query("corrected_stats", "B14", with_ctes(*USER_FULL, select="""
SELECT category, system, n, round(mean, 8) AS mean, round(sem, 8) AS sem, round(g, 8) AS g, b, n_blocks, round(ci95, 8) AS ci95 FROM cs"""))
def corrected_stats(spark, d):
    out = blocks.corrected_stats(user_weeks(spark, d), ["category", "system"], "idx")
    return rounded(out, "mean", "sem", "g", "ci95")


@query("class_corrected_means", "B15 A25", with_ctes(*USER_FULL, select="""
SELECT category, round(avg(mean), 8) AS mean, round(stddev_samp(mean) / sqrt(count(mean)), 8) AS sem, count(mean) AS n FROM cs GROUP BY category"""))
def class_corrected_means(spark, d):
    units = blocks.corrected_stats(user_weeks(spark, d), ["category", "system"], "idx")
    return rounded(rollups.class_means(units, ["category"], "mean"), "mean", "sem")


@query("ordered_block_sem", "B16", with_ctes(
    OBS_SQL, q.pos_sql("obs", K), """
ob AS (SELECT system, observable_key, n, r.b AS b, i // r.b AS block, avg(value) AS bm FROM pos, range(1, 500) r(b) WHERE r.b <= n // 2 AND i // r.b < n // r.b GROUP BY ALL),
os AS (SELECT system, observable_key, b, count(*) AS n_blocks, stddev_samp(bm) / sqrt(count(*)) AS sem FROM ob GROUP BY ALL HAVING stddev_samp(bm) > 0),
ot AS (SELECT *, max(sem) OVER (PARTITION BY system, observable_key) AS top FROM os)""", select="""
SELECT system, observable_key, round(max(top), 8) AS sem, CAST(min(b) FILTER (sem >= 0.95 * top) AS INTEGER) AS b,
       arg_min(n_blocks, b) FILTER (sem >= 0.95 * top) AS n_blocks FROM ot GROUP BY ALL"""))
def ordered_block_sem(spark, d):
    return rounded(blocks.ordered_block_sem(daily_observables(spark, d), KEYS, "idx"), "sem")
