"""Displacement curves, stress correlation, confinement, resampling and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trajstats.functions.draws import normal_sql, uniform_sql
from trajstats.operators import histograms as hist, lags, rollups, windows
from trajstats.plans.registry import query
from trajstats.plans.series_plans import rounded
from trajstats.plans.views import CONDITIONS_SQL, FRAMES_SQL, HOURLY_SQL, condition_orders, frames, hourly_series, table, with_ctes

COM_SQL = """cm AS (SELECT frame, chain_id, any_value(species) AS species, sum(mass * xu) / sum(mass) AS x, sum(mass * yu) / sum(mass) AS y, sum(mass * zu) / sum(mass) AS z FROM fr GROUP BY 1, 2),
ct AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cm GROUP BY 1),
cr AS (SELECT frame, chain_id, species, x - mx AS x, y - my AS y, z - mz AS z FROM cm JOIN ct USING (frame)),
ms AS (SELECT a.species, a.chain_id, b.frame - a.frame AS lag, avg(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS msd, count(*) AS n FROM cr a JOIN cr b ON a.chain_id = b.chain_id AND b.frame >= a.frame GROUP BY 1, 2, 3)"""


def _com(spark, d) -> DataFrame:
    com = hist.centre_of_mass(frames(spark, d), ["frame", "species", "chain_id"], names=("x", "y", "z")).drop("mass_total", "n_beads")
    return lags.comoving(com, [], "frame")


def _msd(spark, d) -> DataFrame:
    return lags.displacement_curve(_com(spark, d), ["species", "chain_id"], "frame", F.sequence(F.lit(0), F.lit(20)))


@query("displacement_curve", "B20 J15", with_ctes(FRAMES_SQL, COM_SQL, select="SELECT species, chain_id, CAST(lag AS INTEGER) AS lag, round(msd, 4) AS msd, n FROM ms"))
def displacement_curve(spark, d):
    return rounded(_msd(spark, d), "msd", places=4)


@query("displacement_curve_fft", "B20", with_ctes(FRAMES_SQL, COM_SQL, select="SELECT species, chain_id, CAST(lag AS BIGINT) AS lag, round(msd, 4) AS msd, n FROM ms"))
def displacement_curve_fft(spark, d):
    return rounded(lags.displacement_curve_fft(_com(spark, d), ["species", "chain_id"], "frame"), "msd", places=4)


@query("species_displacement", "B21", with_ctes(FRAMES_SQL, COM_SQL, select="""
SELECT species, CAST(lag AS INTEGER) AS lag, round(avg(msd), 4) AS mean, round(stddev_samp(msd), 4) AS sd, round(stddev_samp(msd) / sqrt(count(*)), 4) AS sem, count(*) AS n FROM ms GROUP BY 1, 2"""))
def species_displacement(spark, d):
    return rounded(rollups.mean_sem(_msd(spark, d), ["species", "lag"], "msd"), "mean", "sd", "sem", places=4)


# --- stress: three components from hourly sums ------------------------------------------

STRESS_SQL = HOURLY_SQL + """,
wd AS (SELECT system, (max(idx) + 1) // 10 AS w FROM series GROUP BY 1),
sg AS (SELECT s.system, idx // w AS segment, idx % w AS pos, w, (x - 700) / 100 AS pxy, (x - 600) * cos(idx) / 100 AS pxz, sin(x) AS pyz FROM series s JOIN wd USING (system) WHERE idx // w < 10)"""
ACF_SQL = """z0 AS (SELECT system, segment, 0 AS lag, (avg(pxy * pxy) + avg(pxz * pxz) + avg(pyz * pyz)) / 3 AS acf FROM sg GROUP BY 1, 2),
bk AS (SELECT system, segment, l.l AS lag, pos // l.l AS b, avg(pxy) AS a1, avg(pxz) AS a2, avg(pyz) AS a3 FROM sg, range(1, 400) l(l) WHERE l.l < w // 2 AND pos // l.l < w // l.l GROUP BY ALL),
pr AS (SELECT system, segment, lag, a1 * lead(a1) OVER q AS p1, a2 * lead(a2) OVER q AS p2, a3 * lead(a3) OVER q AS p3 FROM bk WINDOW q AS (PARTITION BY system, segment, lag ORDER BY b)),
ac AS (SELECT * FROM z0 UNION ALL SELECT system, segment, lag, (avg(p1) + avg(p2) + avg(p3)) / 3 FROM pr WHERE p1 IS NOT NULL GROUP BY 1, 2, 3)"""


def _segments(spark, d) -> DataFrame:
    s = windows.fixed_segments(hourly_series(spark, d), ["system"], "idx", 10)
    x = F.col("x")
    return s.select("system", "segment", "pos", ((x - 700) / 100).alias("pxy"), ((x - 600) * F.cos("idx") / 100).alias("pxz"), F.sin(x).alias("pyz"))


@query("stress_correlation", "B22", with_ctes(STRESS_SQL, ACF_SQL, select="SELECT system, CAST(segment AS INTEGER) AS segment, CAST(lag AS INTEGER) AS lag, round(acf, 8) AS acf FROM ac"))
def stress_correlation(spark, d):
    return rounded(lags.stress_correlation(_segments(spark, d), ["system"]), "acf")


@query("stress_correlation_plain", "B22", with_ctes(STRESS_SQL, select="""
SELECT a.system, CAST(a.segment AS INTEGER) AS segment, CAST(b.pos - a.pos AS INTEGER) AS lag, round((avg(a.pxy * b.pxy) + avg(a.pxz * b.pxz) + avg(a.pyz * b.pyz)) / 3, 8) AS acf
FROM sg a JOIN sg b ON a.system = b.system AND a.segment = b.segment AND b.pos >= a.pos AND b.pos - a.pos < a.w // 2 GROUP BY 1, 2, 3"""))
def stress_correlation_plain(spark, d):
    return rounded(lags.stress_correlation(_segments(spark, d), ["system"], kernel="plain"), "acf")


@query("correlation_bootstrap", "B23", with_ctes(STRESS_SQL, ACF_SQL, f"""
dw AS (SELECT r.r AS replicate, CAST(floor({uniform_sql('7', 'r.r', 's.s')} * 10) AS BIGINT) AS segment, count(*) AS weight FROM range(20) r(r), range(10) s(s) GROUP BY 1, 2)""", select="""
SELECT system, CAST(replicate AS INTEGER) AS replicate, CAST(lag AS INTEGER) AS lag, round(sum(weight * acf) / sum(weight), 8) AS acf FROM ac JOIN dw ON dw.segment = ac.segment GROUP BY 1, 2, 3"""))
def correlation_bootstrap(spark, d):
    acf = lags.stress_correlation(_segments(spark, d), ["system"])
    return rounded(lags.bootstrap_curves(acf, ["system"], "segment", "lag", "acf", 20, seed=7), "acf")


ETA_SQL = """et AS (SELECT system, segment, lag, sum(a) OVER (PARTITION BY system, segment ORDER BY lag) AS eta FROM (
  SELECT system, segment, lag, 0.5::DOUBLE * (acf + lag(acf) OVER q) * (lag - lag(lag) OVER q) * (1e-9::DOUBLE * 1e-22 / (1.3806e-23 * 300)) AS a FROM ac WINDOW q AS (PARTITION BY system, segment ORDER BY lag)) WHERE a IS NOT NULL)"""


@query("green_kubo_viscosity", "B24 P7", with_ctes(STRESS_SQL, ACF_SQL, ETA_SQL, select="""
SELECT system, CAST(segment AS INTEGER) AS segment, round(arg_max(eta, lag) * 1e9, 6) AS eta_final, round(max(abs(eta)) * 1e9, 6) AS eta_abs_max FROM et GROUP BY 1, 2"""))
def green_kubo_viscosity(spark, d):
    acf = lags.stress_correlation(_segments(spark, d), ["system"])
    eta = lags.green_kubo(acf, ["system", "segment"], F.lit(1e-22), F.lit(300.0), 1e-9)
    out = windows.running_integral_summary(eta, ["system", "segment"], "lag", "eta")
    return out.select("system", "segment", F.round(F.col("final") * 1e9, 6).alias("eta_final"), F.round(F.col("abs_max") * 1e9, 6).alias("eta_abs_max"))


# --- confinement: rolling sums have a curve that rises and levels off -------------------

ROLLED_SQL = HOURLY_SQL + """,
ro AS (SELECT system, idx, sum(x) OVER (PARTITION BY system ORDER BY idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) / 100 AS x FROM series),
cv AS (SELECT a.system, b.idx - a.idx AS lag, avg(pow(b.x - a.x, 2)) AS msd FROM ro a JOIN ro b ON a.system = b.system AND b.idx >= a.idx AND b.idx - a.idx <= 200 AND (b.idx - a.idx) % 2 = 0 GROUP BY 1, 2)"""


def _rolled(spark, d) -> DataFrame:
    w = W.partitionBy("system").orderBy("idx").rowsBetween(0, 23)
    return hourly_series(spark, d).select("system", "idx", (F.sum("x").over(w) / 100).alias("x"))


def _curve(spark, d) -> DataFrame:
    out = lags.displacement_curve(_rolled(spark, d), ["system"], "idx", F.sequence(F.lit(0), F.lit(200), F.lit(2)), ["x"])
    return out.select("system", "lag", "msd")


def confinement_sql(k: str, cv_max: str = "0.9", skip: int = 5, min_points: int = 30, min_plateau: int = 20) -> str:
    """Plateau and crossing of the CTE cv (keys, lag, msd)."""
    return f"""us AS (SELECT * FROM cv WHERE lag > {skip} AND msd > 0),
sn AS (SELECT {k}, min(lag) AS a, max(lag) AS b FROM us GROUP BY {k} HAVING count(*) >= {min_points}),
pt AS (SELECT {k}, median(msd) AS l_sq, stddev_samp(msd) AS sd, count(*) AS n_plateau FROM us JOIN sn USING ({k}) WHERE lag >= a + 0.3::DOUBLE * (b - a) AND lag <= a + 0.85::DOUBLE * (b - a) GROUP BY {k} HAVING count(*) >= {min_plateau}),
pl AS (SELECT {k}, l_sq, sd, n_plateau, sd / l_sq AS plateau_cv, sqrt(l_sq) AS l, sd / sqrt(n_plateau) / (2 * sqrt(l_sq)) AS l_sem,
  (SELECT min(us.lag) FROM us WHERE {' AND '.join(f'us.{c.strip()} = pt.{c.strip()}' for c in k.split(','))} AND us.msd >= 0.9::DOUBLE * l_sq) AS plateau_start FROM pt WHERE sd / l_sq <= {cv_max}),
lc AS (SELECT cv.*, l_sq, sd, 0.6321::DOUBLE * l_sq AS level, lag(cv.lag) OVER q AS t0, lag(msd) OVER q AS y0,
  CASE WHEN count(*) OVER z >= 4 THEN regr_slope(msd, cv.lag) OVER z END AS slope FROM cv JOIN pl USING ({k}) WINDOW q AS (PARTITION BY {k} ORDER BY cv.lag), z AS (PARTITION BY {k} ORDER BY cv.lag ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
fh AS (SELECT *, CASE WHEN y0 < level THEN t0 + (level - y0) / (msd - y0) * (lag - t0) ELSE lag END AS tau, CASE WHEN slope > 0 AND sd > 0 THEN sd / slope END AS tau_sem,
  row_number() OVER (PARTITION BY {k} ORDER BY lag) AS rn FROM lc WHERE msd >= level),
cf AS (SELECT pl.*, tau, tau_sem, pl.l_sq / (6 * tau) AS d, pl.l_sq / (6 * tau) * sqrt(pow(2 * l_sem / l, 2) + coalesce(pow(tau_sem / tau, 2), 0)) AS d_sem FROM pl LEFT JOIN (SELECT * FROM fh WHERE rn = 1) f USING ({k}))"""


@query("curve_plateau", "B26", with_ctes(ROLLED_SQL, confinement_sql("system"), select="""
SELECT system, round(l, 6) AS l, round(l_sem, 6) AS l_sem, CAST(plateau_start AS INTEGER) AS plateau_start, round(plateau_cv, 6) AS plateau_cv, n_plateau FROM pl"""))
def curve_plateau(spark, d):
    out = lags.plateau(_curve(spark, d), ["system"], cv_max=0.9)
    return rounded(out.select("system", "l", "l_sem", "plateau_start", "plateau_cv", "n_plateau"), "l", "l_sem", "plateau_cv", places=6)


@query("two_stage_confinement", "B27 W4", with_ctes(ROLLED_SQL, confinement_sql("system"), select="""
SELECT system, round(l, 6) AS l, round(tau, 6) AS tau, round(tau_sem, 6) AS tau_sem, round(d, 6) AS d, round(d_sem, 6) AS d_sem FROM cf"""))
def two_stage_confinement(spark, d):
    out = lags.confinement(_curve(spark, d), ["system"], cv_max=0.9)
    return rounded(out.select("system", "l", "tau", "tau_sem", "d", "d_sem"), "l", "tau", "tau_sem", "d", "d_sem", places=6)


@query("linearised_tau", "B28", with_ctes(ROLLED_SQL, confinement_sql("system"), """
lz AS (SELECT system, lag::DOUBLE AS t, ln(1 - msd / l_sq) AS z FROM cv JOIN pl USING (system) WHERE lag > 1 AND msd > 0 AND msd < 0.9::DOUBLE * l_sq AND 1 - msd / l_sq > 0.01),
lf AS (SELECT system, regr_slope(z, t) AS s, regr_r2(z, t) AS r2, count(*) AS n FROM lz GROUP BY 1)""", select="""
SELECT system, round(-1 / s, 6) AS tau, round(abs(s) * sqrt((1 / r2 - 1) / (n - 2)) / (s * s), 6) AS tau_sem, round(r2, 8) AS r2, n FROM lf WHERE n >= 4 AND s < 0"""))
def linearised_tau(spark, d):
    curve = _curve(spark, d)
    out = lags.linearised_tau(curve, lags.plateau(curve, ["system"], cv_max=0.9), ["system"], skip=1.0, min_points=4)
    return rounded(out, "tau", "tau_sem", places=6).withColumn("r2", F.round("r2", 8))


ORIGIN_SQL = ROLLED_SQL.replace("cv AS (", "cv_all AS (") + """,
ln AS (SELECT * FROM (VALUES (200), (400)) v(length)),
og AS (SELECT ro.system, length, o.o AS origin, idx - o.o AS t, x FROM ro, ln, range(0, 20000, 100) o(o), (SELECT max(idx) AS m FROM ro) WHERE idx BETWEEN o.o AND o.o + length AND o.o + length <= m),
cv AS (SELECT a.system, a.length, a.origin, b.t - a.t AS lag, avg(pow(b.x - a.x, 2)) AS msd FROM og a JOIN og b ON a.system = b.system AND a.length = b.length AND a.origin = b.origin AND b.t >= a.t AND (b.t - a.t) % 4 = 0 GROUP BY ALL)"""
ORIGIN_FIT_SQL = confinement_sql("system, length, origin", "0.5") + """,
ot AS (SELECT system, length, count(DISTINCT origin) AS n_total FROM og GROUP BY 1, 2),
os AS (SELECT system, length, n_total, coalesce(n_success, 0) AS n_success, coalesce(n_success, 0) / n_total AS share FROM ot LEFT JOIN (SELECT system, length, count(l) AS n_success FROM cf GROUP BY 1, 2) USING (system, length)),
ok AS (SELECT *, n_success >= 3 AND share >= 0.7 AS accepted, row_number() OVER (PARTITION BY system ORDER BY n_success >= 3 DESC, (n_success >= 3 AND share >= 0.7) DESC, CASE WHEN n_success >= 3 AND share >= 0.7 THEN -length ELSE share END DESC, n_success DESC, length) AS rn FROM os)"""


def _origins(spark, d):
    return lags.origin_resample(_rolled(spark, d), ["system"], "idx", [200, 400], 100, 4, ["x"], cv_max=0.5)


@query("origin_resample", "B29 W16", with_ctes(ORIGIN_SQL, ORIGIN_FIT_SQL, select="""
SELECT system, CAST(length AS DOUBLE) AS length, n_total, n_success, round(share, 8) AS success_share, rn = 1 AND n_success >= 3 AS chosen FROM ok"""))
def origin_resample(spark, d):
    return rounded(_origins(spark, d)[0], "success_share")


@query("origin_fits", "B29", with_ctes(ORIGIN_SQL, ORIGIN_FIT_SQL, select="""
SELECT system, CAST(length AS DOUBLE) AS length, CAST(origin AS DOUBLE) AS origin, round(l, 6) AS l, round(tau, 6) AS tau, round(d, 6) AS d FROM cf"""))
def origin_fits(spark, d):
    out = _origins(spark, d)[1]
    return rounded(out.withColumn("origin", F.col("origin").cast("double")), "l", "tau", "d", places=6)


UNIT_SQL = """ut AS (SELECT n_regionkey AS grp, s_nationkey AS unit, avg(s_acctbal) AS v, stddev_samp(s_acctbal) / sqrt(count(*)) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""
POOL_SQL = """us AS (SELECT grp, v, s * s AS s2 FROM ut WHERE s > 0),
fx AS (SELECT grp, sum(1 / s2) AS w, sum(1 / (s2 * s2)) AS w2, sum(v / s2) / sum(1 / s2) AS mu, count(*) AS k FROM us GROUP BY 1),
qq AS (SELECT grp, any_value(w) AS w, any_value(w2) AS w2, any_value(k) AS k, sum(pow(v - mu, 2) / s2) AS q FROM us JOIN fx USING (grp) GROUP BY 1),
t2 AS (SELECT grp, k, CASE WHEN k > 1 AND w - w2 / w > 0 THEN greatest(0, (q - (k - 1)) / (w - w2 / w)) ELSE 0 END AS tau2 FROM qq),
pool AS (SELECT grp, sum(v / (s2 + tau2)) / sum(1 / (s2 + tau2)) AS mean, 1 / sqrt(sum(1 / (s2 + tau2))) AS sem, any_value(tau2) AS tau2, any_value(k) AS k FROM us JOIN t2 USING (grp) GROUP BY 1)"""


def _units(spark, d) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("grp"), F.col("s_nationkey").alias("unit"), "s_acctbal")
    return rollups.mean_sem(rows, ["grp", "unit"], "s_acctbal").select("grp", "unit", F.col("mean").alias("v"), F.col("sem").alias("s"))


@query("random_effects_pool", "B17", with_ctes(UNIT_SQL, POOL_SQL, select="SELECT grp, round(mean, 6) AS mean, round(sem, 6) AS sem, round(tau2, 3) AS tau2, k FROM pool"))
def random_effects_pool(spark, d):
    out = lags.random_effects_pool(_units(spark, d), ["grp"], "v", "s")
    return rounded(out, "mean", "sem", places=6).withColumn("tau2", F.round("tau2", 3))


@query("bootstrap_means", "B18", with_ctes(HOURLY_SQL, f"""
sg AS (SELECT system, ntile(20) OVER (PARTITION BY system ORDER BY idx) - 1 AS i, x FROM series), un AS (SELECT system, i, avg(x) AS v FROM sg GROUP BY 1, 2),
dw AS (SELECT r.r AS replicate, CAST(floor({uniform_sql('11', 'r.r', 's.s')} * 20) AS BIGINT) AS i, count(*) AS weight FROM range(100) r(r), range(20) s(s) GROUP BY 1, 2),
bs AS (SELECT system, replicate, sum(weight * v) / sum(weight) AS m FROM un JOIN dw USING (i) GROUP BY 1, 2)""", select="""
SELECT system, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sem, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM bs GROUP BY 1"""))
def bootstrap_means(spark, d):
    seg = windows.split_near_equal(hourly_series(spark, d), ["system"], "idx", 20)
    units = seg.groupBy("system", F.col("segment").alias("i")).agg(F.avg("x").alias("v")).withColumn("n", F.lit(20))
    b = lags.bootstrap_means(units, ["system"], "v", 100, seed=11)
    out = b.groupBy("system").agg(F.avg("mean").alias("m"), F.stddev_samp("mean").alias("sem"), F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))
    return rounded(out.withColumnRenamed("m", "mean"), "mean", "sem", "ci_low", "ci_high", places=6)


# Monte-Carlo error of a curvature-corrected value: one row per segment and year.
MC_SQL = CONDITIONS_SQL + """,
pc AS (SELECT condition, temperature_k, avg(value) / 500 AS c_sg, avg(value) / 100000 AS c_dil, count(*) % 50 + 60.0::DOUBLE AS radius, stddev_samp(value) / 20000 AS sd_sg, row_number() OVER (ORDER BY condition, temperature_k) AS id FROM co GROUP BY 1, 2),
dr AS (SELECT condition, temperature_k, r.r AS draw, greatest(c_sg + sd_sg * """ + normal_sql("id", "r.r", "1") + """, 1e-12) AS c_sg, greatest(c_dil + 0.3 * """ + normal_sql("id", "r.r", "2") + """, 0) AS c_dil,
  greatest(radius + 2.0 * """ + normal_sql("id", "r.r", "3") + """, 1e-12) AS radius, greatest(0.4::DOUBLE + 0.02 * """ + normal_sql("id", "r.r", "4") + """, 0) AS gamma FROM pc, range(4000) r(r)),
cx AS (SELECT condition, temperature_k, c_sg, c_dil, 2 * (gamma * 1e-3) * (70.0 / c_sg) / ((radius * 1e-10) * 8.314462618 * temperature_k) AS s FROM dr),
dc AS (SELECT condition, temperature_k, c_dil * exp(-s) AS c_inf, c_sg - c_dil * exp(-s) AS delta_c, (c_sg + c_dil * exp(-s)) / 2 AS c_bar FROM cx)"""
MC_VALUES = ("c_inf", "delta_c", "c_bar")


@query("monte_carlo_errors", "B19", with_ctes(MC_SQL, select="""
SELECT condition, temperature_k, """ + ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(stddev_samp({v}), 6) AS {v}_sd, round(median({v}), 6) AS {v}_median, round(quantile_cont({v}, 0.025), 6) AS {v}_low, round(quantile_cont({v}, 0.975), 6) AS {v}_high" for v in MC_VALUES) + " FROM dc GROUP BY 1, 2"))
def monte_carlo_errors(spark, d):
    from trajstats.functions.scalars import curvature_factor
    cells = condition_orders(spark, d).groupBy("condition", "temperature_k").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    rows = cells.select(
        "condition", "temperature_k", (F.col("m") / 500).alias("c_sg"), (F.col("m") / 100000).alias("c_dil"), (F.col("n") % 50 + 60.0).alias("radius"), (F.col("sd") / 20000).alias("sd_sg"),
        F.row_number().over(W.orderBy("condition", "temperature_k")).alias("id"),
    ).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(3999))))
    sg = lags.truncated_normal(F.col("c_sg"), F.col("sd_sg"), 1e-12, F.col("id"), F.col("draw"), F.lit(1))
    dil = lags.truncated_normal(F.col("c_dil"), F.lit(0.3), 0.0, F.col("id"), F.col("draw"), F.lit(2))
    radius = lags.truncated_normal(F.col("radius"), F.lit(2.0), 1e-12, F.col("id"), F.col("draw"), F.lit(3))
    gamma = lags.truncated_normal(F.lit(0.4), F.lit(0.02), 0.0, F.col("id"), F.col("draw"), F.lit(4))
    draws = rows.select("condition", "temperature_k", radius.alias("radius"), gamma.alias("gamma"), sg.alias("sg"), dil.alias("dil"))
    s = curvature_factor(F.col("gamma"), F.col("radius"), F.lit(70.0) / F.col("sg"), F.col("temperature_k"))
    inf = F.col("dil") * F.exp(-s)
    values = draws.select("condition", "temperature_k", inf.alias("c_inf"), (F.col("sg") - inf).alias("delta_c"), ((F.col("sg") + inf) / 2).alias("c_bar"))
    aggs = [f.alias(f"{v}_{n}") for v in MC_VALUES for n, f in (("mean", F.avg(v)), ("sd", F.stddev_samp(v)), ("median", F.median(v)), ("low", F.percentile(v, 0.025)), ("high", F.percentile(v, 0.975)))]
    out = values.groupBy("condition", "temperature_k").agg(*aggs)
    return rounded(out, *(c for c in out.columns if c not in ("condition", "temperature_k")), places=6)


SLOPES_SQL = """lg AS (SELECT system, lag, msd, ln(lag) AS lx, ln(msd) AS ly FROM cv WHERE lag > 0 AND msd > 0),
sl AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY lag) - 1 AS i, CASE WHEN count(*) OVER w = 4 THEN regr_slope(ly, lx) OVER w END AS slope FROM lg WINDOW w AS (PARTITION BY system ORDER BY lag ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
gd AS (SELECT system, i AS s, i + 4 AS e FROM sl WHERE abs(slope - 1) <= 0.3),
fl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY system ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM gd),
ig AS (SELECT *, sum(nw) OVER (PARTITION BY system ORDER BY s) AS g FROM fl), rn AS (SELECT system, min(s) AS first, max(e) AS last FROM ig GROUP BY system, g),
ins AS (SELECT sl.*, first, i - first AS slot, last - first AS n FROM sl JOIN rn ON rn.system = sl.system AND i >= first AND i < last),
dw AS (SELECT system, first, r.r AS replicate, CAST(floor(""" + uniform_sql("3", "r.r", "slot") + """ * n) AS BIGINT) AS slot, count(*) AS wt FROM ins, range(200) r(r) GROUP BY 1, 2, 3, 4),
ft AS (SELECT system, first, replicate, sum(wt) AS w, sum(wt*lx) AS ax, sum(wt*ly) AS ay, sum(wt*lx*lx) AS axx, sum(wt*lx*ly) AS axy, sum(wt*ly*ly) AS ayy, sum(wt*lag) AS bx, sum(wt*msd) AS by_, sum(wt*lag*lag) AS bxx, sum(wt*lag*msd) AS bxy
  FROM dw JOIN ins USING (system, first, slot) GROUP BY 1, 2, 3),
fs AS (SELECT system, (axy - ax*ay/w) / nullif(axx - ax*ax/w, 0) AS ls, (axy - ax*ay/w) / sqrt((axx - ax*ax/w) * (ayy - ay*ay/w)) AS r, (bxy - bx*by_/w) / nullif(bxx - bx*bx/w, 0) AS sp FROM ft WHERE axx - ax*ax/w > 1e-12)"""


@query("diffusive_slopes", "F5 W6", with_ctes(ROLLED_SQL, SLOPES_SQL, select="""
SELECT system, round(avg(sp) / 6, 6) AS d, round(stddev_samp(sp) / sqrt(count(*)) / 6, 6) AS d_sem, count(*) AS n_slopes FROM fs WHERE abs(r) > 0.9 AND abs(ls - 1) <= 0.3 AND sp > 0 GROUP BY 1"""))
def diffusive_slopes(spark, d):
    out = lags.diffusive_slopes(_curve(spark, d), ["system"], "lag", "msd", 4, 0.3, 200, seed=3)
    return rounded(out, "d", "d_sem", places=6)
