"""Grouped fits, coexistence curves, feature ranking, clustering and validation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from trajstats.functions.draws import normal_sql
from trajstats.operators import binodal, features as feat, fits, lags, rollups, separable
from trajstats.plans.lag_plans import COM_SQL, ROLLED_SQL, _curve, _msd, _segments
from trajstats.plans.registry import query
from trajstats.plans.series_plans import rounded
from trajstats.plans.space_plans import CENTRE_SQL, _strip_unused, profile_sql
from trajstats.plans.views import CONDITIONS_SQL, FRAMES_SQL, condition_orders, table, with_ctes
from trajstats.session import cut_lineage, spread

# --- coexistence curves: segments as conditions, years as temperatures ------------------

# The dense branch falls toward a critical point; noise comes from the segment means.
BRANCH_SQL = CONDITIONS_SQL + """,
br0 AS (SELECT condition, temperature_k::DOUBLE AS temperature_k, avg(value) / 250000 AS f, stddev_samp(value) / sqrt(count(*)) / 250000 AS e FROM co GROUP BY 1, 2),
br AS (SELECT condition, temperature_k, f * (300 + 2 * (345 - temperature_k) + 60 * pow(345 - temperature_k, 0.325::DOUBLE)) AS c_sg, f * (300 + 2 * (345 - temperature_k) - 60 * pow(345 - temperature_k, 0.325::DOUBLE)) AS c_dil_inf, e * 400 AS c_sg_sd, e * 300 AS c_dil_inf_sd FROM br0)"""


def _branches(spark, d) -> DataFrame:
    cells = condition_orders(spark, d).groupBy("condition", F.col("temperature_k").cast("double").alias("temperature_k")).agg(
        (F.avg("value") / 250000).alias("f"), (F.stddev_samp("value") / F.sqrt(F.count("value")) / 250000).alias("e"))
    x = 345 - F.col("temperature_k")
    bar, half = 300 + 2 * x, 60 * F.pow(x, F.lit(0.325))
    return cells.select("condition", "temperature_k", (F.col("f") * (bar + half)).alias("c_sg"), (F.col("f") * (bar - half)).alias("c_dil_inf"), (F.col("e") * 400).alias("c_sg_sd"), (F.col("e") * 300).alias("c_dil_inf_sd"))


def binodal_sql(src: str, k: str, fixed_cc: str = "", fixed_b: str = "", bound: str = "100.0", tag: str = "") -> str:
    """Grid search over Tc with closed-form linear parameters, three levels, as CTE text."""
    sig = "pow(greatest(CASE WHEN {s} > 0 THEN {s} ELSE 0.05::DOUBLE * greatest(abs({v}), 1e-6) END, 0.05::DOUBLE * greatest(abs({v}), 1e-6)), -2)"
    shift = (fixed_cc or "0.0::DOUBLE") + (f" + {fixed_b} * dl" if fixed_b else "")
    out = [f"""b{tag}0 AS MATERIALIZED (SELECT s.*, top, {sig.format(s='c_sg_sd', v='c_sg')} AS w1, {sig.format(s='c_dil_inf_sd', v='c_dil_inf')} AS w2, top + 0.1::DOUBLE AS lo, ({bound} - 0.1::DOUBLE) / 160 AS step
  FROM {src} s JOIN (SELECT {k}, max(temperature_k) AS top FROM {src} GROUP BY ALL HAVING count(*) >= 3) USING ({k}))"""]
    for level in range(3):
        if not fixed_cc and not fixed_b:
            solve = """m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det, m11 * m22 - m12 * m12 AS det0,
  v1 * (m22 * m33 - m23 * m23) - m12 * (v2 * m33 - m23 * v3) + m13 * (v2 * m23 - m22 * v3) AS n1, m11 * (v2 * m33 - m23 * v3) - v1 * (m12 * m33 - m23 * m13) + m13 * (m12 * v3 - v2 * m13) AS n2,
  m11 * (m22 * v3 - v2 * m23) - m12 * (m12 * v3 - v2 * m13) + v1 * (m12 * m23 - m22 * m13) AS n3"""
            params = "CASE WHEN n3 / det > 0 THEN n1 / det ELSE (v1 * m22 - m12 * v2) / det0 END AS cc, CASE WHEN n3 / det > 0 THEN n2 / det ELSE (m11 * v2 - m12 * v1) / det0 END AS bb, greatest(n3 / det, 0) AS aa"
        elif not fixed_cc:
            solve = "m11 * m33 - m13 * m13 AS det, v1 * m33 - m13 * v3 AS n1, m11 * v3 - m13 * v1 AS n3"
            params = "CASE WHEN n3 / det > 0 THEN n1 / det ELSE v1 / m11 END AS cc, 0.0::DOUBLE AS bb, greatest(n3 / det, 0) AS aa"
        else:
            solve = "m33 AS det, v3 AS n3"
            params = "0.0::DOUBLE AS cc, 0.0::DOUBLE AS bb, greatest(n3 / det, 0) AS aa"
        out.append(f"""g{tag}{level} AS (SELECT *, lo + g.g * step AS tc, greatest(lo + g.g * step - temperature_k, 1e-12) AS dl FROM b{tag}{level}, range(161) g(g)),
h{tag}{level} AS (SELECT *, pow(dl, 0.325::DOUBLE) / 2 AS q, c_sg - ({shift}) AS y1, c_dil_inf - ({shift}) AS y2 FROM g{tag}{level}),
m{tag}{level} AS (SELECT {k}, tc, count(*) AS n, sum(w1 + w2) AS m11, sum((w1 + w2) * dl) AS m12, sum((w1 + w2) * dl * dl) AS m22, sum((w1 - w2) * q) AS m13, sum((w1 - w2) * dl * q) AS m23, sum((w1 + w2) * q * q) AS m33,
  sum(w1 * y1 + w2 * y2) AS v1, sum((w1 * y1 + w2 * y2) * dl) AS v2, sum((w1 * y1 - w2 * y2) * q) AS v3, sum(w1 * y1 * y1 + w2 * y2 * y2) AS yy FROM h{tag}{level} GROUP BY {k}, tc),
s{tag}{level} AS (SELECT *, {solve} FROM m{tag}{level}), p{tag}{level} AS (SELECT *, {params} FROM s{tag}{level}),
e{tag}{level} AS (SELECT *, greatest(yy - 2 * (cc * v1 + bb * v2 + aa * v3) + cc * cc * m11 + bb * bb * m22 + aa * aa * m33 + 2 * (cc * bb * m12 + cc * aa * m13 + bb * aa * m23), 0) AS sse FROM p{tag}{level}),
f{tag}{level} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY sse, tc) AS rn FROM e{tag}{level}) WHERE rn = 1)""")
        if level < 2:
            out.append(f"""b{tag}{level + 1} AS MATERIALIZED (SELECT b.* REPLACE (greatest(f.tc - b.step, top + 0.1::DOUBLE) AS lo, (least(f.tc + b.step, top + {'b.' + bound if bound.isalpha() else bound}) - greatest(f.tc - b.step, top + 0.1::DOUBLE)) / 160 AS step)
  FROM b{tag}{level} b JOIN f{tag}{level} f ON {' AND '.join(f'f.{c.strip()} = b.{c.strip()}' for c in k.split(','))})""")
    return ",\n".join(out)


@query("binodal_fit", "F6 F10", with_ctes(BRANCH_SQL, binodal_sql("br", "condition"), select="""
SELECT condition, round(tc, 2) AS tc, round(cc, 1) AS c_c, round(aa, 1) AS a, round(bb, 2) AS b, round(sqrt(sse / (2 * n)), 4) AS rmse, n AS n_points FROM f2"""))
def binodal_fit(spark, d):
    out = binodal.binodal_fit(_branches(spark, d), ["condition"])
    return out.select("condition", F.round("tc", 2).alias("tc"), F.round("c_c", 1).alias("c_c"), F.round("a", 1).alias("a"), F.round("b", 2).alias("b"), F.round("rmse", 4).alias("rmse"), "n_points")


CONTROL_SQL = binodal_sql("brc", "condition", tag="c")
CONTROLLED_SQL = BRANCH_SQL + ", brc AS (SELECT * FROM br WHERE condition = 'BUILDING'),\n" + CONTROL_SQL + ",\nbrf AS (SELECT br.*, f.cc AS fcc, f.bb AS fb FROM br, fc2 f WHERE br.condition <> 'BUILDING')"


def _with_control(spark, d) -> DataFrame:
    rows = _branches(spark, d)
    control = binodal.binodal_fit(rows.filter("condition = 'BUILDING'"), ["condition"]).select(F.col("c_c").alias("fcc"), F.col("b").alias("fb"))
    return rows.filter("condition <> 'BUILDING'").crossJoin(F.broadcast(control))


@query("binodal_fit_fixed_slope", "F7", with_ctes(CONTROLLED_SQL, binodal_sql("brf", "condition", fixed_b="fb", tag="k"), select="""
SELECT condition, round(tc, 2) AS tc, round(cc, 1) AS c_c, round(aa, 1) AS a, round(sqrt(sse / (2 * n)), 4) AS rmse FROM fk2"""))
def binodal_fit_fixed_slope(spark, d):
    out = binodal.binodal_fit(_with_control(spark, d), ["condition"], b="fb")
    return out.select("condition", F.round("tc", 2).alias("tc"), F.round("c_c", 1).alias("c_c"), F.round("a", 1).alias("a"), F.round("rmse", 4).alias("rmse"))


@query("binodal_fit_fixed_diameter", "F7", with_ctes(CONTROLLED_SQL, binodal_sql("brf", "condition", fixed_cc="fcc", fixed_b="fb", tag="k"), select="""
SELECT condition, round(tc, 2) AS tc, round(aa, 1) AS a, round(sqrt(sse / (2 * n)), 4) AS rmse FROM fk2"""))
def binodal_fit_fixed_diameter(spark, d):
    out = binodal.binodal_fit(_with_control(spark, d), ["condition"], c_c="fcc", b="fb")
    return out.select("condition", F.round("tc", 2).alias("tc"), F.round("a", 1).alias("a"), F.round("rmse", 4).alias("rmse"))


def _sigma_sql(v: str, s: str) -> str:
    least = f"0.05::DOUBLE * greatest(abs({v}), 1e-6)"
    return f"greatest(CASE WHEN {s} > 0 THEN {s} ELSE {least} END, {least})"


TWO_STEP_SQL = BRANCH_SQL + """,
bd AS (SELECT *, sqrt(pow(coalesce(c_sg_sd, 0), 2) + pow(coalesce(c_dil_inf_sd, 0), 2)) AS sd, (c_sg + c_dil_inf) / 2 AS mid FROM br),
hf AS (SELECT condition, temperature_k, (c_sg - c_dil_inf) / 2 AS c_sg, -(c_sg - c_dil_inf) / 2 AS c_dil_inf, sd / 2 AS c_sg_sd, sd / 2 AS c_dil_inf_sd, 0.0::DOUBLE AS zero FROM bd),
""" + binodal_sql("hf", "condition", fixed_cc="zero", fixed_b="zero", tag="t") + f""",
dm AS (SELECT condition, tc, aa, f.n, greatest(tc - temperature_k, 0) AS x, mid, pow({_sigma_sql('mid', 'sd / 2')}, -2) AS w FROM bd JOIN ft2 f USING (condition)),
ds AS (SELECT condition, tc, aa, n, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * mid) AS sy, sum(w * x * mid) AS sxy FROM dm GROUP BY 1, 2, 3, 4)"""


@query("binodal_two_step", "F7", with_ctes(TWO_STEP_SQL, select="""
SELECT condition, round(tc, 2) AS tc, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 1) AS c_c, round(aa, 1) AS a, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 2) AS b, n AS n_points FROM ds"""))
def binodal_two_step(spark, d):
    out = binodal.two_step_fit(_branches(spark, d), ["condition"])
    return out.select("condition", F.round("tc", 2).alias("tc"), F.round("c_c", 1).alias("c_c"), F.round("a", 1).alias("a"), F.round("b", 2).alias("b"), "n_points")


def _reweighted_sql(fit: str, into: str) -> str:
    """Rows with errors widened where they lie beyond one sigma of a fit."""
    s1, s2 = _sigma_sql("c_sg", "c_sg_sd"), _sigma_sql("c_dil_inf", "c_dil_inf_sd")
    delta = "greatest(tc - temperature_k, 1e-12)"
    dense, dilute = (f"cc + bb * {delta} {sign} aa * pow({delta}, 0.325::DOUBLE) / 2" for sign in "+-")
    return f"""{into} AS (SELECT condition, temperature_k, c_sg, c_dil_inf, {s1} * sqrt(greatest(abs(c_sg - ({dense})) / {s1}, 1.0)) AS c_sg_sd, {s2} * sqrt(greatest(abs(c_dil_inf - ({dilute})) / {s2}, 1.0)) AS c_dil_inf_sd
  FROM br JOIN {fit} USING (condition))"""


ROBUST_SQL = ",\n".join([BRANCH_SQL, binodal_sql("br", "condition", tag="ra"), _reweighted_sql("fra2", "r1"), binodal_sql("r1", "condition", tag="rb"), _reweighted_sql("frb2", "r2"), binodal_sql("r2", "condition", tag="rc"), _reweighted_sql("frc2", "r3"), binodal_sql("r3", "condition", tag="rd")])


@query("binodal_robust", "F6", with_ctes(ROBUST_SQL, select="""
SELECT condition, round(tc, 1) AS tc, round(cc, 0) AS c_c, round(aa, 0) AS a, round(bb, 1) AS b, n AS n_points FROM frd2"""))
def binodal_robust(spark, d):
    out = binodal.robust_binodal_fit(_branches(spark, d), ["condition"])
    return out.select("condition", F.round("tc", 1).alias("tc"), F.round("c_c", 0).alias("c_c"), F.round("a", 0).alias("a"), F.round("b", 1).alias("b"), "n_points")


def _resampled(spark, d, n: int) -> DataFrame:
    rows = _branches(spark, d).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("temperature_k").cast("long")
    return rows.withColumn("c_sg", lags.truncated_normal(F.col("c_sg"), F.col("c_sg_sd"), 1e-12, F.col("replicate"), t, F.lit(1))).withColumn(
        "c_dil_inf", lags.truncated_normal(F.col("c_dil_inf"), F.col("c_dil_inf_sd"), 0.0, F.col("replicate"), t, F.lit(2)))


RESAMPLE_SQL = BRANCH_SQL + f""",
rs AS (SELECT condition, replicate, temperature_k, greatest(CASE WHEN c_sg_sd > 0 THEN c_sg + c_sg_sd * {normal_sql('replicate', 'temperature_k', '1')} ELSE c_sg END, 1e-12) AS c_sg,
  greatest(CASE WHEN c_dil_inf_sd > 0 THEN c_dil_inf + c_dil_inf_sd * {normal_sql('replicate', 'temperature_k', '2')} ELSE c_dil_inf END, 0) AS c_dil_inf, c_sg_sd, c_dil_inf_sd FROM br, range(500) r(replicate))"""


@query("binodal_resample", "F8 B19", with_ctes(RESAMPLE_SQL, binodal_sql("rs", "condition, replicate", tag="q"), select="""
SELECT condition, count(*) AS n_success, round(median(tc), 1) AS tc_median, round(median(aa), 0) AS a_median FROM fq2 GROUP BY 1"""))
def binodal_resample(spark, d):
    out = binodal.resample_summary(binodal.binodal_fit(_resampled(spark, d, 500), ["condition", "replicate"]), ["condition"])
    return out.select("condition", "n_success", F.round("tc_median", 1).alias("tc_median"), F.round("a_median", 0).alias("a_median"))


@query("binodal_bounds", "F9", with_ctes(BRANCH_SQL, "bb AS (SELECT br.*, bound FROM br, (VALUES (50.0::DOUBLE), (100.0), (400.0)) v(bound))", binodal_sql("bb", "condition, bound", bound="bound", tag="x"), """
wd AS (SELECT condition, max(tc) FILTER (bound = 400) - max(tc) FILTER (bound = 100) AS shift FROM fx2 GROUP BY 1)""", select="""
SELECT condition, round(max(tc) FILTER (bound = 50), 1) AS tc_50, round(max(tc) FILTER (bound = 100), 1) AS tc_100, any_value(abs(shift)) > 5 AS disagree FROM fx2 JOIN wd USING (condition) GROUP BY 1"""))
def binodal_bounds(spark, d):
    rows = _branches(spark, d).withColumn("bound", F.explode(F.array(F.lit(50.0), F.lit(100.0), F.lit(400.0))))
    fit = binodal.binodal_fit(rows, ["condition", "bound"], bound="bound")
    at = lambda b: F.max(F.when(F.col("bound") == b, F.col("tc")))
    return fit.groupBy("condition").agg(F.round(at(50.0), 1).alias("tc_50"), F.round(at(100.0), 1).alias("tc_100"), (F.abs(at(400.0) - at(100.0)) > 5).alias("disagree"))


@query("binodal_curve", "F11", with_ctes(BRANCH_SQL, binodal_sql("br", "condition"), """
cv AS (SELECT condition, k.k AS k, 290 + (tc - 290) * k.k / 24 AS t, tc, cc, aa, bb FROM f2, range(25) k(k))""", select="""
SELECT condition, CAST(k AS INTEGER) AS k, round(cc + bb * greatest(tc - t, 1e-12), 0) AS c_bar FROM cv"""))
def binodal_curve(spark, d):
    fit = binodal.binodal_fit(_branches(spark, d), ["condition"])
    return binodal.curve_table(fit, ["condition"], F.lit(290.0), 25).select("condition", "k", F.round("c_bar", 0).alias("c_bar"))


SCALE_SQL = BRANCH_SQL + """,
ms AS (SELECT condition, scale, temperature_k, c_sg, c_dil_inf * exp(-(2.0::DOUBLE * (0.3::DOUBLE * 1e-3) * (50.0::DOUBLE * scale / c_sg) / ((80.0::DOUBLE * 1e-10) * 8.314462618 * temperature_k))) AS c_dil_inf, c_sg_sd, c_dil_inf_sd FROM br, (VALUES (0.5::DOUBLE), (1.0), (2.0)) v(scale))"""


@query("mass_scale_sensitivity", "F12 P17", with_ctes(SCALE_SQL, binodal_sql("ms", "condition, scale", tag="m"), select="""
SELECT condition, scale, round(tc, 2) AS tc, round(cc, 1) AS c_c, round(aa, 1) AS a, round(bb, 2) AS b, round(sqrt(sse / (2 * n)), 4) AS rmse, n AS n_points FROM fm2"""))
def mass_scale_sensitivity(spark, d):
    from trajstats.functions.scalars import curvature_factor
    rows = _branches(spark, d).withColumn("scale", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    s = curvature_factor(F.lit(0.3), F.lit(80.0), F.lit(50.0) * F.col("scale") / F.col("c_sg"), F.col("temperature_k"))
    out = binodal.binodal_fit(rows.withColumn("c_dil_inf", F.col("c_dil_inf") * F.exp(-s)), ["condition", "scale"])
    return out.select("condition", "scale", F.round("tc", 2).alias("tc"), F.round("c_c", 1).alias("c_c"), F.round("a", 1).alias("a"), F.round("b", 2).alias("b"), F.round("rmse", 4).alias("rmse"), "n_points")


# --- grouped fits ----------------------------------------------------------------------

def _density(spark, d) -> DataFrame:
    from trajstats.operators import histograms as hist
    from trajstats.plans.views import frames
    fr = frames(spark, d)
    r = hist.distance_from_centre(fr, hist.centre_of_mass(fr, ["frame", "species"]), ["frame", "species"], ("xu", "yu", "zu"))
    return hist.radial_profile(r, ["species"], "frame", "r", "mass", 10.0, 40, factor=1660.5390666)


def _interface_sql(positive: str, normalised: bool) -> str:
    """Profile rows, both kinds of fit and the choice between them, as CTEs."""
    scale = "CASE WHEN max(abs(y)) > 0 THEN max(abs(y)) ELSE 1.0::DOUBLE END" if normalised else "1.0::DOUBLE"
    return f"""pr AS (SELECT species, r_mid AS x, density AS y, sem AS s FROM prof WHERE density IS NOT NULL QUALIFY r_mid > min(r_mid) OVER (PARTITION BY species)),
ab AS (SELECT species, count(*) AS n_, min(x) AS a_, max(x) AS b_, {scale} AS sc, {"FALSE" if normalised else "count(*) FILTER (s > 0) = count(*)"} AS weighted, greatest(1e-3::DOUBLE * coalesce(max(s), 0), 1e-3::DOUBLE * max(abs(y))) AS fl FROM pr GROUP BY 1),
ro AS (SELECT species, kind, x, y / sc AS y, CASE WHEN kind = 'bounded' AND weighted THEN pow(greatest(s, fl), -2) ELSE 1.0::DOUBLE END AS w FROM pr JOIN ab USING (species), (VALUES ('bounded'), ('unweighted')) k(kind) WHERE n_ >= 5),
dm AS (SELECT species, kind, kind = 'bounded' AND {positive} AS _positive, a_ AS _lo_r_fit, b_ AS _hi_r_fit, ln((b_ - a_) / (4 * n_)) AS _lo_w_fit, ln(2 * (b_ - a_)) AS _hi_w_fit FROM ab, (VALUES ('bounded'), ('unweighted')) k(kind) WHERE n_ >= 5),
{separable.separable_sql("ro", "dm", "species, kind", separable.INTERFACE, "t")},
er AS (SELECT species, kind, a, b, r_fit, w_fit, sqrt(greatest(c11 * u, 0)) AS se_a, sqrt(greatest(c00 * u, 0)) AS se_b, sqrt(greatest(c22 * u, 0)) AS se_r, sqrt(greatest(c33 * u, 0)) AS se_w, c01 * u AS cov_ab, sqrt(plain / n) AS rmse FROM (SELECT *, sse / greatest(n - 4, 1) AS u FROM tfit)),
bs AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY species ORDER BY CASE WHEN kind = 'unweighted' AND se_a IS NOT NULL AND se_b IS NOT NULL AND se_r IS NOT NULL AND se_w IS NOT NULL THEN 2 WHEN kind = 'bounded' THEN 1 ELSE 0 END DESC) = 1),
fin AS (SELECT ab.species, bs.* EXCLUDE (species), CASE WHEN n_ < 5 THEN 'too_few_points' WHEN kind IS NULL THEN 'failed' WHEN kind = 'bounded' AND weighted THEN 'weighted' ELSE kind END AS status FROM ab LEFT JOIN bs USING (species))"""


def _digits(c: str) -> str:
    """Six significant digits, which both engines can agree on."""
    return f"CASE WHEN {c} = 0 THEN 0.0E0 ELSE round({c} / pow(10.0E0, floor(log10(abs({c})))), 5) * pow(10.0E0, floor(log10(abs({c})))) END AS {c}"


_INTERFACE = ["a", "b", "r_fit", "w_fit", "se_a", "se_b", "se_r", "se_w", "cov_ab", "rmse"]
DENSITY_SQL = (FRAMES_SQL, CENTRE_SQL, """
rr AS (SELECT frame, species, mass, sqrt(pow(xu - cx, 2) + pow(yu - cy, 2) + pow(zu - cz, 2)) AS r FROM fr JOIN ce USING (frame, species))""", _strip_unused(profile_sql("rr", "species", "mass", 10.0, 40, "1660.5390666::DOUBLE")))


@query("interface_fit", "F1", with_ctes(*DENSITY_SQL, _interface_sql("TRUE", False), select=f"SELECT species, {', '.join(map(_digits, _INTERFACE))}, status FROM fin"))
def interface_fit(spark, d):
    return fits.interface_fit(_density(spark, d), ["species"]).selectExpr("species", *map(_digits, _INTERFACE), "status")


@query("interface_fit_adaptive", "F2", with_ctes(*DENSITY_SQL, _interface_sql("FALSE", True), select=f"SELECT species, {', '.join(map(_digits, _INTERFACE))}, status FROM fin"))
def interface_fit_adaptive(spark, d):
    return fits.interface_fit(_density(spark, d), ["species"], start="data", normalised=True).selectExpr("species", *map(_digits, _INTERFACE), "status")


def _confined_sql(k: str, rows: str, min_points: int, r2_min: str) -> str:
    """Fits of the CTE ``rows`` (keys, lag, msd), as the CTE ``cfit``."""
    return f"""cro AS (SELECT {k}, lag::DOUBLE AS x, msd AS y, 1.0::DOUBLE AS w FROM {rows} WHERE lag > 0 AND msd > 0),
ab AS (SELECT {k}, count(*) AS n_, max(x) AS b_, var_pop(y) * count(*) AS ss FROM cro GROUP BY {k}),
dm AS (SELECT {k}, TRUE AS _positive, 0.0::DOUBLE AS _lo_tau, ln(greatest(5 * b_, 2.0::DOUBLE)) AS _hi_tau FROM ab WHERE n_ >= {min_points}),
{separable.separable_sql("cro", "dm", k, separable.CONFINED, "t")},
st AS (SELECT ks.*, f.* EXCLUDE ({k}), 1 - sse / greatest(ss, 1e-300) AS r2, sse / greatest(n - 2, 1) AS u, CASE WHEN coalesce(n_, 0) < {min_points} THEN 'too_few_points' WHEN coalesce(l2, 0) <= 0 THEN 'failed' WHEN 1 - sse / greatest(ss, 1e-300) < {r2_min} THEN 'poor_fit' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT {k} FROM {rows}) ks LEFT JOIN ab USING ({k}) LEFT JOIN tfit f USING ({k})),
cfit AS (SELECT {k}, CASE WHEN status = 'ok' THEN sqrt(l2) END AS l, CASE WHEN status = 'ok' THEN sqrt(greatest(c00 * u, 0)) / (2 * sqrt(l2)) END AS l_sem, CASE WHEN status = 'ok' THEN tau END AS tau, CASE WHEN status = 'ok' THEN sqrt(greatest(c11 * u, 0)) END AS tau_sem,
  CASE WHEN status IN ('ok', 'poor_fit') THEN r2 END AS r2, status FROM st)"""


_CONFINED = ["l", "l_sem", "tau", "tau_sem", "r2"]


@query("confined_fit", "F3", with_ctes(ROLLED_SQL, _confined_sql("system", "cv", 15, "0.0"), select=f"SELECT system, {', '.join(map(_digits, _CONFINED))}, status FROM cfit"))
def confined_fit(spark, d):
    return fits.confined_fit(_curve(spark, d), ["system"], skip=0.0, r2_min=0.0).selectExpr("system", *map(_digits, _CONFINED), "status")


_SUMMARY = ["l_mean", "l_median", "tau_mean", "tau_median"]


@query("per_chain_confinement", "B30 F3", with_ctes(FRAMES_SQL, COM_SQL, _confined_sql("species, chain_id", "ms", 10, "-1e9"), select=f"""
SELECT species, n_fit, n_chains, {', '.join(map(_digits, _SUMMARY))} FROM (SELECT species, count(l) AS n_fit, count(*) AS n_chains, CASE WHEN count(l) >= 5 THEN avg(l) END AS l_mean, CASE WHEN count(l) >= 5 THEN median(l) END AS l_median,
  CASE WHEN count(l) >= 5 THEN avg(tau) END AS tau_mean, CASE WHEN count(l) >= 5 THEN median(tau) END AS tau_median FROM cfit GROUP BY 1)"""))
def per_chain_confinement(spark, d):
    per_chain = fits.confined_fit(_msd(spark, d), ["species", "chain_id"], skip=0.0, r2_min=-1e9, min_points=10)
    return fits.per_chain_summary(per_chain, ["species"]).selectExpr("species", "n_fit", "n_chains", *map(_digits, _SUMMARY))


@query("maxwell_fit", "F4")
def maxwell_fit(spark, d):
    """No SQL (an active-set loop); a test holds the loop against all subsets."""
    acf = lags.stress_correlation(_segments(spark, d), ["system"])
    return fits.maxwell_fit(acf, ["system", "segment"], points=1000, max_modes=10)


# --- features --------------------------------------------------------------------------

DOC_FEATURES = ["n_chars", "n_lines", "digit_share", "upper_share", "space_share"]
DOC_SQL = """df AS (SELECT d.doc_id, quality AS label, n_chars::DOUBLE AS n_chars, (len(text) - len(replace(text, chr(10), '')))::DOUBLE AS n_lines, len(regexp_replace(text, '[^0-9]', '', 'g')) / len(text) AS digit_share,
  len(regexp_replace(text, '[^A-Z]', '', 'g')) / len(text) AS upper_share, (len(text) - len(replace(text, ' ', ''))) / len(text) AS space_share FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _documents(spark, d, labelled: bool = True) -> DataFrame:
    """Features of the documents: of the labelled ones with their label, or of all of them."""
    n, none = F.length("text"), F.lit("")
    share = lambda count: F.when(n == 0, F.lit(math.nan)).otherwise(count / n)
    # Before the join, which then moves numbers and not texts. Shares of an empty text are NaN, as in SQL.
    doc = spread(table(spark, d, "documents")).select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), (n - F.length(F.replace("text", F.lit("\n"), none))).cast("double").alias("n_lines"),
        share(F.length(F.regexp_replace("text", "[^0-9]+", ""))).alias("digit_share"), share(F.length(F.regexp_replace("text", "[^A-Z]+", ""))).alias("upper_share"),
        share(n - F.length(F.replace("text", F.lit(" "), none))).alias("space_share"))
    rows = doc.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id") if labelled else doc.withColumn("label", F.lit(None).cast("int"))
    return rows.select("doc_id", "label", *DOC_FEATURES)


@query("feature_ranking", "L1 W12", with_ctes(DOC_SQL, "un AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, label FROM df" for f in DOC_FEATURES) + "), sc AS (SELECT feature, coalesce(CASE WHEN stddev_pop(x) < 1e-9 THEN 0 ELSE abs(corr(x, label)) END, 0) AS r FROM un GROUP BY 1)", select="""
SELECT feature, round(r, 8) AS r, CAST(row_number() OVER (ORDER BY round(r, 12) DESC, feature) AS INTEGER) AS rank FROM sc"""))
def feature_ranking(spark, d):
    return rounded(feat.ranked_features(_documents(spark, d), DOC_FEATURES, "label"), "r")


ALL_DOCS_SQL = DOC_SQL.replace(" FROM documents d JOIN labels l ON l.doc_id = d.doc_id)", " FROM documents d)").replace("quality AS label, ", "NULL AS label, ")
STD_SQL = "zs AS (SELECT doc_id, label, " + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" for f in DOC_FEATURES) + " FROM df)"


@query("standardised_features", "L2", with_ctes(ALL_DOCS_SQL, STD_SQL, select="SELECT doc_id, " + ", ".join(f"round({f}, 8) AS {f}" for f in DOC_FEATURES) + " FROM zs"))
def standardised_features(spark, d):
    out = feat.standardised(_documents(spark, d, False), DOC_FEATURES)
    return rounded(out.select("doc_id", *DOC_FEATURES), *DOC_FEATURES)


@query("cluster_two", "L2")
def cluster_two(spark, d):
    return feat.cluster_two(_documents(spark, d, False), DOC_FEATURES, seeds=tuple(range(20))).select("doc_id", "cluster", "pc1", "pc2")


@query("threshold_confusion", "L3", with_ctes(DOC_SQL, "cf AS (SELECT label, CASE WHEN upper_share > 0.02 THEN 1 ELSE 0 END AS c FROM df)", """
ct AS (SELECT count(*) AS n, count(*) FILTER (label = c) AS same, count(*) FILTER (label = 0 AND c = 0) AS a, count(*) FILTER (label = 0 AND c = 1) AS b, count(*) FILTER (label = 1 AND c = 0) AS cc, count(*) FILTER (label = 1 AND c = 1) AS dd FROM cf),
rs AS (SELECT n, n - same > same AS fl, CASE WHEN n - same > same THEN cc ELSE dd END AS tp, CASE WHEN n - same > same THEN b ELSE a END AS tn, CASE WHEN n - same > same THEN a ELSE b END AS fp, CASE WHEN n - same > same THEN dd ELSE cc END AS fn FROM ct)""", select="""
SELECT n, fl AS flipped, tp, tn, fp, fn, round((tp + tn) / n, 8) AS accuracy, round(tp / (tp + fn), 8) AS recall_1, round(tn / (tn + fp), 8) AS recall_0, round(fp / (tn + fp), 8) AS fp_rate, round(fn / (tp + fn), 8) AS fn_rate, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) AS balanced_accuracy FROM rs"""))
def threshold_confusion(spark, d):
    rows = _documents(spark, d).withColumn("cluster", (F.col("upper_share") > 0.02).cast("int"))
    return rounded(feat.confusion(rows, []), "accuracy", "recall_1", "recall_0", "fp_rate", "fn_rate", "balanced_accuracy")


@query("silhouette", "L4", with_ctes(DOC_SQL, STD_SQL, """
ds AS (SELECT a.doc_id, a.label AS own, b.label AS oth, sum(sqrt(""" + " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in DOC_FEATURES) + """)) AS t, count(*) AS n FROM zs a JOIN zs b ON true GROUP BY 1, 2, 3),
ab AS (SELECT doc_id, own, max(t / (n - 1)) FILTER (own = oth AND n > 1) AS a, min(t / n) FILTER (own <> oth) AS b FROM ds GROUP BY 1, 2)""", select="SELECT doc_id, own AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 8) AS s FROM ab"))
def silhouette(spark, d):
    # Written once, so that the texts are read and counted once for the means and the rows.
    z = feat.standardised(cut_lineage(_documents(spark, d)), DOC_FEATURES)
    return rounded(feat.silhouette(z, "doc_id", DOC_FEATURES, "label"), "s")


@query("loadings", "L11")
def loadings(spark, d):
    table_, spectrum = feat.loadings(_documents(spark, d, False), DOC_FEATURES)
    return table_.join(spectrum, "component")


@query("forward_regression", "L12")
def forward_regression(spark, d):
    return feat.forward_regression(_documents(spark, d, False), DOC_FEATURES[1:], "n_chars", "doc_id", max_features=4, trees=100)


# Nations as units: a small table reduced from customers, orders and line items.
UNIT_FEATURES = ["balance", "price", "orders_per_customer", "late_share", "large_share"]


def _nations(spark, d) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    per_customer = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.year("o_orderdate") > 1998, 1)).alias("late"), F.count(F.when(F.col("o_totalprice") > 300000, 1)).alias("large"))
    n = c.join(per_customer, c.c_custkey == per_customer.o_custkey).groupBy(F.col("c_nationkey").alias("unit")).agg(
        F.avg("c_acctbal").alias("balance"), (F.sum("total") / F.sum("n")).alias("price"), F.avg("n").alias("orders_per_customer"), (F.sum("late") / F.sum("n")).alias("late_share"), (F.sum("large") / F.sum("n")).alias("large_share"))
    return n.withColumn("label", (F.col("unit") % 2).cast("int"))


@query("prefix_sweep", "L5 W12")
def prefix_sweep(spark, d):
    return feat.prefix_sweep(_nations(spark, d), UNIT_FEATURES, "label", "unit")


@query("transfer_matrix", "L6")
def transfer_matrix(spark, d):
    units = _nations(spark, d).withColumn("half", F.when(F.col("unit") < 12, "low").otherwise("high"))
    return feat.transfer_matrix(units, "half", ["low", "high"], UNIT_FEATURES, "label", "unit")


@query("leave_one_out", "L7")
def leave_one_out(spark, d):
    return feat.leave_one_out(_nations(spark, d), UNIT_FEATURES, "label", "unit", n_seeds=20)


@query("leave_one_out_reselected", "L8")
def leave_one_out_reselected(spark, d):
    return feat.leave_one_out(_nations(spark, d), UNIT_FEATURES, "label", "unit", n_seeds=20, reselect=4)


@query("permutation_null", "L9")
def permutation_null(spark, d):
    return feat.permutation_p_value(feat.permutation_null(_nations(spark, d), UNIT_FEATURES, "label", "unit", 200))


@query("seed_sweep", "L10")
def seed_sweep(spark, d):
    acc = feat.seed_sweep(_nations(spark, d), UNIT_FEATURES, "label", "unit", 100)
    return acc.agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sd"), F.min("accuracy").alias("min"), F.max("accuracy").alias("max"), F.median("accuracy").alias("median"))
