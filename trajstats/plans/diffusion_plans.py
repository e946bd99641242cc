"""Species values of diffusion from the chains that stay in the tracked group, and their combined errors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from trajstats.functions.draws import uniform_sql
from trajstats.operators import groups, lags
from trajstats.plans.lag_plans import COM_SQL, POOL_SQL, _com, _msd, confinement_sql
from trajstats.plans.registry import query
from trajstats.plans.series_plans import rounded
from trajstats.plans.space_plans import CHAIN_SQL, MEMBER_SQL, _chains, _members, comp_sql
from trajstats.session import cut_lineage, small_side

OCCUPANCY = 0.80
#: Curves have 21 lags.
SHORT = {"skip": 0.0, "min_points": 10, "min_plateau": 5, "cv_max": 1.0}
LENGTHS, STRIDE = (12, 16), 2


def _named(sql: str, suffix: str, names: str) -> str:
    """The CTEs ``names`` under other names."""
    return re.sub(rf"\b({names})\b", rf"\1{suffix}", sql)


def _fit_sql(k: str, suffix: str) -> str:
    return _named(confinement_sql(k, "1.0", 0, 10, 5), suffix, "cv|us|sn|pt|pl|lc|fh|cf")


INSIDE_SQL = (MEMBER_SQL, CHAIN_SQL, """
mo AS (SELECT frame, count(*) AS k FROM ch JOIN mb USING (frame, chain_id) WHERE inside GROUP BY 1),
oc AS (SELECT chain_id FROM ch JOIN mb USING (frame, chain_id) JOIN mo USING (frame) WHERE k >= 3 GROUP BY 1 HAVING avg(inside::INT) >= 0.8)""", COM_SQL, """
cvc AS (SELECT species, chain_id, lag, msd FROM ms SEMI JOIN oc USING (chain_id))""")


def _inside(spark, d) -> DataFrame:
    """Chains that spend enough frames in the tracked group."""
    com = _chains(spark, d).join(_members(spark, d).drop("system"), ["frame", "chain_id"])
    return cut_lineage(groups.occupancy_radius(com, [], pos=("cx", "cy", "cz")).filter(F.col("occupancy") >= OCCUPANCY).select("chain_id"))


@query("pooled_confinement", "B31 B27", comp_sql("""
SELECT p.species, round(coalesce(mean, m), 6) AS mean, round(CASE WHEN pool.k IS NULL THEN ss ELSE sem END, 6) AS sem, coalesce(pool.k, p.k) AS k
FROM (SELECT species, avg(d) AS m, stddev_samp(d) / sqrt(count(d)) AS ss, count(d) AS k FROM cfc GROUP BY 1) p LEFT JOIN pool ON pool.grp = p.species""", *INSIDE_SQL, _fit_sql("species, chain_id", "c"), """
ut AS (SELECT species AS grp, d AS v, d_sem AS s FROM cfc)""", _named(POOL_SQL, "u", "us")))
def pooled_confinement(spark, d):
    """Two-stage fits of the curve of each chain inside, pooled by species with random effects."""
    curves = cut_lineage(_msd(spark, d).join(small_side(_inside(spark, d)), "chain_id", "left_semi"))
    fits = cut_lineage(lags.confinement(curves, ["species", "chain_id"], **SHORT))
    return rounded(lags.pooled_confinement(fits, ["species"], "d", "d_sem").drop("tau2"), "mean", "sem", places=6)


@query("combined_error", "B32 P25 B18 B29", comp_sql("""
SELECT species, round(d, 6) AS d, round(analytic, 6) AS analytic, round(bootstrap, 6) AS bootstrap, round(origin, 6) AS origin, round(sqrt(coalesce(CASE WHEN greatest(analytic, bootstrap) > 0 THEN pow(greatest(analytic, bootstrap), 2) END, 0) + coalesce(CASE WHEN origin > 0 THEN origin * origin END, 0)), 6) AS error
FROM (SELECT species, d, d_sem AS analytic FROM cfm) LEFT JOIN (SELECT species, stddev_samp(d) AS bootstrap FROM cfb GROUP BY 1) USING (species) LEFT JOIN og USING (species)""", *INSIDE_SQL, """
cvm AS (SELECT species, lag, avg(msd) AS msd FROM cvc GROUP BY 1, 2)""", _fit_sql("species", "m"), f"""
un AS (SELECT species, chain_id, row_number() OVER (PARTITION BY species ORDER BY chain_id) - 1 AS i, count(*) OVER (PARTITION BY species) AS n FROM (SELECT DISTINCT species, chain_id FROM cvc)),
dw AS (SELECT species, r.r AS replicate, CAST(floor({uniform_sql("17", "r.r", "i")} * n) AS BIGINT) AS i, count(*) AS weight FROM un, range(200) r(r) GROUP BY 1, 2, 3),
cvb AS (SELECT species, replicate, lag, sum(weight * msd) / sum(weight) AS msd FROM dw JOIN un USING (species, i) JOIN cvc USING (species, chain_id) GROUP BY 1, 2, 3)""", _fit_sql("species, replicate", "b"), f"""
wn AS (SELECT v.length, o.o AS origin FROM (VALUES ({LENGTHS[0]}), ({LENGTHS[1]})) v(length), range(0, 21, {STRIDE}) o(o) WHERE o.o + v.length <= 20),
cvo AS (SELECT species, length, origin, lag, avg(msd) AS msd FROM (SELECT a.species, a.chain_id, length, origin, b.frame - a.frame AS lag, avg(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS msd
  FROM wn JOIN cr a ON a.frame >= origin AND a.frame <= origin + length JOIN cr b ON b.chain_id = a.chain_id AND b.frame >= a.frame AND b.frame <= origin + length SEMI JOIN oc ON oc.chain_id = a.chain_id GROUP BY ALL) GROUP BY 1, 2, 3, 4)""", _fit_sql("species, length, origin", "o"), """
os AS (SELECT species, length, count(l) AS n_success, any_value(nt) AS n_total FROM (SELECT DISTINCT species FROM cvc) JOIN (SELECT length, count(*) AS nt FROM wn GROUP BY 1) ON TRUE LEFT JOIN cfo USING (species, length) GROUP BY 1, 2),
ok AS (SELECT species, length FROM os WHERE n_success >= 3 QUALIFY row_number() OVER (PARTITION BY species ORDER BY n_success / n_total >= 0.7 DESC, CASE WHEN n_success / n_total >= 0.7 THEN -length ELSE n_success / n_total END DESC, n_success DESC, length) = 1),
og AS (SELECT species, stddev_samp(d) / sqrt(count(d)) AS origin FROM cfo JOIN ok USING (species, length) GROUP BY 1)"""))
def combined_error(spark, d):
    """D of each species and its error: the fit's own or that of 200 draws of chains, whichever is larger, with that of the time origins."""
    inside = small_side(_inside(spark, d))
    curves = _msd(spark, d).join(inside, "chain_id", "left_semi")
    series = cut_lineage(_com(spark, d).join(inside, "chain_id", "left_semi"))
    out = lags.diffusion_errors(series, curves, ["species"], "chain_id", "frame", ["x", "y", "z"], lengths=LENGTHS, stride=STRIDE, n_boot=200, seed=17, min_rows=10, **SHORT)
    return rounded(out, "d", "analytic", "bootstrap", "origin", "error", places=6)
