"""SQL pieces that repeat the block statistics for the check queries.

Every function returns CTE text; ``k`` is the comma-separated list of key columns.
"""

from __future__ import annotations

from trajstats.functions.stats import t_multiplier_sql


def pos_sql(src: str, k: str, order: str = "idx") -> str:
    return f"""pos AS (SELECT {k}, {order} AS idx, value, row_number() OVER (PARTITION BY {k} ORDER BY {order}) - 1 AS i,
  CAST(count(*) OVER (PARTITION BY {k}) AS INTEGER) AS n FROM {src})"""


def win_sql(k: str) -> str:
    return f"""wq AS (SELECT {k}, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM pos GROUP BY {k}),
win AS (SELECT {k}, idx, i, n, CASE WHEN n >= 3 THEN greatest(least(value, hi), lo) ELSE value END AS value FROM pos JOIN wq USING ({k}))"""


def offsets_sql(src: str, k: str, b_range: str = "range(1, 10) r(b)", size_filter: str = "r.b <= n", min_blocks: int = 4) -> str:
    return f"""bm AS (
  SELECT {k}, n, r.b AS b, o.o AS "offset", (i - o.o) // r.b AS block, avg(value) AS block_mean
  FROM {src}, {b_range}, range(0, 500) o(o)
  WHERE o.o < r.b AND {size_filter} AND i >= o.o AND (i - o.o) // r.b < (n - o.o) // r.b GROUP BY ALL),
so AS (
  SELECT {k}, n, b, "offset", count(*) AS n_blocks, avg(block_mean) AS mean_blocks, stddev_samp(block_mean) AS sd_blocks,
         stddev_samp(block_mean) / sqrt(count(*)) AS se_blocks, count(*) >= {min_blocks} AS eligible
  FROM bm GROUP BY ALL HAVING count(*) >= 2)"""


def summary_sql(k: str) -> str:
    return f"""ss AS (
  SELECT {k}, n, b, count(*) AS n_offsets, count(*) FILTER (eligible) AS n_eligible, avg(se_blocks) AS se_mean, median(se_blocks) AS se_median,
         min(se_blocks) AS se_min, max(se_blocks) AS se_max,
         coalesce(median(se_blocks) FILTER (eligible), median(se_blocks)) AS se_choice
  FROM so GROUP BY ALL)"""


def plateau_sql(k: str) -> str:
    return f"""env AS (
  SELECT *, max(CASE WHEN n_eligible > 0 THEN se_choice END) OVER (PARTITION BY {k}) AS plateau,
         CASE WHEN n_eligible > 0 THEN max(CASE WHEN n_eligible > 0 THEN se_choice END) OVER (PARTITION BY {k} ORDER BY b) END AS envelope
  FROM ss),
pl AS (SELECT {k}, max(plateau) AS plateau, max(b) AS b_max, coalesce(min(b) FILTER (envelope >= 0.95 * plateau), max(b)) AS b_plateau FROM env GROUP BY ALL)"""


def acf_sql(src: str, k: str, max_lag: str = "n - 1") -> str:
    join = " AND ".join(f"p.{c.strip()} = q.{c.strip()}" for c in k.split(","))
    cols = ", ".join(f"p.{c.strip()}" for c in k.split(","))
    return f"""cen AS (SELECT {k}, i, n, value - avg(value) OVER (PARTITION BY {k}) AS c FROM {src}),
lagged AS (
  SELECT {cols}, p.n, q.i - p.i AS lag, sum(p.c * q.c) AS s FROM cen p JOIN cen q ON {join} AND q.i >= p.i AND q.i - p.i <= p.{max_lag.strip()}
  GROUP BY ALL),
ac AS (SELECT {k}, n, lag, s / first_value(s) OVER (PARTITION BY {k} ORDER BY lag) AS acf FROM lagged)"""


def g_sql(k: str) -> str:
    return f"""stopped AS (SELECT *, min(CASE WHEN lag > 3 AND acf <= 0 THEN lag END) OVER (PARTITION BY {k}) AS stop FROM ac),
gg AS (
  SELECT {k}, max(n) AS n, greatest(1.0::DOUBLE, 1.0::DOUBLE + 2.0::DOUBLE * coalesce(sum(acf) FILTER (lag > 0 AND lag <= n - 2 AND (stop IS NULL OR lag < stop)), 0)) AS g
  FROM stopped GROUP BY {k})"""


def rec_sql(k: str) -> str:
    return f"""rec0 AS (
  SELECT {k}, gg.n, g, (g - 1) / 2 AS tau, gg.n / g AS n_eff, coalesce(b_plateau, 1) AS b_plateau, CAST(ceil(g) AS INTEGER) AS b_g,
         least(greatest(coalesce(b_plateau, 1), CAST(ceil(g) AS INTEGER)), coalesce(b_max, 1)) AS b
  FROM gg LEFT JOIN pl USING ({k})),
rec AS (SELECT *, CASE WHEN b = 1 AND b_plateau = 1 AND b_g = 1 THEN 'roughly_uncorrelated_at_native_unit'
  WHEN b <= 2 THEN 'mild_correlation' ELSE 'strong_correlation' END AS correlation_flag FROM rec0)"""


def estimate_sql(src: str, sizes: str, k: str) -> str:
    return f"""eb AS (
  SELECT {k}, z.b, o.o AS "offset", (i - o.o) // z.b AS block, avg(value) AS block_mean
  FROM {src} JOIN (SELECT {k}, b FROM {sizes}) z USING ({k}), range(0, 500) o(o)
  WHERE o.o < z.b AND i >= o.o AND (i - o.o) // z.b < (n - o.o) // z.b GROUP BY ALL),
eo AS (SELECT {k}, b, "offset", count(*) AS nb, avg(block_mean) AS om, stddev_samp(block_mean) / sqrt(count(*)) AS os FROM eb GROUP BY ALL),
est AS (
  SELECT {k}, b, count(*) FILTER (nb >= 2) AS n_offsets, median(os) FILTER (nb >= 2) AS sem, min(os) FILTER (nb >= 2) AS sem_min,
         max(os) FILTER (nb >= 2) AS sem_max, avg(om) FILTER (nb >= 2) AS offset_mean,
         coalesce(min(nb) FILTER (nb >= 2), max(nb)) AS n_blocks, median(nb) FILTER (nb >= 2) AS n_blocks_median, max(nb) FILTER (nb >= 2) AS n_blocks_max
  FROM eo GROUP BY ALL),
mn AS (SELECT {k}, avg(value) AS mean, stddev_samp(value) AS sd, max(n) AS n FROM {src} GROUP BY ALL)"""


def ci_sql(k: str) -> str:
    return f"""ci AS (
  SELECT {k}, rec.n, g, tau, n_eff, rec.b, b_plateau, correlation_flag, mean, sem, n_blocks, {t_multiplier_sql('n_blocks - 1')} AS t_multiplier
  FROM rec JOIN est USING ({k}) JOIN mn USING ({k}))"""
