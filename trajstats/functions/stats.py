"""Mean, spread and interval expressions shared by all roll-ups."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, functions as F

T_TABLE_SIZE = 200


def finite(c: Column) -> Column:
    """NULL for NaN and infinities; Spark aggregates then skip the value."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def sem(c: Column) -> Column:
    """Sample standard deviation over the root of the count; NULL for one value."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def sem_zero(c: Column) -> Column:
    """As ``sem``, but 0 for a single value."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(sem(c))


def quadrature(*cols: Column) -> Column:
    """Root of the sum of squares of the positive terms, NULL when there is none."""
    squares = [F.when(c > 0, c * c) for c in cols]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in squares[1:]), F.coalesce(squares[0], F.lit(0.0)))
    return F.when(total > 0, F.sqrt(total))


def _central_t_mass(t: float, df: int) -> float:
    """P(|T| < t) for integer df, from the finite trigonometric series."""
    theta = math.atan(t / math.sqrt(df))
    c2 = math.cos(theta) ** 2
    term, total = (math.cos(theta), 0.0) if df % 2 else (1.0, 0.0)
    first = 2 if df % 2 else 1
    for k in range((df - 1) // 2 if df % 2 else df // 2):
        total += term
        term *= c2 * (first + 2 * k) / (first + 2 * k + 1)
    if df % 2:
        return 2 / math.pi * (theta + math.sin(theta) * total)
    return math.sin(theta) * total


@lru_cache(maxsize=None)
def t975(df: int) -> float:
    """Student-t quantile at 0.975, by bisection."""
    lo, hi = 1.0, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _central_t_mass(mid, df) < 0.95 else (lo, mid)
    return (lo + hi) / 2


def t975_table() -> list[float]:
    return [t975(df) for df in range(1, T_TABLE_SIZE + 1)]


def t_multiplier(df: Column) -> Column:
    """Quantile by degrees of freedom: a literal table, then the normal expansion."""
    z = 1.959963984540054
    z3, z5 = z**3, z**5
    tail = F.lit(z) + F.lit((z3 + z) / 4) / df + F.lit((5 * z5 + 16 * z3 + 3 * z) / 96) / (df * df)
    table = F.array(*[F.lit(v) for v in t975_table()])
    return F.when(df < 1, F.lit(None)).when(df <= T_TABLE_SIZE, F.try_element_at(table, df.cast("int"))).otherwise(tail)


def t_multiplier_sql(df: str) -> str:
    values = ", ".join(repr(v) for v in t975_table())
    return f"CASE WHEN {df} >= 1 THEN ([{values}]::DOUBLE[])[CAST({df} AS INTEGER)] END"
