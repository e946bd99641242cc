"""Repeatable pseudo-random draws as plain column expressions.

A draw depends on integer labels only (seed, replicate, slot), never on the partition it
runs in, so a lost task gives the same numbers when it is run again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296
LABEL_FACTORS = (73856093, 19349663, 83492791, 49979687)
ROUNDS = ((1664525, 1013904223, 16), (22695477, 1, 15), (1664525, 1, 13))


def uniform(*labels: Column) -> Column:
    """Uniform in (0, 1) from up to four integer labels."""
    x = F.lit(0).cast("long")
    for label, factor in zip(labels, LABEL_FACTORS, strict=False):
        x = F.pmod(x + F.pmod(label.cast("long"), F.lit(TWO_32)) * factor, F.lit(TWO_32))
    for factor, add, shift in ROUNDS:
        x = (x * factor + add) % F.lit(TWO_32)
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return (x + 0.5) / TWO_32


def normal(*labels: Column) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    u1, u2 = uniform(*labels, F.lit(1)), uniform(*labels, F.lit(2))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def uniform_sql(*labels: str) -> str:
    """The same draw as SQL text, for the check queries."""
    x = "(" + " + ".join(f"(({label})::BIGINT % {TWO_32}) * {factor}" for label, factor in zip(labels, LABEL_FACTORS)) + f") % {TWO_32}"
    for factor, add, shift in ROUNDS:
        y = f"((({x}) * {factor} + {add}) % {TWO_32})"
        x = f"xor({y}, {y} >> {shift})"
    return f"((({x}) + 0.5::DOUBLE) / {TWO_32})"


def normal_sql(*labels: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(*labels, '1')})) * cos(2 * pi() * {uniform_sql(*labels, '2')}))"
