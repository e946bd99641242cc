"""Combining rules of pair potentials, their comparison, and full pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARAMETERS = ("eps", "sig", "v", "mu", "rc")


def rules(e1: Column, e2: Column, s1: Column, s2: Column) -> dict[str, dict[str, Column]]:
    """Mixed eps and sig by rule: LB, WH, FH, K (the Kong sigma rule is used for K)."""
    six = F.pow(s1, F.lit(6)) + F.pow(s2, F.lit(6))
    mean13 = (F.pow(e1 * F.pow(s1, F.lit(12)), F.lit(1 / 13)) + F.pow(e2 * F.pow(s2, F.lit(12)), F.lit(1 / 13))) / 2
    kong_sigma = F.pow(F.pow(mean13, F.lit(13)), F.lit(1 / 6))
    kong_eps = e1 * F.pow(s1, F.lit(6)) * e2 * F.pow(s2, F.lit(6)) / F.pow(kong_sigma, F.lit(6))
    return {
        "eps": {"LB": F.sqrt(e1 * e2), "WH": 2 * F.sqrt(e1 * e2) * F.pow(s1, F.lit(3)) * F.pow(s2, F.lit(3)) / six, "FH": 2 * e1 * e2 / (e1 + e2), "K": kong_eps},
        "sig": {"LB": (s1 + s2) / 2, "WH": F.pow(six / 2, F.lit(1 / 6)), "FH": (s1 + s2) / 2, "K": kong_sigma},
    }


def mean_rules(a: Column, b: Column) -> dict[str, Column]:
    return {"G": F.sqrt(a * b), "A": (a + b) / 2}


def mixed(pairs: DataFrame) -> DataFrame:
    """Long table (i, j, parameter, rule, mixed) from pairs with both homotypic sets (``_1``, ``_2``)."""
    by_parameter = rules(F.col("eps_1"), F.col("eps_2"), F.col("sig_1"), F.col("sig_2"))
    by_parameter.update({p: mean_rules(F.col(f"{p}_1"), F.col(f"{p}_2")) for p in ("v", "mu", "rc")})
    rows = [F.struct(F.lit(p).alias("parameter"), F.lit(r).alias("rule"), c.cast("double").alias("mixed")) for p, by_rule in by_parameter.items() for r, c in by_rule.items()]
    return pairs.select("i", "j", F.explode(F.array(*rows)).alias("m")).select("i", "j", "m.*")


def homotypic_pairs(homotypic: DataFrame, item: str = "type") -> DataFrame:
    """All i <= j of a table of types (one row per type, so the pairing is bounded)."""
    a = homotypic.select(F.col(item).alias("i"), *[F.col(p).alias(f"{p}_1") for p in PARAMETERS])
    b = homotypic.select(F.col(item).alias("j"), *[F.col(p).alias(f"{p}_2") for p in PARAMETERS])
    return a.join(F.broadcast(b), F.col("i") <= F.col("j"))


def rule_errors(mixed_rows: DataFrame, reference: DataFrame) -> DataFrame:
    """RMSE per parameter and rule against reference values (i, j, parameter, value)."""
    joined = mixed_rows.join(reference, ["i", "j", "parameter"])
    return joined.groupBy("parameter", "rule").agg(F.sqrt(F.avg((F.col("mixed") - F.col("value")) ** 2)).alias("rmse"))


def best_rules(errors: DataFrame) -> DataFrame:
    """Rule of least RMSE per parameter; ties go to the first name."""
    return errors.groupBy("parameter").agg(F.min_by("rule", F.struct("rmse", "rule")).alias("rule"))


def full_table(mixed_rows: DataFrame, best: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference value where there is one, else the value mixed by the best rule; v and mu are whole numbers."""
    chosen = mixed_rows.join(F.broadcast(best), ["parameter", "rule"]).join(reference, ["i", "j", "parameter"], "left")
    value = F.coalesce("value", F.when(F.col("parameter").isin("v", "mu"), F.bround("mixed")).otherwise(F.col("mixed")))
    return chosen.select("i", "j", "parameter", value.alias("value"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two parameter sets over their common pairs, per parameter."""
    joined = a.join(b.select("i", "j", "parameter", F.col("value").alias("other")), ["i", "j", "parameter"])
    x, y = F.col("other"), F.col("value")
    return joined.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((x - y) ** 2)).alias("rmse"), F.avg(F.abs(x - y)).alias("mae"), F.regr_r2(y, x).alias("r2")
    )
