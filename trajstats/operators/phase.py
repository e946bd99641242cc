"""Phase rows: interface scalars, concentrations, curvature correction, quality flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trajstats.functions.scalars import clamp_small_negative, curvature_factor, failed_checks, joined_flags
from trajstats.functions.stats import finite

# Reference densities per class (mg/mL), profile checks, constants of the energy scale.
REFERENCE_DENSITY = {"Protein": 108.0, "RNA": 12.0}
REFERENCE_DENSITY_OTHER = 120.0
PROFILE_LIMITS = {"max_w_over_r": 3.0, "min_phi_r": 0.05, "max_phi_r": 3.0, "max_dense_ratio": 100.0}
FIT_BOLTZMANN = 1.3806e-23
FIT_AVOGADRO = 6.022e23


def interface_scalars(fits: DataFrame, temp_k: Column) -> DataFrame:
    """dense = |B+A|, dilute = |B-A|, partition ratio and transfer energy (J/mol), with the A-B covariance in the errors."""
    a, b, sa, sb, cov = (F.col(c) for c in ("a", "b", "se_a", "se_b", "cov_ab"))
    dense, dilute = F.abs(b + a), F.abs(b - a)
    sign = F.when(b - a >= 0, 1.0).otherwise(-1.0)
    inv_dilute, inv_dense = F.try_divide(sign, dilute), F.try_divide(F.lit(1.0), dense)
    ga, gb = -inv_dilute - inv_dense, inv_dilute - inv_dense
    kt = F.lit(FIT_BOLTZMANN * FIT_AVOGADRO) * temp_k
    ok = (dense > 0) & (dilute > 0)
    return fits.withColumns({
        "dense": dense, "dilute": dilute,
        "dense_sem": F.sqrt(F.greatest(F.lit(0.0), sa * sa + sb * sb + 2 * cov)), "dilute_sem": F.sqrt(F.greatest(F.lit(0.0), sa * sa + sb * sb - 2 * cov)),
        "partition": F.try_divide(dense, dilute), "d_g": F.when(ok, kt * F.log(F.try_divide(dilute, dense))),
        "d_g_sem": F.when(ok, kt * F.sqrt(F.greatest(F.lit(0.0), ga * ga * sa * sa + gb * gb * sb * sb + 2 * ga * gb * cov))),
    })


def geometry_concentrations(rows: DataFrame) -> DataFrame:
    """dense = mass over the sphere R+W; dilute = outer mass over the volume left outside.

    Lengths in Angstrom, masses in mg; the system volume follows from the class density.
    """
    r = (F.col("r_fit") + F.col("w_fit")) * 1e-8
    r_sem = F.sqrt(F.col("se_r") ** 2 + F.col("se_w") ** 2) * 1e-8
    volume = F.lit(4.0 / 3.0 * math.pi) * r * r * r
    volume_sem = F.lit(4 * math.pi) * r * r * r_sem
    reference = F.lit(REFERENCE_DENSITY_OTHER)
    for name, value in REFERENCE_DENSITY.items():
        reference = F.when(F.col("label") == name, F.lit(value)).otherwise(reference)
    outside = F.abs((F.col("outer_mass") + F.col("inner_mass")) / reference - volume)
    return rows.withColumns({
        "dense_calc": F.try_divide("inner_mass", volume), "dense_calc_sem": F.try_divide("inner_mass", volume * volume) * volume_sem,
        "dilute_calc": F.try_divide("outer_mass", outside), "dilute_calc_sem": F.abs(F.try_divide("outer_mass", outside * outside) * volume_sem),
    })


def profile_quality(fits: DataFrame) -> DataFrame:
    """Failed checks of a profile fit, as an array; the group-size checks apply to the label SG only."""
    w_over_r = F.try_divide("w_fit", "r_fit")
    phi = F.try_divide("r_fit", F.abs("rg"))
    ratio = F.try_divide(F.abs("dense_fit"), F.abs("dense_calc"))
    other = F.col("label") != "SG"
    lim = PROFILE_LIMITS
    positive = (F.col("r_fit") > 0) & (F.col("w_fit") > 0)
    checks = {
        "r_positive": F.col("r_fit") > 0, "w_positive": F.col("w_fit") > 0,
        "w_over_r": ~F.coalesce(positive, F.lit(False)) | (w_over_r <= lim["max_w_over_r"]),
        "phi_r": other | ~(F.coalesce(F.col("r_fit") > 0, F.lit(False)) & F.coalesce(F.abs("rg") > 0, F.lit(False))) | phi.between(lim["min_phi_r"], lim["max_phi_r"]),
        "dense_ratio": other | ~F.coalesce(F.abs("dense_calc") > 0, F.lit(False)) | F.col("dense_fit").isNull() | (ratio <= lim["max_dense_ratio"]),
    }
    return fits.withColumn("failed", failed_checks(checks)).withColumn("passed", F.size("failed") == 0)


def curvature_corrected(rows: DataFrame, *, negative_floor: float = 0.05, interface_limit: float = 0.75, curvature_limit: float = 0.1) -> DataFrame:
    """Dilute branch corrected for the droplet curvature, derived quantities, errors and flags.

    Columns in: temperature_k, c_sg, c_dil, r_sg, w_sg, gamma, meff and c_sg_sd, c_dil_sd,
    r_sg_sd, gamma_sd. A slightly negative dilute value counts as zero.
    """
    raw = F.col("c_dil")
    rows = rows.withColumns({c: finite(F.col(c).cast("double")) for c in ("c_sg", "c_dil", "r_sg", "w_sg", "gamma", "meff", "c_sg_sd", "c_dil_sd", "r_sg_sd", "gamma_sd")})
    bad = {
        "hard_invalid_negative_c_dil": raw < -negative_floor, "hard_invalid_c_sg": F.col("c_sg").isNull() | (F.col("c_sg") <= 0), "hard_invalid_R_sg": F.col("r_sg").isNull() | (F.col("r_sg") <= 0),
        "hard_invalid_W_sg": F.col("w_sg").isNull() | (F.col("w_sg") < 0), "hard_invalid_gamma": F.col("gamma").isNull() | (F.col("gamma") < 0),
        "hard_invalid_temperature": F.col("temperature_k").isNull() | (F.col("temperature_k") <= 0),
    }
    notes = {"clamped_small_negative_c_dil_to_zero": (raw < 0) & (raw >= -negative_floor), **bad}
    invalid = F.lit(False)
    for cond in bad.values():
        invalid = invalid | F.coalesce(cond, F.lit(False))
    out = rows.withColumn("warning_text", joined_flags(notes)).withColumn("invalid", invalid).withColumn("c_dil", clamp_small_negative(raw, negative_floor))
    v = F.try_divide(F.col("meff") * 1e-3, F.col("c_sg"))
    out = out.withColumn("s", finite(curvature_factor(F.col("gamma"), F.col("r_sg"), v, F.col("temperature_k"))))
    out = out.withColumn("c_dil_inf", finite(F.col("c_dil") * F.exp(-F.col("s"))))

    def rel(sd: str, value: Column) -> Column:
        return F.when(value > 0, F.col(sd) / value)

    s_sd = F.col("s") * F.sqrt(rel("gamma_sd", F.col("gamma")) ** 2 + rel("c_sg_sd", F.col("c_sg")) ** 2 + rel("r_sg_sd", F.col("r_sg")) ** 2)
    out = out.withColumn("s_sd", s_sd)
    dil_sd = F.when(F.col("c_dil") == 0, F.exp(-F.col("s")) * F.col("c_dil_sd")).otherwise(F.col("c_dil_inf") * F.sqrt(rel("c_dil_sd", F.col("c_dil")) ** 2 + F.coalesce("s_sd", F.lit(0.0)) ** 2))
    out = out.withColumn("c_dil_inf_sd", dil_sd)
    both = F.sqrt(F.coalesce("c_sg_sd", F.lit(0.0)) ** 2 + F.coalesce("c_dil_inf_sd", F.lit(0.0)) ** 2)
    lost = F.col("s").isNull() | F.col("c_dil_inf").isNull()
    return out.withColumns({
        "delta_c": F.col("c_sg") - F.col("c_dil_inf"), "c_bar": (F.col("c_sg") + F.col("c_dil_inf")) / 2, "delta_c_sd": both, "c_bar_sd": both / 2,
        "interface_ratio": F.try_divide("w_sg", "r_sg"),
    }).withColumns({
        "flag_large_interface_ratio": F.col("interface_ratio") >= interface_limit, "flag_large_curvature": F.col("s") >= curvature_limit, "flag_negative_delta_c": F.col("delta_c") <= 0,
        "warning_text": F.when(lost, F.concat_ws(";", F.nullif("warning_text", F.lit("")), F.lit("invalid_curvature_correction"))).otherwise(F.col("warning_text")),
        "invalid": F.col("invalid") | lost,
    })


def row_class(unit_id: Column, control: str) -> Column:
    """Struct (condition_type, subtype, row_type) of a row id."""
    def kind(a: str, b: str, c: str) -> Column:
        return F.struct(F.lit(a).alias("condition_type"), F.lit(b).alias("subtype"), F.lit(c).alias("row_type"))

    return (
        F.when(unit_id == control, kind("control", "control", "individual_compound"))
        .when(unit_id == "DSM_AVG", kind("DSM", "average", "arithmetic_class_average")).when(unit_id == "NDSM_AVG", kind("NDSM", "average", "arithmetic_class_average"))
        .when(unit_id == "DSM", kind("DSM", "aggregate", "category_aggregate")).when(unit_id == "NDSM", kind("NDSM", "aggregate", "category_aggregate"))
        .when(unit_id.rlike(r"^(D\d+|dsm_.*)$"), kind("DSM", "individual", "individual_compound")).when(unit_id.rlike(r"^(ND\d+|ndsm_.*)$"), kind("NDSM", "individual", "individual_compound"))
        .otherwise(kind("unknown", "unknown", "individual_compound"))
    )


def kept_row(unit_id: Column, control: str, aggregates: bool = False) -> Column:
    kept = (unit_id == control) | unit_id.isin("DSM_AVG", "NDSM_AVG") | unit_id.rlike(r"^(N?D\d+|n?dsm_.*)$")
    return kept | unit_id.isin("DSM", "NDSM") if aggregates else kept


def complete_features(wide: DataFrame, values: Sequence[str], denied: Sequence[str] = (), prefix: str = "SIG") -> list[str]:
    """Value columns that pass the deny list and are filled, with their SIG column, in every row.

    One aggregation over all columns gives the counts; only one row of counts reaches the driver.
    """
    names = [v for v in values if not any(mark in v for mark in denied)]
    counted = wide.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(v)).alias(v) for v in names], *[F.count(F.col(f"{prefix}{v}")).alias(f"{prefix}{v}") for v in names]).first()
    return [v for v in names if counted[v] == counted["_n"] and counted[f"{prefix}{v}"] == counted["_n"]]
