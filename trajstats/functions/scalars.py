"""Column expressions: geometry, units, safe arithmetic, validity flags, physics.

Everything is a plain expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from trajstats.functions.stats import finite

# Unit factors, constants and masses that results depend on.
DALTON_PER_A3_TO_MG_ML = 1660.5390666
ATM_TO_PA_PER_A3 = 101325e-30
GAS_CONSTANT_KJ = 8.314462618e-3
GAS_CONSTANT_J = 8.314462618
BOLTZMANN_J = 1.380649e-23
GREEN_KUBO_BOLTZMANN = 1.3806e-23
STEP_FS = 20


# --- geometry --------------------------------------------------------------------------

def minimum_image(delta: Column, length: Column) -> Column:
    """Displacement to the nearest periodic copy; half boxes round to even."""
    return delta - length * F.rint(delta / length)


def wrap(x: Column, length: Column) -> Column:
    return F.pmod(x, length)


def distance(*deltas: Column) -> Column:
    total = deltas[0] * deltas[0]
    for d in deltas[1:]:
        total = total + d * d
    return F.sqrt(total)


def shell_volume(bin_index: Column, width: float) -> Column:
    """Volume of the spherical shell [k*w, (k+1)*w)."""
    inner, outer = bin_index * width, (bin_index + 1) * width
    return F.lit(4.0 * math.pi / 3.0) * (outer * outer * outer - inner * inner * inner)


# --- safe arithmetic -------------------------------------------------------------------

def safe_ratio(num: Column, den: Column) -> Column:
    """NULL where the denominator is 0 or either side is not finite."""
    return finite(F.when(den != 0, finite(num) / finite(den)))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a-b)/b with 0 in place of an undefined quotient."""
    return F.coalesce(safe_ratio(a - b, b), F.lit(0.0))


def neg_log(x: Column) -> Column:
    return F.when(x > 0, -F.log(x))


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.log(a / b))


def log2_fold_change(num: Column, den: Column, eps: Column) -> Column:
    """log2((num+eps)/(den+eps)), NULL where both sides are at most eps."""
    return F.when(F.greatest(num, den) > eps, F.log2((num + eps) / (den + eps)))


def relative_difference_sigma(value: Column, sd: Column, ref: Column, ref_sd: Column) -> Column:
    """Error of (value-ref)/ref, the two parts added linearly."""
    return F.when(ref != 0, F.abs(sd / ref) + F.abs(value * ref_sd / (ref * ref)))


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


# --- units -----------------------------------------------------------------------------

def time_to_ns(value: Column, unit: Column) -> Column:
    return F.when(unit == "s", value * 1e9).when(unit == "us", value * 1e3).when(unit == "ps", value * 1e-3).when(unit == "ns", value)


def area_to_um2(value: Column, unit: Column) -> Column:
    return F.when(unit == "m2", value * 1e12).when(unit == "nm2", value * 1e-6).when(unit == "A2", value * 1e-8).when(unit == "um2", value)


def step_to_ns(step: Column) -> Column:
    return step * (STEP_FS * 1e-6)


def stress_to_pascal(value: Column, volume_a3: Column) -> Column:
    """Per-chain stress times volume (atm A^3) to Pa."""
    return value * ATM_TO_PA_PER_A3 / (volume_a3 * 1e-30)


# --- flags and quality -----------------------------------------------------------------

def joined_flags(flags: dict[str, Column]) -> Column:
    """';'-joined names of the conditions that hold, in the given order."""
    return F.concat_ws(";", *[F.when(cond, F.lit(name)) for name, cond in flags.items()])


def clamp_small_negative(x: Column, tolerance: float = 0.05) -> Column:
    return F.when((x < 0) & (x >= -tolerance), F.lit(0.0)).otherwise(x)


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold, as an array; NULL counts as failed."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in checks.items()]))


def equilibration_audit(start: Column, fraction: Column, default: float, soft_max: float, hard_fraction: float) -> Column:
    """Detected start against the fixed policy: agree, soft, hard or indeterminate."""
    light = fraction.isNull() | (fraction <= hard_fraction)
    return (
        F.when(start.isNull(), "indeterminate")
        .when((start <= default) & light, "agree_with_default")
        .when((start <= soft_max) & light, "later_than_default_soft")
        .otherwise("later_than_default_hard")
    )


# --- physics ---------------------------------------------------------------------------

def stokes_einstein(temp_k: Column, eta: Column, radius_m: Column) -> Column:
    return F.when((eta > 0) & (radius_m > 0), F.lit(BOLTZMANN_J) * temp_k / (F.lit(6 * math.pi) * eta * radius_m))


def stokes_einstein_sem(d: Column, eta: Column, eta_sem: Column, radius: Column, radius_sem: Column) -> Column:
    """Relative errors of viscosity and radius added in quadrature."""
    return d * hypot(F.coalesce(F.try_divide(eta_sem, eta), F.lit(0.0)), F.coalesce(F.try_divide(radius_sem, radius), F.lit(0.0)))


def transfer_energy(dense: Column, dilute: Column, temp_k: Column) -> Column:
    """RT ln(dilute/dense) in kJ/mol."""
    return F.when((dense > 0) & (dilute > 0), F.lit(GAS_CONSTANT_KJ) * temp_k * F.log(dilute / dense))


def pair_energy(r: Column, eps: Column, sigma: Column, nu: Column, mu: Column, rc: Column) -> Column:
    """eps*alpha*((sigma/r)^(2mu)-1)*((rc/r)^(2mu)-1)^(2nu) inside rc, 0 beyond.

    alpha makes the well depth eps.
    """
    big = F.pow(rc / sigma, 2 * mu)
    alpha = 2 * nu * big * F.pow((1 + 2 * nu) / (2 * nu * (big - 1)), 2 * nu + 1)
    phi = eps * alpha * (F.pow(sigma / r, 2 * mu) - 1) * F.pow(F.pow(rc / r, 2 * mu) - 1, 2 * nu)
    return F.when(r < rc, phi).otherwise(0.0)


def curvature_factor(gamma_mn_m: Column, radius_a: Column, molar_volume_m3: Column, temp_k: Column) -> Column:
    """s = 2*gamma*V/(R*Rgas*T), gamma in mN/m and R in Angstrom."""
    return F.try_divide(F.lit(2.0) * (gamma_mn_m * 1e-3) * molar_volume_m3, (radius_a * 1e-10) * F.lit(GAS_CONSTANT_J) * temp_k)


def chains_from_pairs(diagonal: Column) -> Column:
    """Chain number N from its count d of same-species pairs, d = N(N-1)/2."""
    return (F.lit(1.0) + F.sqrt(F.lit(1.0) + 8.0 * diagonal)) / 2.0


def coalesce_aliases(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """First non-NULL of the alias columns that exist in the table."""
    present = [F.col(c) for c in aliases if c in columns]
    return F.coalesce(*present) if present else F.lit(None)
