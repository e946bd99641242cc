"""Radial profiles, pair distributions, centres, radii and shapes.

Every operator here reduces frames by hash aggregation on (frame, bin) or (frame,
chain): partial sums happen where the rows are read, so a dense core costs no skew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trajstats.functions.scalars import distance, minimum_image, shell_volume
from trajstats.functions.stats import sem


def bin_index(r: Column, width: float, n_bins: int) -> Column:
    """floor(r/width); the last bin is closed on the right, everything beyond is NULL."""
    k = F.floor(r / width)
    return F.when((r >= 0) & (r <= width * n_bins), F.least(k, F.lit(n_bins - 1))).cast("int")


def radial_profile(rows: DataFrame, keys: Sequence[str], frame: str, r: str, weight: str | None, width: float, n_bins: int, *,
                   factor: float = 1.0, frames: DataFrame | None = None) -> DataFrame:
    """(keys, bin, r_mid, density, sd, sem, n_frames): weighted shell density over frames.

    Empty bins count as zero in every frame (``frames`` lists all frames, empty ones
    included). The zeros are never materialised: mean and spread over frames follow from
    sums over the filled bins and the frame count.
    """
    hist = (
        rows.withColumn("bin", bin_index(F.col(r), width, n_bins)).filter("bin IS NOT NULL")
        .groupBy(*keys, frame, "bin").agg((F.sum(weight) if weight else F.count(F.lit(1)).cast("double")).alias("h"))
    )
    counted = frames if frames is not None else rows.select(*keys, frame)
    n_frames = counted.select(*keys, frame).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    filled = hist.groupBy(*keys, "bin").agg(F.avg("h").alias("_m"), F.var_pop("h").alias("_v"), F.count("h").alias("_k"))
    grid = n_frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = grid.join(filled, [*keys, "bin"], "left")
    k, n = F.coalesce("_k", F.lit(0)), F.col("n_frames")
    mean = F.coalesce(F.col("_m") * k / n, F.lit(0.0))
    # Sum of squared deviations of k filled values and n-k zeros about the common mean.
    ss = F.coalesce(k * F.col("_v") + k * (n - k) / n * F.col("_m") * F.col("_m"), F.lit(0.0))
    sd = F.when(n > 1, F.sqrt(ss / (n - 1))).otherwise(0.0)
    scale = F.lit(factor) / shell_volume(F.col("bin"), width)
    return out.select(
        *keys, "bin", ((F.col("bin") + 0.5) * width).alias("r_mid"), (mean * scale).alias("density"), (sd * scale).alias("sd"),
        (sd * scale / F.sqrt(n)).alias("sem"), "n_frames",
    )


def distance_from_centre(rows: DataFrame, centres: DataFrame, keys: Sequence[str], pos: Sequence[str] = ("x", "y", "z"),
                         box: Sequence[str] | None = None, out: str = "r") -> DataFrame:
    """Distance of each row from the (moving) centre ``cx, cy, cz`` of its frame.

    With ``box`` the centre is wrapped and the nearest periodic image is used.
    """
    joined = rows.join(centres.select(*keys, "cx", "cy", "cz"), list(keys))
    deltas = []
    for axis, p in enumerate(pos):
        c = F.col(("cx", "cy", "cz")[axis])
        if box:
            deltas.append(minimum_image(F.col(p) - F.pmod(c, F.col(box[axis])), F.col(box[axis])))
        else:
            deltas.append(F.col(p) - c)
    return joined.withColumn(out, distance(*deltas)).drop("cx", "cy", "cz")


def centre_of_mass(beads: DataFrame, keys: Sequence[str], mass: str = "mass", pos: Sequence[str] = ("xu", "yu", "zu"), names: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    m = F.col(mass)
    return beads.groupBy(*keys).agg(*[F.try_divide(F.sum(m * F.col(p)), F.sum(m)).alias(c) for p, c in zip(pos, names)], F.sum(m).alias("mass_total"), F.count(F.lit(1)).alias("n_beads"))


def com_and_rg(beads: DataFrame, keys: Sequence[str], mass: str = "mass", pos: Sequence[str] = ("xu", "yu", "zu")) -> DataFrame:
    """Centre of mass and mass-weighted radius of gyration in one pass.

    Rg is the root of the weighted mean square minus the squared centre. Coordinates are
    unwrapped chain coordinates, so the two terms are of the size of a chain and its box.
    """
    m = F.col(mass)
    out = beads.groupBy(*keys).agg(
        *[F.try_divide(F.sum(m * F.col(p)), F.sum(m)).alias(f"c{p[0]}") for p in pos],
        F.try_divide(F.sum(m * sum((F.col(p) * F.col(p) for p in pos), F.lit(0.0))), F.sum(m)).alias("_q"),
        F.sum(m).alias("mass_total"), F.count(F.lit(1)).alias("n_beads"),
    )
    centre2 = sum((F.col(f"c{p[0]}") * F.col(f"c{p[0]}") for p in pos), F.lit(0.0))
    return out.withColumn("rg", F.sqrt(F.greatest(F.col("_q") - centre2, F.lit(0.0)))).drop("_q")


def hydrodynamic_radius(inverse_sums: DataFrame, counts: DataFrame, keys: Sequence[str], n: str = "n_beads") -> DataFrame:
    """1/Rh = (2/N^2) * sum over pairs of 1/r; NULL below two beads."""
    joined = counts.join(inverse_sums, list(keys))
    return joined.withColumn("rh", F.when((F.col(n) >= 2) & (F.col("inv_sum") > 0), F.col(n) * F.col(n) / (2 * F.col("inv_sum"))))


def shape_eigenvalues(rows: DataFrame, keys: Sequence[str], pos: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Eigenvalues l1 >= l2 >= l3 of the sample covariance (closed form); NULL below three rows."""
    x, y, z = (F.col(p) for p in pos)
    cov = rows.groupBy(*keys).agg(
        F.var_samp(x).alias("_a"), F.var_samp(y).alias("_b"), F.var_samp(z).alias("_c"),
        F.covar_samp(x, y).alias("_d"), F.covar_samp(y, z).alias("_e"), F.covar_samp(x, z).alias("_f"), F.count(F.lit(1)).alias("n"),
    )
    a, b, c, d, e, f = (F.col(f"_{k}") for k in "abcdef")
    q = (a + b + c) / 3
    p2 = (a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)
    p = F.sqrt(p2 / 6)
    ba, bb, bc = a - q, b - q, c - q
    det = ba * (bb * bc - e * e) - d * (d * bc - e * f) + f * (d * e - bb * f)
    half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * p * p * p)))
    phi = F.acos(half) / 3
    big = F.when(p > 0, q + 2 * p * F.cos(phi)).otherwise(q)
    small = F.when(p > 0, q + 2 * p * F.cos(phi + 2 * math.pi / 3)).otherwise(q)
    ok = F.col("n") >= 3
    out = cov.select(*keys, "n", F.when(ok, big).alias("l1"), F.when(ok, small).alias("l3"), F.when(ok, q).alias("_q"))
    return out.select(*keys, "n", "l1", (3 * F.col("_q") - F.col("l1") - F.col("l3")).alias("l2"), "l3")


def pair_distribution(pairs: DataFrame, frames: DataFrame, keys: Sequence[str], frame: str, width: float, n_bins: int, n: str = "n", volume: str = "volume") -> DataFrame:
    """g(r): pair counts over (density * shell * N), averaged over the frames with two or more points.

    ``frames`` has one row per frame with the point count and the box volume.
    """
    counts = pairs.withColumn("bin", bin_index(F.col("dist"), width, n_bins)).filter("bin IS NOT NULL").groupBy(*keys, frame, "bin").agg(F.count(F.lit(1)).alias("h"))
    return distribution_from_counts(counts, frames, keys, frame, width, n_bins, n, volume)


def distribution_from_counts(counts: DataFrame, frames: DataFrame, keys: Sequence[str], frame: str, width: float, n_bins: int, n: str = "n", volume: str = "volume") -> DataFrame:
    """``pair_distribution`` from the pairs of each frame counted by bin (h)."""
    usable = frames.filter(F.col(n) >= 2)
    n_frames = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames")) if keys else usable.agg(F.count(F.lit(1)).alias("n_frames"))
    ideal = F.col(n) / F.col(volume) * shell_volume(F.col("bin"), width) * F.col(n)
    sums = counts.join(usable, [*keys, frame]).groupBy(*keys, "bin").agg(F.sum(F.col("h") / ideal).alias("s"))
    grid = n_frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(sums, [*keys, "bin"], "left").select(
        *keys, "bin", ((F.col("bin") + 0.5) * width).alias("r_mid"), (F.coalesce("s", F.lit(0.0)) / F.col("n_frames")).alias("g")
    )


def distribution_summary(rdf: DataFrame, keys: Sequence[str], tail_from: float) -> DataFrame:
    """Peak of g(r) and its mean beyond ``tail_from``."""
    stats = [F.max("g").alias("peak"), F.avg(F.when(F.col("r_mid") >= tail_from, F.col("g"))).alias("tail_mean")]
    return rdf.groupBy(*keys).agg(*stats) if keys else rdf.agg(*stats)


def profile_cv(profile: DataFrame, keys: Sequence[str], density: str = "density") -> DataFrame:
    d = F.col(density)
    cv = F.when(F.avg(d) != 0, F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.avg(d)).alias("cv")
    return profile.groupBy(*keys).agg(cv) if keys else profile.agg(cv)


def interpolated(curve: DataFrame, grid: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Curve values on another grid, linear between points and flat beyond the ends."""
    from pyspark.sql import Window as W

    on_curve = curve.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(False).alias("_g"))
    on_grid = grid.select(*keys, F.col(x).alias("x"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("_g"))
    point = F.when(~F.col("_g"), F.struct("x", "y"))
    w = W.partitionBy(*keys).orderBy("x", "_g")
    back = W.partitionBy(*keys).orderBy(F.desc("x"), "_g")
    both = on_curve.unionByName(on_grid).withColumn("_p", F.last(point, ignorenulls=True).over(w)).withColumn("_n", F.last(point, ignorenulls=True).over(back)).filter("_g")
    slope = (F.col("_n.y") - F.col("_p.y")) / F.nullif(F.col("_n.x") - F.col("_p.x"), F.lit(0.0))
    value = F.when(F.col("_p").isNull(), F.col("_n.y")).when(F.col("_n").isNull(), F.col("_p.y")).otherwise(
        F.col("_p.y") + F.coalesce(slope * (F.col("x") - F.col("_p.x")), F.lit(0.0))
    )
    return both.select(*keys, F.col("x").alias(x), value.alias(y))


def surface_tension(shape: DataFrame, keys: Sequence[str], radius_a: Column, temp_k: Column) -> DataFrame:
    """Interfacial tension from shape fluctuations: K / mean of the squared axis modes, with SEM.

    Frames with a non-positive eigenvalue are left out. Needs l1, l2, l3 per frame.
    """
    kb = 1.3806e-23
    r = radius_a * 1e-10
    l1, l2, l3 = (F.col(c) * 1e-10 for c in ("l1", "l2", "l3"))
    a = r * F.pow(l1, F.lit(1 / 3)) / F.pow(l2 * l3, F.lit(1 / 6)) - r
    b = r * F.pow(l2, F.lit(1 / 3)) / F.pow(l1 * l3, F.lit(1 / 6)) - r
    c = r * F.pow(l3, F.lit(1 / 3)) / F.pow(l1 * l2, F.lit(1 / 6)) - r
    modes = shape.filter("l1 > 0 AND l2 > 0 AND l3 > 0").select(
        *keys, temp_k.alias("_t"), ((a + b) ** 2 + (a + c) ** 2 + (b + c) ** 2).alias("_p"), ((a - b) ** 2 + (a - c) ** 2 + (b - c) ** 2).alias("_m")
    )
    aggs = [F.avg("_t").alias("_t"), F.avg("_p").alias("_p"), F.avg("_m").alias("_m"), sem(F.col("_p")).alias("_ps"), sem(F.col("_m")).alias("_ms"), F.count(F.lit(1)).alias("n")]
    agg = modes.groupBy(*keys).agg(*aggs) if keys else modes.agg(*aggs)
    k1, k2 = 15 * kb / (16 * math.pi) * F.col("_t"), 45 * kb / (16 * math.pi) * F.col("_t")
    ok = (F.col("_p") > 1e-30) & (F.col("_m") > 1e-30)
    out = agg.withColumn("st_1", F.when(ok, k1 / F.col("_p"))).withColumn("st_2", F.when(ok, k2 / F.col("_m")))
    out = out.withColumn("st", (F.col("st_1") + F.col("st_2")) / 2)
    s1, s2 = F.col("st_1") * F.col("_ps") / F.col("_p"), F.col("st_2") * F.col("_ms") / F.col("_m")
    return out.withColumn("st_sem", F.sqrt(s1 * s1 + s2 * s2) / 2).drop("_t", "_p", "_m", "_ps", "_ms")
