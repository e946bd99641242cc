"""Means with errors over windows, systems and classes; comparisons between them.

All of these are one or two hash aggregations with map-side partials. A hot key costs
its partial sums only, never its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajstats.functions.stats import finite, sem, sem_zero


def mean_sem(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sd, SEM and count per key: profiles, matrices, vectors and scalars alike."""
    v = finite(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), sem(v).alias("sem"), F.count(v).alias("n"))


def class_means(df: DataFrame, keys: Sequence[str], mean: str = "mean", own_sem: str | None = None) -> DataFrame:
    """Class mean and SEM across systems; a lone system keeps its own SEM if given."""
    m = F.col(mean)
    across = sem(m)
    if own_sem:
        across = F.when(F.count(m) == 1, F.max(own_sem)).otherwise(across)
    return df.groupBy(*keys).agg(F.avg(m).alias("mean"), across.alias("sem"), F.count(m).alias("n"))


def block_then_system(windows: DataFrame, layout: DataFrame, system: Sequence[str], window: str, key: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over the windows of each block, then mean and SEM over blocks.

    ``layout`` lists (system, block_id, window), one row per member window.
    """
    blocks = windows.join(layout.select(*system, "block_id", window), [*system, window]).groupBy(*system, "block_id", *key).agg(F.avg(finite(F.col(value))).alias("_b"))
    b = F.col("_b")
    return blocks.groupBy(*system, *key).agg(F.avg(b).alias("mean"), sem(b).alias("sem"), F.count(b).alias("n_blocks"))


def random_effects_mean(units: DataFrame, keys: Sequence[str], mean: str = "mean", own_sem: str = "sem") -> DataFrame:
    """Class mean with SEM sqrt(cross^2 + mean(own^2)/n); a lone unit keeps its own SEM."""
    m, s = F.col(mean), F.col(own_sem)
    cross = F.coalesce(sem(m), F.lit(0.0))
    inner = F.coalesce(F.avg(s * s) / F.count(m), F.lit(0.0))
    combined = F.when(F.count(s) + F.count(m) > 1, F.sqrt(cross * cross + inner))
    return units.groupBy(*keys).agg(F.avg(m).alias("mean"), F.when(F.count(m) == 1, F.max(s)).otherwise(combined).alias("sem"), F.count(m).alias("n"))


def additive_profile(profiles: DataFrame, keys: Sequence[str], density: str = "density", own_sem: str = "sem") -> DataFrame:
    """Sum over species at equal distance; SEMs add in quadrature."""
    return profiles.groupBy(*keys).agg(F.sum(density).alias(density), F.sqrt(F.sum(F.col(own_sem) * F.col(own_sem))).alias(own_sem))


def tile_average(cells: DataFrame, keys: Sequence[str], p: int, q: int, value: str = "value", shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean over the p x q tiles of a copy-stacked map; square tiles on the diagonal are dropped.

    With ``shape`` missing cells count as zero; a map of one tile comes back unchanged.
    """
    i, j = F.col("i"), F.col("j")
    rows = cells
    n_tiles = None
    if shape:
        k, m = shape[0] // p, shape[1] // q
        if (k, m) == (1, 1):
            return cells.select(*keys, "i", "j", value)
        n_tiles = k * m - (min(k, m) if p == q else 0)
    if p == q:
        rows = rows.filter(F.floor(i / p) != F.floor(j / q))
    agg = F.sum(value) / n_tiles if n_tiles else F.avg(value)
    return rows.groupBy(*keys, F.pmod(i, F.lit(p)).alias("i"), F.pmod(j, F.lit(q)).alias("j")).agg(agg.alias(value))


def two_step_mean(rows: DataFrame, unit: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """Mean within each unit, then mean and SEM across units (0 for a single unit)."""
    units = rows.groupBy(*dict.fromkeys([*keys, *unit])).agg(F.avg(value).alias("_u"))
    u = F.col("_u")
    return units.groupBy(*keys).agg(F.avg(u).alias("mean"), sem_zero(u).alias("sem"), F.count(u).alias("n"))


def coarsened(profile: DataFrame, keys: Sequence[str], bin_col: str, n: int, values: Sequence[str]) -> DataFrame:
    """Average every n consecutive bins of a series; bins are numbered from 0."""
    return profile.groupBy(*keys, F.floor(F.col(bin_col) / n).cast("int").alias(bin_col)).agg(*[F.avg(v).alias(v) for v in values])


def row_collapse(cells: DataFrame, keys: Sequence[str], value: str = "value", own_sem: str = "sem") -> DataFrame:
    """Row sums of a map with SEMs in quadrature."""
    return cells.groupBy(*keys, "i").agg(F.sum(value).alias(value), F.sqrt(F.sum(F.col(own_sem) * F.col(own_sem))).alias(own_sem))


def core_share(profile: DataFrame, unit: Sequence[str], species: str, r: str, density: str, core: float) -> DataFrame:
    """Share of each species in the density summed up to the core radius."""
    inner = profile.filter(F.col(r) <= core).groupBy(*unit, species).agg(F.sum(density).alias("_d"))
    total = inner.groupBy(*unit).agg(F.sum("_d").alias("_t"))
    return inner.join(total, list(unit)).select(*unit, species, F.when(F.col("_t") > 0, F.col("_d") / F.col("_t")).alias("share"))


def two_class_shift(units: DataFrame, keys: Sequence[str], class_col: str, value: str, first: str, second: str) -> DataFrame:
    """Mean difference of two classes with SEM by hypot and z = difference / SEM, in one pass."""
    a, b = (F.when(F.col(class_col) == c, F.col(value)) for c in (first, second))
    out = units.groupBy(*keys).agg(
        F.avg(a).alias("mean_1"), F.avg(b).alias("mean_2"), sem(a).alias("_s1"), sem(b).alias("_s2"), F.count(a).alias("n_1"), F.count(b).alias("n_2")
    )
    out = out.withColumn("delta", F.col("mean_1") - F.col("mean_2")).withColumn("sem", F.sqrt(F.col("_s1") ** 2 + F.col("_s2") ** 2))
    return out.withColumn("z", F.when(F.col("sem") > 0, F.col("delta") / F.col("sem"))).drop("_s1", "_s2")


def replicate_summary(rows: DataFrame, keys: Sequence[str], values: Sequence[str], flags: Sequence[str] = (), labels: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Mean and sample sd of the values, any() of flags, mode of labels (ties to the smallest), joined distinct texts.

    ``texts`` are label-like columns with few distinct values per group.
    """
    aggs = [F.count(F.lit(1)).alias("n_reps")]
    for v in values:
        aggs += [F.avg(v).alias(v), F.stddev_samp(v).alias(f"{v}_sd")]
    aggs += [F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags]
    aggs += [F.mode(F.col(c), True).alias(c) for c in labels]
    aggs += [F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ";").alias(c) for c in texts]
    return rows.groupBy(*keys).agg(*aggs)


def with_class_row(wide: DataFrame, id_col: str, class_col: str, values: Sequence[str], label: Column) -> DataFrame:
    """Wide table plus one average row per class; SIG<value> is the SEM over its members."""
    aggs = [a for v in values for a in (F.avg(v).alias(v), sem(F.col(v)).alias(f"SIG{v}"))]
    averages = wide.groupBy(class_col).agg(*aggs).withColumn(id_col, label)
    return wide.unionByName(averages, allowMissingColumns=True)


def time_thirds(rows: DataFrame, keys: Sequence[str], t: str, start: float, end: float, value: str) -> DataFrame:
    """Mean and SEM in three equal spans of the run: early, middle, late."""
    third = (end - start) / 3
    label = F.when(F.col(t) < start + third, "early").when(F.col(t) < start + 2 * third, "middle").otherwise("late")
    return mean_sem(rows.filter((F.col(t) >= start) & (F.col(t) <= end)).withColumn("span", label), [*keys, "span"], value)


def concatenated_systems(rows: DataFrame, system: str, ids: str) -> DataFrame:
    """Member systems on one id axis: the k-th system is shifted by k * (largest id)."""
    order = rows.select(system).distinct().withColumn("_k", F.row_number().over(W.orderBy(system)) - 1)
    top = rows.agg(F.max(ids).alias("_top"))
    return rows.join(order, system).crossJoin(F.broadcast(top)).withColumn(ids, F.col(ids) + F.col("_k") * F.col("_top")).drop("_k", "_top")


def member_blocks(members: DataFrame, system: Sequence[str], window: str, species: str, chain: str, block: Column, more_than: int = 2) -> DataFrame:
    """Members per species and window, mean over the windows of a block, mean and SEM over blocks.

    Windows with at most ``more_than`` members in all are skipped.
    """
    counts = members.groupBy(*system, window, species).agg(F.count_distinct(chain).alias("_n"))
    total = counts.groupBy(*system, window).agg(F.sum("_n").alias("_t")).filter(F.col("_t") > more_than)
    blocks = counts.join(total, [*system, window]).withColumn("_b", block).groupBy(*system, species, "_b").agg(F.avg("_n").alias("_m"))
    m = F.col("_m")
    return blocks.groupBy(*system, species).agg(F.avg(m).alias("mean"), sem(m).alias("sem"), F.count(m).alias("n_blocks"))


def trend_table(rows: DataFrame, keys: Sequence[str], class_col: str, classes: Sequence[str], value: str) -> DataFrame:
    """One row per temperature with value and SEM of every class side by side."""
    v = F.col(value)
    return rows.groupBy(*keys).pivot(class_col, list(classes)).agg(F.avg(v).alias("value"), sem(v).alias("sem"))


def effective_mass(rows: DataFrame, mass: str, total_mass: str, chains: str, override: float | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Override, else median of the positive row values, else mean mass over mean chain count; spread flag."""
    m = F.when(F.col(mass) > 0, F.col(mass))
    out = rows.agg(F.median(m).alias("_med"), F.max(m).alias("_hi"), F.min(m).alias("_lo"), F.try_divide(F.avg(total_mass), F.avg(chains)).alias("_inferred"))
    spread = (F.col("_hi") - F.col("_lo")) / F.abs("_med")
    return out.select(
        F.coalesce(F.lit(override).cast("double"), "_med", "_inferred").alias("meff"), spread.alias("relative_spread"), (F.coalesce(spread, F.lit(0.0)) > tolerance).alias("spread_warning")
    )


# --- comparisons -----------------------------------------------------------------------

def against_reference(rows: DataFrame, keys: Sequence[str], condition: str, reference: str, value: str, sd: str | None = None, eps: float = 1e-3) -> DataFrame:
    """Absolute and relative difference to the reference condition at the same keys.

    A reference below ``eps`` or a missing one makes the relative value NULL and sets
    ``unstable``; the reference itself has differences 0.
    """
    ref = rows.filter(F.col(condition) == reference).select(*keys, F.col(value).alias("_r"), *([F.col(sd).alias("_rs")] if sd else []))
    out = rows.join(ref, list(keys), "left")
    own = F.col(condition) == reference
    stable = F.coalesce(F.abs("_r") >= eps, F.lit(False))
    out = out.withColumn("delta_abs", F.when(own, 0.0).otherwise(F.col(value) - F.col("_r")))
    out = out.withColumn("delta_rel", F.when(own, 0.0).when(stable, (F.col(value) - F.col("_r")) / F.col("_r")))
    if sd:
        from trajstats.functions.scalars import relative_difference_sigma
        out = out.withColumn("delta_rel_sd", F.when(own, 0.0).when(stable, relative_difference_sigma(F.col(value), F.col(sd), F.col("_r"), F.col("_rs"))))
    return out.withColumn("unstable", ~own & ~stable).drop("_r", "_rs")


def cell_difference(a: DataFrame, ref: DataFrame, keys: Sequence[str], value: str = "mean", own_sem: str = "sem") -> DataFrame:
    """Per cell: a-ref with SEM by quadrature, (a-ref)/ref with SEM of the ratio, and z."""
    r = ref.select(*keys, F.col(value).alias("_r"), F.col(own_sem).alias("_rs"))
    d, s2 = F.col(value) - F.col("_r"), F.col(own_sem) ** 2 + F.col("_rs") ** 2
    ratio_sem = F.sqrt((F.col(own_sem) / F.col("_r")) ** 2 + (F.col(value) * F.col("_rs") / (F.col("_r") * F.col("_r"))) ** 2)
    ok = F.col("_r") != 0
    return a.join(r, list(keys)).select(
        *keys, d.alias("diff"), F.sqrt(s2).alias("diff_sem"), F.when(ok, d / F.col("_r")).alias("rel"), F.when(ok, ratio_sem).alias("rel_sem"), F.when(s2 > 0, d / F.sqrt(s2)).alias("z")
    )


def log_ratio_contrast(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "mean", own_sem: str = "sem") -> DataFrame:
    """ln(a/b) with error sqrt((sa/a)^2 + (sb/b)^2) and z, where both are positive."""
    r = b.select(*keys, F.col(value).alias("_r"), F.col(own_sem).alias("_rs"))
    ok = (F.col(value) > 0) & (F.col("_r") > 0)
    err = F.sqrt((F.col(own_sem) / F.col(value)) ** 2 + (F.col("_rs") / F.col("_r")) ** 2)
    out = a.join(r, list(keys)).select(*keys, F.when(ok, F.log(F.col(value) / F.col("_r"))).alias("ln_ratio"), F.when(ok, err).alias("error"))
    return out.withColumn("z", F.when(F.col("error") > 0, F.col("ln_ratio") / F.col("error")))


def ratio_to_reference(rows: DataFrame, keys: Sequence[str], unit: str, reference: str, value: str) -> DataFrame:
    """value over the reference unit's value at the same keys; NULL when that is 0 or missing."""
    ref = rows.filter(F.col(unit) == reference).select(*keys, F.col(value).alias("_r"))
    return rows.join(ref, list(keys), "left").withColumn("ratio", F.when(F.col("_r") != 0, F.col(value) / F.col("_r"))).drop("_r")


def overridden(wide: DataFrame, corrections: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Cells of rows that have a correction take its values, NULL included."""
    fixes = corrections.select(*keys, F.lit(True).alias("_hit"), *[F.col(v).alias(f"_{v}") for v in values])
    joined = wide.join(fixes, list(keys), "left")
    return joined.withColumns({v: F.when(F.col("_hit"), F.col(f"_{v}")).otherwise(F.col(v)) for v in values}).drop("_hit", *[f"_{v}" for v in values])


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last in the given order. An aggregation, so a hot key is cheap."""
    others = [c for c in rows.columns if c not in keys]
    named = [o.alias(f"_o{k}") for k, o in enumerate(order)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*named)).alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in others])


def enriched(rows: DataFrame, diagnostics: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with the diagnostics of their keys; of repeated diagnostics the last counts, rows without any keep NULLs."""
    return rows.join(latest_per_key(diagnostics, keys, order), list(keys), "left")


def two_level_summary(rows: DataFrame, condition: str, group: str, temperature: str, means: Sequence[str], unstable: str) -> DataFrame:
    """Means of the stable rows and their count per condition, and per class and temperature, as one table."""
    stable = rows.filter(~F.col(unstable))
    aggs = [F.avg(m).alias(f"mean_{m}") for m in means] + [F.count(F.lit(1)).alias("n_points")]
    by_condition = stable.groupBy(F.col(condition).alias("name"), F.col(group).alias("class")).agg(*aggs).withColumn("level", F.lit("condition")).withColumn("temperature", F.lit(None).cast(rows.schema[temperature].dataType))
    by_class = stable.groupBy(F.col(group).alias("class"), F.col(temperature).alias("temperature")).agg(*aggs).withColumn("level", F.lit("class_temperature")).withColumn("name", F.concat("class", F.lit("_GROUP")))
    return by_condition.unionByName(by_class)


def grid_mismatches(curves: DataFrame, series: str, x: str, places: int = 12) -> DataFrame:
    """Grid points that some series have and others lack; empty when all share one grid."""
    points = curves.select(series, F.round(x, places).alias(x)).distinct()
    n = points.agg(F.count_distinct(series).alias("_all"))
    return points.groupBy(x).agg(F.count(F.lit(1)).alias("n_series")).crossJoin(F.broadcast(n)).filter("n_series < _all").drop("_all")


def long_to_wide(long: DataFrame, keys: Sequence[str], key: str, names: Sequence[str], mean: str = "mean", own_sem: str = "sem") -> DataFrame:
    """Master table: one column per observable and SIG<observable> beside it."""
    out = long.groupBy(*keys).pivot(key, list(names)).agg(F.max(mean).alias("m"), F.max(own_sem).alias("s"))
    return out.select(*keys, *[c for n in names for c in (F.col(f"{n}_m").alias(n), F.col(f"{n}_s").alias(f"SIG{n}"))])


def ranked_union(sources: Sequence[DataFrame]) -> DataFrame:
    """(id, column, value) of several sources: of one id and column the first source with a value counts, within a source the largest value."""
    rows = None
    for rank, source in enumerate(sources):
        part = source.select("id", "column", "value", F.lit(rank).alias("_rank")).filter("value IS NOT NULL")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id", "column").agg(F.min_by("value", F.struct("_rank", (-F.col("value")).alias("_v"))).alias("value"))


def augmented_master(master: DataFrame, sources: Sequence[DataFrame], columns: Sequence[str], classes: DataFrame) -> DataFrame:
    """``master`` (by id) with ``columns`` and a SIG column for each from ``sources`` (id, column, value).

    Sources count in their order. ``classes`` (id, class_id) names the row of each member's class: where a member has no value of its own,
    that of its class row is copied, and so is the error. A value without an error gets the error 0; neither gives NULL.
    """
    names = [n for c in columns for n in (c, f"SIG{c}")]
    wide = ranked_union(sources).groupBy("id").pivot("column", names).agg(F.first("value"))
    own = master.join(wide, "id", "left").join(classes, "id", "left")
    shared = wide.select(F.col("id").alias("class_id"), *[F.col(n).alias(f"_{n}") for n in names])
    both = own.join(shared, "class_id", "left")
    out = {}
    for c in columns:
        mine = F.col(c).isNotNull()
        out[c] = F.coalesce(c, f"_{c}")
        error = F.when(mine, F.col(f"SIG{c}")).otherwise(F.col(f"_SIG{c}"))
        out[f"SIG{c}"] = F.when(mine | F.col(f"_{c}").isNotNull(), F.coalesce(error, F.lit(0.0)))
    return both.select(*master.columns, *[e.alias(n) for n, e in out.items()])


def fill_from_members(rows: DataFrame, columns: Sequence[str], id_col: str = "id", class_col: str = "class_id") -> DataFrame:
    """Aggregate rows (those without a class) take what they lack from their members: the mean, and as SIG column the standard error of the
    members, or the one member's own error. Values that are there stay.
    """
    of = rows.filter(F.col(class_col).isNotNull())
    stats = []
    for c in columns:
        one = F.count(c) == 1
        stats += [F.avg(c).alias(f"_{c}"), F.when(one, F.max(F.when(F.col(c).isNotNull(), F.col(f"SIG{c}")))).otherwise(sem(F.col(c))).alias(f"_SIG{c}")]
    means = of.groupBy(F.col(class_col).alias(id_col)).agg(*stats)
    joined = rows.join(means, id_col, "left")
    lacks = {c: F.col(class_col).isNull() & F.col(c).isNull() for c in columns}
    out = {n: F.when(lacks[c], F.col(f"_{n}")).otherwise(F.col(n)) for c in columns for n in (c, f"SIG{c}")}
    return joined.select(*[out[n].alias(n) if n in out else n for n in rows.columns])
