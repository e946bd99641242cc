"""Time-correlation-corrected statistics of windowed observable series.

Input rows are window values: raw frames were reduced before, with map-side partial
aggregation, so a series holds as many rows as there are windows, however hot its
source is. After the first exchange on the series keys every later grouping here adds
columns to those keys, so Spark reuses that partitioning instead of shuffling again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from trajstats.functions.stats import finite, sem, t_multiplier
from trajstats.session import cut_lineage


def positioned(df: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Finite values with their position ``i`` in the series and its length ``n``."""
    w = W.partitionBy(*keys)
    return (
        df.select(*keys, F.col(order).alias("idx"), finite(F.col(value).cast("double")).alias("value"))
        .filter("value IS NOT NULL")
        .select("*", (F.row_number().over(w.orderBy("idx")) - 1).alias("i"), F.count(F.lit(1)).over(w).cast("int").alias("n"))
    )


def winsorized(df: DataFrame, keys: Sequence[str], pct: float = 5.0, value: str = "value") -> DataFrame:
    """Clip to the pct and 100-pct percentiles of the series (left alone below 3 values)."""
    w = W.partitionBy(*keys)
    q = F.percentile(F.col(value), F.array(F.lit(pct / 100), F.lit(1 - pct / 100))).over(w)
    bounds = df.withColumn("_q", q).withColumn("_m", F.count(value).over(w))
    clipped = F.greatest(F.least(F.col(value), F.col("_q")[1]), F.col("_q")[0])
    return bounds.withColumn(value, F.when(F.col("_m") >= 3, clipped).otherwise(F.col(value))).drop("_q", "_m")


def block_means(pos: DataFrame, keys: Sequence[str], max_block: int = 9) -> DataFrame:
    """(keys, n, b, offset, block_mean) for every b up to ``max_block``, every offset; partial blocks are dropped.

    A block mean is a difference of running sums, so a row is copied once per size, whatever the
    offsets, and all stays in the partitioning of the series.
    """
    w = W.partitionBy(*keys).orderBy("i")
    total = pos.withColumn("_s", F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = F.array(*[F.struct(F.lit(b).alias("b"), F.lead("_s", b - 1).over(w).alias("e")) for b in range(1, max_block + 1)])
    at = total.withColumn("_e", ends).select(*keys, "n", "i", "value", "_s", F.explode("_e").alias("_e")).filter("_e.e IS NOT NULL")
    return at.select(*keys, "n", F.col("_e.b").alias("b"), F.expr("i % _e.b").alias("offset"), F.expr("i div _e.b").alias("block"), ((F.col("_e.e") - F.col("_s") + F.col("value")) / F.col("_e.b")).alias("block_mean"))


def sized_block_means(pos: DataFrame, keys: Sequence[str], sizes: F.Column) -> DataFrame:
    """As ``block_means``, for sizes that depend on the row: the end of each block is joined by its position."""
    total = pos.withColumn("_s", F.sum("value").over(W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    ends = total.select(*keys, (F.col("i") + 1).alias("_end"), F.col("_s").alias("_e"))
    starts = total.withColumn("b", F.explode(sizes)).filter("i + b <= n").withColumn("_end", F.col("i") + F.col("b"))
    mean = (F.col("_e") - F.col("_s") + F.col("value")) / F.col("b")
    return starts.join(ends, [*keys, "_end"]).select(*keys, "n", "b", F.expr("i % b").alias("offset"), mean.alias("block_mean"))


def superblock_offsets(pos: DataFrame, keys: Sequence[str], max_block: int = 9, min_blocks: int = 4) -> DataFrame:
    """Mean, sd and SEM of block means per (b, offset) with at least two blocks."""
    m = F.col("block_mean")
    return (
        block_means(pos, keys, max_block)
        .groupBy(*keys, "n", "b", "offset")
        .agg(F.count(m).alias("n_blocks"), F.avg(m).alias("mean_blocks"), F.stddev_samp(m).alias("sd_blocks"), sem(m).alias("se_blocks"))
        .filter("n_blocks >= 2")
        .withColumn("eligible", F.col("n_blocks") >= min_blocks)
    )


def superblock_summary(offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per b: mean, median, min and max SEM, and the median over eligible offsets (else all)."""
    se, ok = F.col("se_blocks"), F.col("eligible")
    return offsets.groupBy(*keys, "n", "b").agg(
        F.count(se).alias("n_offsets"),
        F.count(F.when(ok, se)).alias("n_eligible"),
        F.avg(se).alias("se_mean"),
        F.median(se).alias("se_median"),
        F.min(se).alias("se_min"),
        F.max(se).alias("se_max"),
        F.coalesce(F.median(F.when(ok, se)), F.median(se)).alias("se_choice"),
    )


def plateau_block(summary: DataFrame, keys: Sequence[str], fraction: float = 0.95) -> DataFrame:
    """Smallest b whose running-maximum SEM reaches ``fraction`` of the plateau.

    Also gives the plateau and the largest tabulated b; without any eligible size the
    largest b is the choice.
    """
    w = W.partitionBy(*keys)
    good = F.when(F.col("n_eligible") > 0, F.col("se_choice"))
    env = (
        summary.withColumn("envelope", F.when(good.isNotNull(), F.max(good).over(w.orderBy("b").rowsBetween(W.unboundedPreceding, 0))))
        .withColumn("plateau", F.max(good).over(w))
    )
    hit = F.when(F.col("envelope") >= F.lit(fraction) * F.col("plateau"), F.col("b"))
    return env.groupBy(*keys).agg(
        F.max("plateau").alias("plateau"),
        F.max("b").alias("b_max"),
        F.coalesce(F.min(hit), F.max("b")).alias("b_plateau"),
    )


def autocorrelation(pos: DataFrame, keys: Sequence[str], max_lag: int | None = None) -> DataFrame:
    """(keys, n, lag, acf): lag products of centred values over their sum of squares.

    A lag is an equi-join on the position, so the products of one series spread over
    all tasks. Lag pairs of a constant series come out NULL.
    """
    w = W.partitionBy(*keys)
    centred = pos.withColumn("c", F.col("value") - F.avg("value").over(w))
    top = F.col("n") - 1 if max_lag is None else F.least(F.col("n") - 1, F.lit(max_lag))
    left = centred.withColumn("lag", F.explode(F.sequence(F.lit(0), top))).filter("i + lag < n")
    left = left.select(*keys, "n", "lag", "c", (F.col("i") + F.col("lag")).alias("i"))
    right = centred.select(*keys, "i", F.col("c").alias("c2"))
    products = left.join(right, [*keys, "i"]).groupBy(*keys, "n", "lag").agg(F.sum(F.col("c") * F.col("c2")).alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(w)
    return products.select(*keys, "n", "lag", F.when(zero > 0, F.col("s") / zero).when(F.col("lag") == 0, 1.0).alias("acf"))


def inefficiency(acf: DataFrame, keys: Sequence[str], min_lag: int = 3) -> DataFrame:
    """Statistical inefficiency g = 1 + 2*sum(acf) up to the first non-positive lag beyond 3.

    The (1 - t/n) weight cancels against the n/(n-t) of the unbiased estimate.
    """
    w = W.partitionBy(*keys)
    stop = F.min(F.when((F.col("lag") > min_lag) & (F.col("acf") <= 0), F.col("lag"))).over(w)
    used = acf.withColumn("_stop", stop).filter("lag = 0 OR (lag <= n - 2 AND (_stop IS NULL OR lag < _stop))")
    g = F.greatest(F.lit(1.0), F.lit(1.0) + 2 * F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf"))), F.lit(0.0)))
    return used.groupBy(*keys).agg(F.max("n").alias("n"), g.alias("g")).select(
        "*", ((F.col("g") - 1) / 2).alias("tau"), (F.col("n") / F.col("g")).alias("n_eff")
    )


def series_inefficiency(pos: DataFrame, keys: Sequence[str], min_lag: int = 3, first: int = 64) -> DataFrame:
    """``inefficiency`` of each series without its whole autocorrelation.

    Lags come in blocks of ``first``, then twice as many, and so on. A series leaves as soon as its sum has stopped, so a series of n
    rows that decorrelates after m lags costs about n * m products instead of n^2 / 2.
    """
    keys = list(keys)
    w = W.partitionBy(*keys)
    centred = cut_lineage(pos.select(*keys, "n", "i", (F.col("value") - F.avg("value").over(w)).alias("c")))
    live = centred.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s0"), F.lit(0.0).alias("total"))
    live = cut_lineage(live.withColumn("done", (F.col("s0") <= 0) | (F.col("n") < 3)))
    out, low, size = live.filter("done"), 1, first
    live = live.filter("NOT done")
    while not live.isEmpty():
        high = low + size - 1
        rows = centred.join(live.select(*keys), keys)
        left = rows.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)))).filter("lag <= n - 2 AND i + lag < n")
        left = left.select(*keys, "lag", "c", (F.col("i") + F.col("lag")).alias("i"))
        sums = left.join(rows.select(*keys, "i", F.col("c").alias("c2")), [*keys, "i"]).groupBy(*keys, "lag").agg(F.sum(F.col("c") * F.col("c2")).alias("s"))
        acf = sums.join(live, keys).withColumn("acf", F.col("s") / F.col("s0"))
        stop = acf.groupBy(*keys).agg(F.min(F.when((F.col("lag") > min_lag) & (F.col("acf") <= 0), F.col("lag"))).alias("stop"))
        more = acf.join(stop, keys).groupBy(*keys, "stop").agg(F.sum(F.when(F.col("stop").isNull() | (F.col("lag") < F.col("stop")), F.col("acf"))).alias("more"))
        state = live.join(more, keys, "left").select(*keys, "n", "s0", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("stop").isNotNull() | (F.col("n") - 2 <= high)).alias("done"))
        state = cut_lineage(state)
        out, live, low, size = out.unionByName(state.filter("done")), state.filter("NOT done"), high + 1, size * 2
    g = F.greatest(F.lit(1.0), 1.0 + 2 * F.col("total"))
    return out.select(*keys, "n", g.alias("g")).select("*", ((F.col("g") - 1) / 2).alias("tau"), (F.col("n") / F.col("g")).alias("n_eff"))


def decorrelated(pos: DataFrame, g: DataFrame, keys: Sequence[str], conservative: bool = True) -> DataFrame:
    """Subsample of positions at least g apart: multiples of ceil(g), or rounded multiples of g."""
    joined = pos.join(g.select(*keys, "g"), list(keys))
    if conservative:
        return joined.filter(F.col("i") % F.ceil("g") == 0)
    k = F.floor((F.col("i") + 0.5) / F.col("g"))
    return joined.filter((F.bround(k * F.col("g")) == F.col("i")) | (F.bround((k + 1) * F.col("g")) == F.col("i")))


def equilibration(pos: DataFrame, keys: Sequence[str], min_lag: int = 3) -> DataFrame:
    """Start position that maximises the effective sample size of the rest of the series.

    Every suffix is scored from suffix sums of lag products, so the work is the number
    of rows times the number of probed lags (1, 2, 4, 7, ...), not cubic in the length.
    """
    w = W.partitionBy(*keys)
    tail = W.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    c = pos.withColumn("c", F.col("value") - F.avg("value").over(w))
    suffix = c.select(
        *keys, "n", "i", "c", F.sum("c").over(tail).alias("s1"), F.sum(F.col("c") * F.col("c")).over(tail).alias("s2")
    )
    count = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + 8.0 * (F.col("n") - 1))) / 2).cast("int") + 1
    probe = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct((F.lit(1) + (k * (k - 1) / 2).cast("int")).alias("lag"), k.alias("weight")))
    left = suffix.withColumn("p", F.explode(probe)).select(*keys, "n", "i", "c", "s1", "s2", "p.lag", "p.weight").filter("i + lag < n")
    right = suffix.select(*keys, F.col("i").alias("j"), F.col("c").alias("c2"), F.col("s1").alias("s1_lag"))
    pairs = left.withColumn("j", F.col("i") + F.col("lag")).join(right, [*keys, "j"])
    down = W.partitionBy(*keys, "lag").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    sums = pairs.withColumn("sp", F.sum(F.col("c") * F.col("c2")).over(down)).withColumn("sa", F.sum("c").over(down))
    m = F.col("n") - F.col("i")
    mu = F.col("s1") / m
    var = F.col("s2") / m - mu * mu
    pairs_left = m - F.col("lag")
    corr = (F.col("sp") - mu * (F.col("sa") + F.col("s1_lag")) + pairs_left * mu * mu) / (pairs_left * var)
    scored = sums.filter("lag <= n - i - 2").select(
        *keys, "n", F.col("i").alias("t0"), "lag", "weight", (var <= 1e-300).alias("flat"), F.when(var > 1e-300, corr).alias("corr"), m.alias("m")
    )
    per_start = W.partitionBy(*keys, "t0")
    stop = F.min(F.when((F.col("lag") > min_lag) & (F.col("corr") <= 0), F.col("lag"))).over(per_start)
    term = F.when(F.col("_stop").isNull() | (F.col("lag") < F.col("_stop")), F.col("corr") * (1 - F.col("lag") / F.col("m")) * F.col("weight"))
    g = F.greatest(F.lit(1.0), F.lit(1.0) + 2 * F.coalesce(F.sum(term), F.lit(0.0)))
    starts = (
        scored.withColumn("_stop", stop).groupBy(*keys, "n", "t0", "m")
        .agg(F.when(F.bool_or("flat"), F.max("m") + 1.0).otherwise(g).alias("g"))
        .withColumn("n_eff", (F.col("m") + 1) / F.col("g"))
    )
    best = starts.groupBy(*keys).agg(F.max_by(F.struct("t0", "g", "n_eff", "n"), F.struct(F.round("n_eff", 9), -F.col("t0"))).alias("s"))
    return best.select(*keys, F.col("s.t0").alias("t0"), F.col("s.g").alias("g"), F.col("s.n_eff").alias("n_eff"), (F.col("s.t0") / F.col("s.n")).alias("fraction_discarded"))


def all_offset_estimate(pos: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the full series; SEM as the median over offsets of the block-mean SEM at b."""
    chosen = pos.join(sizes.select(*keys, F.col("b").alias("_b")), list(keys))
    m = F.col("block_mean")
    offsets = (
        sized_block_means(chosen, keys, F.array("_b"))
        .groupBy(*keys, "b", "offset").agg(F.count(m).alias("n_blocks"), F.avg(m).alias("offset_mean"), sem(m).alias("offset_sem"))
    )
    good = F.col("n_blocks") >= 2
    per_series = offsets.groupBy(*keys, "b").agg(
        F.count(F.when(good, 1)).alias("n_offsets"),
        F.median(F.when(good, F.col("offset_sem"))).alias("sem"),
        F.min(F.when(good, F.col("offset_sem"))).alias("sem_min"),
        F.max(F.when(good, F.col("offset_sem"))).alias("sem_max"),
        F.avg(F.when(good, F.col("offset_mean"))).alias("offset_mean"),
        F.coalesce(F.min(F.when(good, F.col("n_blocks"))), F.max("n_blocks")).alias("n_blocks"),
        F.median(F.when(good, F.col("n_blocks"))).alias("n_blocks_median"),
        F.max(F.when(good, F.col("n_blocks"))).alias("n_blocks_max"),
    )
    means = pos.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("n").alias("n"))
    return per_series.join(means, list(keys))


def recommended_block(plateau: DataFrame, g: DataFrame, keys: Sequence[str]) -> DataFrame:
    """b = min(max(plateau block, ceil(g)), largest valid block) and a correlation flag."""
    both = plateau.join(g.select(*keys, "n", "g", "tau", "n_eff"), list(keys), "right")
    b_plateau, b_max = F.coalesce("b_plateau", F.lit(1)), F.coalesce("b_max", F.lit(1))
    b_g = F.ceil("g").cast("int")
    rec = F.least(F.greatest(b_plateau, b_g), b_max)
    flag = (
        F.when((rec == 1) & (b_plateau == 1) & (b_g == 1), "roughly_uncorrelated_at_native_unit")
        .when(rec <= 2, "mild_correlation").otherwise("strong_correlation")
    )
    return both.select(*keys, "n", "g", "tau", "n_eff", b_plateau.alias("b_plateau"), rec.alias("b"), flag.alias("correlation_flag"))


def family_block(recommended: DataFrame, system: Sequence[str], key: str, family: Sequence[str]) -> DataFrame:
    """One block size per system: the largest over a key family, over all keys if none match."""
    inside = F.when(F.col(key).isin(*family), F.col("b"))
    return recommended.groupBy(*system).agg(F.coalesce(F.max(inside), F.max("b")).alias("b"))


def with_interval(df: DataFrame, mean: str = "mean", sem_col: str = "sem", blocks: str = "n_blocks") -> DataFrame:
    """95 % interval with Student's t at blocks - 1 degrees of freedom."""
    out = df.withColumn("t_multiplier", t_multiplier(F.col(blocks) - 1))
    half = F.col("t_multiplier") * F.col(sem_col)
    return out.withColumn("ci_low", F.col(mean) - half).withColumn("ci_high", F.col(mean) + half)


def corrected_series(df: DataFrame, keys: Sequence[str], order: str, value: str = "value", *,
                     winsor_pct: float = 5.0, max_block: int = 9, min_blocks: int = 4, plateau: float = 0.95) -> DataFrame:
    """Winsorise, choose a block size, and report mean, corrected SEM and interval per series."""
    pos = positioned(df, keys, order, value)
    if winsor_pct > 0:
        pos = winsorized(pos, keys, winsor_pct)
    # The raw rows are read once: everything below starts from the written window values.
    pos = cut_lineage(pos)
    summary = superblock_summary(superblock_offsets(pos, keys, max_block, min_blocks), keys)
    g = series_inefficiency(pos, keys)
    sizes = cut_lineage(recommended_block(plateau_block(summary, keys, plateau), g, keys))
    est = all_offset_estimate(pos, sizes, keys).drop("n", "b")
    return with_interval(sizes.join(est, list(keys)))


def corrected_stats(df: DataFrame, keys: Sequence[str], order: str, value: str = "value", *, min_blocks: int = 2, plateau: float = 0.95) -> DataFrame:
    """The one-call form for any series.

    Blocks are tried up to a quarter of the series and capped at half of it; a constant
    series has SEM 0, and where no offset gives two blocks the g-corrected SEM is used.
    """
    pos = cut_lineage(positioned(df, keys, order, value))
    sizes = F.sequence(F.lit(1), F.greatest(F.lit(2), F.expr("n div 4")))
    m = F.col("block_mean")
    offsets = (
        sized_block_means(pos, keys, sizes)
        .groupBy(*keys, "n", "b", "offset").agg(F.count(m).alias("n_blocks"), sem(m).alias("se_blocks"))
        .filter("n_blocks >= 2").withColumn("eligible", F.col("n_blocks") >= min_blocks)
    )
    choice = plateau_block(superblock_summary(offsets, keys), keys, plateau)
    g = series_inefficiency(pos, keys)
    both = g.join(choice, list(keys), "left")
    block = F.greatest(F.lit(1), F.least(F.greatest(F.coalesce("b_plateau", F.lit(1)), F.ceil("g").cast("int")), F.expr("greatest(n div 2, 1)")))
    est = all_offset_estimate(pos, both.withColumn("b", block), keys).join(g.select(*keys, "g"), list(keys))
    flat = (F.col("n") == 1) | (F.col("sd") == 0)
    fallback = F.col("sd") * F.sqrt(F.col("g") / F.col("n"))
    out = est.select(
        *keys, "n", "mean",
        F.when(flat, 0.0).otherwise(F.coalesce("sem", fallback)).alias("sem"),
        F.when(flat, 1.0).otherwise(F.col("g")).alias("g"),
        F.when(flat, 1).otherwise(F.col("b")).cast("int").alias("b"),
        F.when(flat, F.col("n")).when(F.col("sem").isNull(), F.greatest(F.lit(1), F.floor(F.col("n") / F.col("g")))).otherwise(F.col("n_blocks")).cast("long").alias("n_blocks"),
    )
    ci = F.when(F.col("n_blocks") > 1, t_multiplier(F.col("n_blocks") - 1) * F.col("sem"))
    return out.withColumn("ci95", F.when(F.col("sem") == 0, 0.0).otherwise(ci))


def sensitivity(df: DataFrame, keys: Sequence[str], order: str, cutoffs: Sequence[int], value: str = "value", **options) -> DataFrame:
    """Corrected statistics after each cutoff, next to the shift relative to the first cutoff."""
    cuts = df.select(*keys, order, value).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs]))).filter(F.col(order) >= F.col("cutoff"))
    stats = corrected_series(cuts, [*keys, "cutoff"], order, value, **options)
    base = stats.filter(F.col("cutoff") == cutoffs[0]).select(*keys, F.col("mean").alias("base_mean"), F.col("sem").alias("base_sem"))
    return stats.join(base, list(keys), "left").withColumn(
        "relative_shift", F.when(F.abs("base_mean") > 0, (F.col("mean") - F.col("base_mean")) / F.abs("base_mean"))
    )


def ordered_block_sem(df: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Largest block-mean SEM over block sizes up to half the series, and the first b at 95 % of it."""
    pos = positioned(df, keys, order, value).filter("n >= 3")
    sizes = F.filter(F.sequence(F.lit(1), F.expr("cast(n div 2 as int)")), lambda b: F.col("i") % b == 0)  # blocks from the start of the series only
    m = F.col("block_mean")
    sems = (
        sized_block_means(pos, keys, sizes)
        .groupBy(*keys, "b").agg(F.count(m).alias("n_blocks"), sem(m).alias("sem")).filter("sem > 0")
    )
    top = sems.withColumn("top", F.max("sem").over(W.partitionBy(*keys)))
    first = F.min(F.when(F.col("sem") >= 0.95 * F.col("top"), F.struct("b", "n_blocks")))
    return top.groupBy(*keys).agg(F.max("top").alias("sem"), first.alias("f")).select(*keys, "sem", F.col("f.b").alias("b"), F.col("f.n_blocks").alias("n_blocks"))
