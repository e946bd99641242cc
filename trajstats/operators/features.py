"""Feature ranking, clustering in two principal components, and its validation.

Unit tables (one row per compound, user or document) come from distributed roll-ups.
``cluster_two`` runs on Spark ML and takes tables of any size. Validation repeats small
fits on unit tables: every repeat is one group, and groups spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from trajstats.functions.draws import uniform
from trajstats.session import cut_lineage, group_side

FLAT = 1e-9
FOLD_PARTS = 32


# --- ranking ---------------------------------------------------------------------------

def ranked_features(units: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """|Pearson r| of every feature with the label, and its rank; constant features score 0.

    One pass: the table is unpivoted inside the row and aggregated with partials.
    """
    long = units.select(*keys, F.col(label).cast("double").alias("_y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s"))
    x = F.col("s.x")
    r = F.when(F.stddev_pop(x) < FLAT, 0.0).otherwise(F.abs(F.try_divide(F.covar_pop(x, F.col("_y")), F.stddev_pop(x) * F.stddev_pop("_y"))))
    scores = long.groupBy(*keys, F.col("s.feature").alias("feature")).agg(F.coalesce(r, F.lit(0.0)).alias("r"))
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("r", 12)), "feature")))


# --- Spark ML form ---------------------------------------------------------------------

def _scaled(units: DataFrame, features: Sequence[str]) -> DataFrame:
    """Vector column ``z``: features over their population standard deviation, centred."""
    from pyspark.ml.stat import Summarizer

    rows = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(units)
    n = rows.select(Summarizer.metrics("count").summary(F.col("_v")).alias("s")).select("s.count").first()[0]
    model = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(rows)
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    return ElementwiseProduct(inputCol="_z", outputCol="z", scalingVec=Vectors.dense([factor] * len(features))).transform(model.transform(rows)).drop("_v", "_z")


def cluster_two(units: DataFrame, features: Sequence[str], seeds: Sequence[int] = tuple(range(5))) -> DataFrame:
    """Standardise, project on two components, split in two clusters; the best of the seeds."""
    scaled = _scaled(units, features)
    reduced = PCA(k=min(2, len(features)), inputCol="z", outputCol="pc").fit(scaled).transform(scaled)
    reduced = reduced.persist()
    best = None
    for seed in seeds:
        model = KMeans(k=2, featuresCol="pc", predictionCol="cluster", seed=seed, maxIter=400).fit(reduced)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    out = best.transform(reduced).withColumn("pc1", vector_to_array("pc")[0])
    return out.withColumn("pc2", vector_to_array("pc")[1] if len(features) > 1 else F.lit(0.0)).drop("z", "pc")


def loadings(units: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(feature, component, loading) and (component, explained share) of the standardised table.

    The matrices are features by components; only they pass through the driver. Signs are
    set so that the largest loading of a component is positive.
    """
    spark = units.sparkSession
    k = len(features)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(_scaled(units, features))
    pc = model.pc.toArray()
    pc = pc * np.where(pc[np.abs(pc).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    table = [(features[i], j + 1, float(pc[i, j])) for i in range(k) for j in range(k)]
    spectrum = [(j + 1, float(v)) for j, v in enumerate(model.explainedVariance.toArray())]
    return spark.createDataFrame(table, "feature string, component int, loading double"), spark.createDataFrame(spectrum, "component int, share double")


def confusion(rows: DataFrame, keys: Sequence[str], label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Accuracy under the better of the two cluster namings, recalls, balanced accuracy, error rates."""
    y, c = F.col(label).cast("int"), F.col(cluster).cast("int")
    counts = rows.groupBy(*keys).agg(*[F.count(F.when((y == a) & (c == b), 1)).alias(f"_{a}{b}") for a in (0, 1) for b in (0, 1)], F.count(F.lit(1)).alias("n"))
    flip = F.col("_01") + F.col("_10") > F.col("_00") + F.col("_11")
    tn, fp, fn, tp = (F.when(flip, F.col(b)).otherwise(F.col(a)) for a, b in (("_00", "_01"), ("_01", "_00"), ("_10", "_11"), ("_11", "_10")))
    out = counts.select(*keys, "n", flip.alias("flipped"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    out = out.withColumns({
        "accuracy": (tp + tn) / F.col("n"), "recall_1": F.when(tp + fn > 0, tp / (tp + fn)), "recall_0": F.when(tn + fp > 0, tn / (tn + fp)),
        "fp_rate": F.when(tn + fp > 0, fp / (tn + fp)), "fn_rate": F.when(tp + fn > 0, fn / (tp + fn)),
    })
    return out.withColumn("balanced_accuracy", (F.col("recall_1") + F.col("recall_0")) / 2)


def standardised(units: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Features centred and divided by their population standard deviation (constant ones become 0)."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))]
    stats = units.groupBy(*keys).agg(*aggs) if keys else units.agg(*aggs)
    joined = units.join(stats, list(keys)) if keys else units.crossJoin(F.broadcast(stats))
    scaled = {f: F.when(F.col(f"_s_{f}") > 0, (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).otherwise(0.0) for f in features}
    return joined.withColumns(scaled).drop(*[f"_{p}_{f}" for f in features for p in "ms"])


#: Blocks that points are dealt to at least, most points of a block (of few clusters), and the piece of an array of distances that stays in the cache.
BLOCKS, BLOCK_ROWS, PIECE = 16, 65_536, (64, 1024)


def silhouette(rows: DataFrame, id_col: str, features: Sequence[str], cluster: str, tile_rows: int = 512) -> DataFrame:
    """Exact Euclidean silhouette (id, cluster, s).

    Rows with the same features and cluster are one point of that weight. Points are dealt to blocks, and a task sums the distances
    of two blocks per point and cluster. A point is copied once for each block, so rows sent grow with the points
    times the blocks, and a task holds two blocks; only the distances computed grow with the square of the points.
    As in SQL, a row without cluster counts for none, and one without a feature counts as a member at no distance; both have s = 0.
    """
    kind = rows.schema[cluster].dataType.simpleString()
    # Written first: features that are computed twice may differ in their last digits and not be found again.
    rows = cut_lineage(rows.select(id_col, cluster, *features))
    members = rows.filter(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("_other")).agg(F.count(F.lit(1)).alias("_n"))
    point = [cluster, *features]
    whole = rows
    for c in point:
        whole = whole.filter(F.col(c).isNotNull())
    points = cut_lineage(whole.groupBy(*point).agg(F.count(F.lit(1)).cast("double").alias("_w")).withColumn("_p", F.monotonically_increasing_id()))
    size = points.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cluster).alias("k")).first()
    blocks = _blocks(size["n"], size["k"], tile_rows)
    totals = _block_pairs(points, ["_p", "_w", *point], size["n"], blocks, tile_rows).groupBy("part", "pair").applyInArrow(_distance_totals(cluster, features), f"_p long, _other {kind}, _total double")
    totals = totals.groupBy("_p", "_other").agg(F.sum("_total").alias("_total")).join(group_side(members), "_other")
    totals = totals.groupBy("_p").agg(F.collect_list(F.struct("_other", "_total", "_n")).alias("_t"))
    # An id may stand in several rows: these count together.
    parts = rows.join(points.join(totals, "_p").select(*point, "_t"), point, "left").select(F.col(id_col).alias("id"), F.col(cluster).alias("own"), F.explode_outer("_t").alias("_t"))
    parts = parts.groupBy("id", "own", F.col("_t._other").alias("other_cluster")).agg(F.sum("_t._total").alias("total"), F.sum("_t._n").alias("n"))
    own = F.col("own") == F.col("other_cluster")
    ab = parts.groupBy("id", "own").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    s = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)).otherwise(0.0)
    return ab.select(F.col("id").alias(id_col), F.col("own").alias(cluster), s.alias("s"))


def _blocks(n: int, k: int, tile_rows: int) -> int:
    """Blocks for ``n`` points of ``k`` clusters: a block and its sums by cluster take a few MB."""
    most = max(tile_rows, BLOCK_ROWS * 8 // max(k, 8))
    return max(1, min(BLOCKS, math.ceil(n / tile_rows)), math.ceil(n / most))


def _block_pairs(points: DataFrame, cols: Sequence[str], n: int, blocks: int, tile_rows: int) -> DataFrame:
    """Tiles of the points, a copy for each pair of blocks that their block is in: (part, pair, low, diagonal, one array per column).

    Pairs have numbers, and each of them has a partition of its own as far as there are that many.
    """
    tiles = blocks * max(1, math.ceil(n / blocks / tile_rows))
    packed = points.groupBy(F.pmod(F.xxhash64("_p"), F.lit(tiles)).cast("int").alias("_tile")).agg(F.collect_list(F.struct(*cols)).alias("_s"))
    at, with_ = F.col("_tile") % blocks, F.col("_with")
    copies = packed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least(at, with_), F.greatest(at, with_)
    pair = (high * (high + 1) / 2 + low).cast("int")
    parts = min(blocks * (blocks + 1) // 2, 4096)
    copies = copies.select((pair % parts).alias("part"), pair.alias("pair"), (at == low).alias("low"), (at == with_).alias("diagonal"), *[F.col(f"_s.{c}").alias(c) for c in cols])
    return copies.repartitionById(parts, F.col("part"))


def _distance_totals(cluster: str, features: Sequence[str]):
    """For two blocks: the sums of the distances of each point to the points of each cluster of the other block."""

    def block(tiles: pa.Table) -> tuple:
        """Points in the order of their clusters."""
        flat = lambda c: pa.concat_arrays([x.flatten() for x in tiles[c].chunks])
        names = flat(cluster).dictionary_encode()
        codes = names.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        take = lambda c: flat(c).to_numpy(zero_copy_only=False)[order]
        return take("_p"), take("_w"), codes[order], names.dictionary, [take(f).astype(float) for f in features]

    def pieces(w: np.ndarray, codes: np.ndarray, step: int) -> list[tuple]:
        """(first and last row, first and last cluster, weights by cluster) of every piece."""
        out = []
        for i in range(0, len(w), step):
            c = codes[i: i + step]
            weights = np.zeros((len(c), c[-1] - c[0] + 1))
            weights[np.arange(len(c)), c - c[0]] = w[i: i + step]
            out.append((i, i + len(c), c[0], c[-1] + 1, weights))
        return out

    def sums(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(points of a, clusters of b) and (clusters of a, points of b)."""
        (_, wa, ca, ka, xs), (_, wb, cb, kb, ys) = a, b
        to_b, to_a = np.zeros((len(wa), len(kb))), np.zeros((len(ka), len(wb)))
        right = pieces(wb, cb, PIECE[1])
        square, step = np.empty(PIECE), np.empty(PIECE)
        for i, i1, u, u1, left_weights in pieces(wa, ca, PIECE[0]):
            left = [x[i:i1, None] for x in xs]
            for j, j1, v, v1, right_weights in right:
                d, e = square.ravel()[: (i1 - i) * (j1 - j)].reshape(i1 - i, j1 - j), step.ravel()[: (i1 - i) * (j1 - j)].reshape(i1 - i, j1 - j)
                for f, (x, y) in enumerate(zip(left, ys)):
                    part = e if f else d
                    np.subtract(x, y[j:j1], out=part)
                    np.multiply(part, part, out=part)
                    if f:
                        np.add(d, part, out=d)
                np.sqrt(d, out=d)
                to_b[i:i1, v:v1] += d @ right_weights
                to_a[u:u1, j:j1] += left_weights.T @ d
        return to_b, to_a

    def long(p: np.ndarray, names: pa.Array, totals: np.ndarray) -> pa.Table:
        """One row for a point and a cluster."""
        other = names.take(pa.array(np.repeat(np.arange(len(names)), len(p))))
        return pa.table({"_p": np.tile(p, len(names)), "_other": other, "_total": totals.ravel()})

    def one(pair: pa.Table) -> pa.Table:
        low, high = pair.filter(pair["low"]), pair.filter(pc.invert(pair["low"]))
        if pair["diagonal"][0].as_py():
            a = block(low)
            return long(a[0], a[3], sums(a, a)[0].T)
        if not len(low) or not len(high):  # no point in one of the blocks
            return long(np.empty(0, np.int64), pair[cluster].combine_chunks().flatten()[:0], np.empty(0))
        a, b = block(low), block(high)
        to_b, to_a = sums(a, b)
        return pa.concat_tables([long(a[0], b[3], to_b.T), long(b[0], a[3], to_a)])

    return one


# --- repeated small fits on unit tables -------------------------------------------------

def _fit_two(x: np.ndarray, seed: int, starts: int = 20):
    """Scale, project and split one small table; gives a function that labels new rows."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mean) / sd
    _, vectors = np.linalg.eigh(np.cov(z.T, ddof=0).reshape(z.shape[1], z.shape[1]))
    axes = vectors[:, ::-1][:, :2]
    p = z @ axes
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        c = p[rng.choice(len(p), 2, replace=False)]
        for _ in range(400):
            lab = ((p[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([p[lab == k].mean(axis=0) if (lab == k).any() else c[k] for k in (0, 1)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        cost = ((p - c[lab]) ** 2).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, c)
    centres = best[1]
    return lambda rows: ((((rows - mean) / sd @ axes)[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def _accuracy(pred: np.ndarray, y: np.ndarray) -> float:
    hit = float(np.mean(pred == y))
    return max(hit, 1 - hit)


def _top(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Feature order by |r| with the label, best first; constant features last."""
    with np.errstate(all="ignore"):
        r = np.array([abs(np.corrcoef(x[:, j], y)[0, 1]) if x[:, j].std() >= FLAT else 0.0 for j in range(x.shape[1])])
    return np.argsort(-np.nan_to_num(r), kind="stable")


def _repeat(units: DataFrame, repeats: DataFrame, key: Sequence[str], features: Sequence[str], label: str, id_col: str, run, schema: str) -> DataFrame:
    """Send the unit table to every repeat and run one small fit per repeat group."""
    rows = units.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"), *features).dropna()
    spread = F.broadcast(repeats)  # a list of repeats made from ranges, bounded by construction
    keys = ", ".join(f"{k} {repeats.schema[k].dataType.simpleString()}" for k in key)
    names = [part.split()[0] for part in schema.split(",")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        found = run(pdf, pdf[list(features)].to_numpy(float), pdf["_y"].to_numpy(int), {k: pdf[k].iloc[0] for k in key})
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in key} | row for row in found], columns=[*key, *names])

    return rows.crossJoin(spread).groupBy(*key).applyInPandas(one, f"{keys}, {schema}")


def seed_sweep(units: DataFrame, features: Sequence[str], label: str, id_col: str, n_seeds: int) -> DataFrame:
    """(seed, accuracy) of the two-cluster split for many seeds."""
    seeds = units.sparkSession.range(n_seeds).withColumnRenamed("id", "seed")
    return _repeat(units, seeds, ["seed"], features, label, id_col, lambda pdf, x, y, k: [{"accuracy": _accuracy(_fit_two(x, int(k["seed"]))(x), y)}], "accuracy double")


def prefix_sweep(units: DataFrame, features: Sequence[str], label: str, id_col: str, seed: int = 0) -> DataFrame:
    """(kind, k, feature, accuracy): every feature alone, and the top-k prefixes of the ranking."""
    tries = units.sparkSession.range(1, len(features) + 1).withColumnRenamed("id", "k")
    tries = tries.withColumn("kind", F.explode(F.array(F.lit("single"), F.lit("top"))))

    def run(pdf, x, y, key):
        order = _top(x, y)
        pick = order[int(key["k"]) - 1: int(key["k"])] if key["kind"] == "single" else order[: int(key["k"])]
        return [{"feature": features[order[int(key["k"]) - 1]], "accuracy": _accuracy(_fit_two(x[:, pick], seed)(x[:, pick]), y)}]

    return _repeat(units, tries, ["kind", "k"], features, label, id_col, run, "feature string, accuracy double")


def leave_one_out(units: DataFrame, features: Sequence[str], label: str, id_col: str, n_seeds: int = 1, reselect: int = 0) -> DataFrame:
    """(held, seed, label, predicted, correct): each unit predicted by a fit of the others.

    With ``reselect`` the best of the top-2 ... top-``reselect`` prefixes is chosen again
    inside every fold.
    """
    rows = units.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"), *features).dropna().withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(FOLD_PARTS)).cast("int"))
    work = units.sparkSession.range(FOLD_PARTS * n_seeds).select((F.col("id") % FOLD_PARTS).cast("int").alias("part"), F.floor(F.col("id") / FOLD_PARTS).alias("seed"))
    kind = units.schema[id_col].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id").reset_index(drop=True)
        seed = int(pdf["seed"].iloc[0])
        x, y = pdf[list(features)].to_numpy(float), pdf["_y"].to_numpy(int)
        out = []
        for h in np.flatnonzero(pdf["_part"] == pdf["part"].iloc[0]):
            keep = np.arange(len(y)) != h
            xs, ys = x[keep], y[keep]
            pick = np.arange(x.shape[1])
            if reselect:
                order = _top(xs, ys)
                prefixes = [order[:k] for k in range(2, min(reselect, x.shape[1]) + 1)]
                pick = max(prefixes, key=lambda p: _accuracy(_fit_two(xs[:, p], seed)(xs[:, p]), ys))
            fit = _fit_two(xs[:, pick], seed)
            inside, guess = fit(xs[:, pick]), int(fit(x[[h]][:, pick])[0])
            guess = 1 - guess if np.mean(inside != ys) > np.mean(inside == ys) else guess
            out.append({"held": pdf["_id"].iloc[h], "seed": seed, "label": int(y[h]), "predicted": guess, "correct": guess == y[h]})
        return pd.DataFrame(out, columns=["held", "seed", "label", "predicted", "correct"])

    # The list of parts is bounded; each part gets the unit table once, not once per fold.
    return rows.crossJoin(F.broadcast(work)).groupBy("part", "seed").applyInPandas(one, f"held {kind}, seed long, label int, predicted int, correct boolean")


def fold_clusters(units: DataFrame, features: Sequence[str], label: str, id_col: str, seed: int = 0, starts: int = 20) -> DataFrame:
    """(held, unit, cluster): for every held-out unit the clusters of a fit of the others, its own included."""
    rows = units.select(F.col(id_col).alias("_id"), F.col(label).alias("_y"), *features).dropna().withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(FOLD_PARTS)).cast("int"))
    parts = units.sparkSession.range(FOLD_PARTS).select(F.col("id").cast("int").alias("part"))
    kind = units.schema[id_col].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id").reset_index(drop=True)
        x, out = pdf[list(features)].to_numpy(float), []
        for h in np.flatnonzero(pdf["_part"] == pdf["part"].iloc[0]):
            found = _fit_two(x[np.arange(len(x)) != h], seed, starts)(x)
            out.append(pd.DataFrame({"held": pdf["_id"].iloc[h], "unit": pdf["_id"], "cluster": found.astype(int)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["held", "unit", "cluster"])

    return rows.crossJoin(F.broadcast(parts)).groupBy("part").applyInPandas(one, f"held {kind}, unit {kind}, cluster int")


def shuffled_labels(units: DataFrame, label: str, id_col: str, n_perm: int, seed: int) -> DataFrame:
    """(permutation, unit, label): the labels dealt anew by hashed draws, -1 as they are."""
    rows = units.select(F.col(id_col).alias("unit"), F.col(label).cast("int").alias("label")).withColumn("i", F.row_number().over(W.orderBy("unit")))
    perms = rows.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    drawn = perms.withColumn("place", F.row_number().over(W.partitionBy("permutation").orderBy(uniform(F.lit(seed), F.col("permutation"), F.col("i")), "i")))
    dealt = drawn.select("permutation", "unit", "place").join(rows.select(F.col("i").alias("place"), "label"), "place").select("permutation", "unit", "label")
    return dealt.unionByName(rows.select(F.lit(-1).alias("permutation"), "unit", "label"))


def permutation_null(units: DataFrame, features: Sequence[str], label: str, id_col: str, n_perm: int, seed: int = 42, top: int = 0, starts: int = 20) -> DataFrame:
    """(permutation, accuracy): leave-one-out accuracy with shuffled labels; permutation -1 keeps them.

    Clusters don't depend on labels: each fold is fitted once, and the labels of all permutations are held against its clusters by
    joins and sums. With ``top`` the score is the best in-sample accuracy over the top-2 ... top-``top`` prefixes.
    """
    if top:
        perms = units.sparkSession.range(-1, n_perm).withColumnRenamed("id", "permutation")

        def run(pdf, x, y, key):
            k = int(key["permutation"])
            yy = y if k < 0 else np.random.default_rng([seed, k]).permutation(y)
            order = _top(x, yy)
            return [{"accuracy": max(_accuracy(_fit_two(x[:, order[:m]], seed)(x[:, order[:m]]), yy) for m in range(2, min(top, x.shape[1]) + 1))}]

        return _repeat(units, perms, ["permutation"], features, label, id_col, run, "accuracy double")
    used = units.select(id_col, label, *features).dropna()
    clusters = cut_lineage(fold_clusters(used, features, label, id_col, starts=starts))
    met = clusters.join(shuffled_labels(used, label, id_col, n_perm, seed), "unit")
    own, same = F.col("unit") == F.col("held"), F.col("cluster") == F.col("label")
    folds = met.groupBy("permutation", "held").agg(
        F.count(F.when(~own & same, 1)).alias("same"), F.count(F.when(~own & ~same, 1)).alias("other"), F.max(F.when(own, same)).alias("hit"))
    hit = F.when(F.col("other") > F.col("same"), ~F.col("hit")).otherwise(F.col("hit"))
    return folds.groupBy("permutation").agg(F.avg(hit.cast("double")).alias("accuracy"))


def permutation_p_value(null: DataFrame) -> DataFrame:
    """p = (number at least as good + 1) / (permutations + 1)."""
    observed = null.filter("permutation < 0").select(F.col("accuracy").alias("observed"))
    perm = null.filter("permutation >= 0").crossJoin(F.broadcast(observed))
    better = F.count(F.when(F.col("accuracy") >= F.col("observed"), 1))
    return perm.agg(F.max("observed").alias("observed"), F.avg("accuracy").alias("null_mean"), F.percentile("accuracy", 0.95).alias("null_p95"), ((better + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("n_perm"))


def transfer_matrix(units: DataFrame, set_col: str, sets: Sequence, features: Sequence[str], label: str, id_col: str, top: int = 3, seed: int = 0) -> DataFrame:
    """(source, target, features, accuracy): features ranked on one set, clustering scored on another."""
    spark = units.sparkSession
    rows = units.select(F.col(set_col).alias("_set"), F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"), *features).dropna()
    pairs = spark.createDataFrame([(s, t) for s in sets for t in sets], ["source", "target"])
    kind = pairs.schema["source"].dataType.simpleString()
    tagged = rows.join(F.broadcast(pairs), (F.col("_set") == F.col("source")) | (F.col("_set") == F.col("target")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        source, target = pdf["source"].iloc[0], pdf["target"].iloc[0]
        a, b = pdf[pdf["_set"] == source], pdf[pdf["_set"] == target]
        pick = [features[k] for k in _top(a[list(features)].to_numpy(float), a["_y"].to_numpy(int))[:top]]
        x = b[pick].to_numpy(float)
        acc = _accuracy(_fit_two(x, seed)(x), b["_y"].to_numpy(int)) if len(b) > 2 else None
        return pd.DataFrame([{"source": source, "target": target, "features": ";".join(pick), "n": len(b), "accuracy": acc}])

    return tagged.groupBy("source", "target").applyInPandas(one, f"source {kind}, target {kind}, features string, n long, accuracy double")


def forward_regression(rows: DataFrame, features: Sequence[str], target: str, id_col: str, max_features: int = 3, trees: int = 20, seed: int = 0) -> DataFrame:
    """Forward selection by a random forest: (step, feature, r2, mae) on a held-out fifth of the rows.

    Rows go to the held-out part by a hash of their id. Candidates are tried one by one;
    every fit is a distributed Spark ML fit.
    """
    part = F.pmod(F.xxhash64(id_col), F.lit(5)) == 0
    data = rows.select(id_col, target, *features).dropna().withColumn("_test", part).persist()
    train, test = data.filter("NOT _test"), data.filter("_test")
    chosen: list[str] = []
    trace = []
    for step in range(min(max_features, len(features))):
        scores = []
        for f in features:
            if f in chosen:
                continue
            assembler = VectorAssembler(inputCols=[*chosen, f], outputCol="_x")
            model = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, seed=seed).fit(assembler.transform(train))
            pred = model.transform(assembler.transform(test))
            scores.append((RegressionEvaluator(labelCol=target, metricName="r2").evaluate(pred), RegressionEvaluator(labelCol=target, metricName="mae").evaluate(pred), f))
        r2, mae, f = max(scores)
        chosen.append(f)
        trace.append((step + 1, f, float(r2), float(mae)))
    data.unpersist()
    return rows.sparkSession.createDataFrame(trace, "step int, feature string, r2 double, mae double")
