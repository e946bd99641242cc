"""Embedding whitening: the leading components of a covariance by a block Jacobi-Davidson method.

The covariance is never formed. ``Covariance.product`` multiplies it with a few columns at once: each task centres its vectors
and adds up y (y . columns), 16 tasks add up these sums, and the driver holds dimension x columns numbers.

1. Rayleigh-Ritz on the subspace gives the wanted pairs of largest eigenvalue and their residuals.
2. Pairs whose residual is at rounding level, in order from the first, are locked.
3. For each other pair the projected correction equation (I - QQ')(V - theta I)(I - QQ') t = -r is solved by a few steps of
   MINRES. Q holds all Ritz vectors of the block. The steps of all pairs share one distributed product.
4. The corrections extend the subspace; a full subspace restarts from its best Ritz vectors.

It ends when all residuals are at double precision, or stay the same at the rounding of the sums.

Entries become x = floor(1024 * c) + 100000; sums of x are exact.

Defined cases: null vectors and vectors with a null or non-finite entry are dropped; of vectors of several lengths those of the
most frequent length stay (the longer of equally frequent ones), empty ones go; entries are clipped to 2^40 in size; null and
repeated ids and repeated rows are rows like all others; ``whitened`` is null for components without variance, ``explained`` where
no component has any, ``identity_error`` is of the others (0 where there are none); fewer than ``count`` dimensions give as
many components; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajstats.llm.common import add_sums, written

SCALE, SHIFT, CLIP = 1024, 100_000, float(1 << 40)
#: Wanted components; columns of the first subspace; its largest size; steps of MINRES a round; rounds.
COMPONENTS, START, LARGEST, STEPS, ROUNDS = 8, 24, 64, 4, 60
#: A residual counts as rounding below this share of the largest eigenvalue.
ROUNDING = 256 * np.finfo(float).eps
#: A component has variance above this share of the trace.
NO_VARIANCE = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, shifts: np.ndarray, basis: np.ndarray, right: np.ndarray, steps: int, enough: float = 0.05) -> np.ndarray:
    """Columns t with (I - QQ')(V - shift I)(I - QQ') t = right, each by its own Lanczos recurrence and Givens rotations; one product a step."""
    out = lambda x: x - basis @ (basis.T @ x)
    k = right.shape[1]
    v = out(right)
    beta = np.linalg.norm(v, axis=0)
    first = beta.copy()
    safe = lambda x: np.where(np.abs(x) > 0, x, 1.0)
    v = v / safe(beta)
    before = np.zeros_like(v)
    t, w1, w2 = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c1, s1, c2, s2 = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    left, link = beta.copy(), np.zeros(k)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        z = out(product(v) - v * shifts)
        alpha = (v * z).sum(0)
        z = z - v * alpha - before * link
        z = out(z - v * (v * z).sum(0))
        beta = np.linalg.norm(z, axis=0)
        # The column (link, alpha, beta) of the tridiagonal matrix after the last two rotations, then its own.
        e, d = s2 * link, c2 * link
        d, g = c1 * d + s1 * alpha, c1 * alpha - s1 * d
        r = np.hypot(g, beta)
        c, s = g / safe(r), beta / safe(r)
        live &= r > 0
        w = (v - w1 * d - w2 * e) / safe(r)
        t = t + np.where(live, w * (c * left), 0.0)
        left = -s * left
        w2, w1 = w1, w
        c2, s2, c1, s1 = c1, s1, c, s
        before, v, link = v, z / safe(beta), beta
        live &= (np.abs(left) > enough * first) & (beta > 1e-14 * first)
    return out(t)


def orthonormal(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Columns that extend ``basis`` by the new directions of ``more``."""
    kept = []
    for x in more.T:
        size = np.linalg.norm(x)
        if not size:
            continue
        x = x / size
        for _ in range(3):
            for b in (basis, *(y[:, None] for y in kept)):
                x = x - b @ (b.T @ x)
        size = np.linalg.norm(x)
        if size > 1e-10:
            kept.append(x / size)
            kept[-1] = kept[-1] - basis @ (basis.T @ kept[-1])
            kept[-1] /= np.linalg.norm(kept[-1])
    return np.array(kept).T if kept else np.zeros((len(more), 0))


def jacobi_davidson(product: Product, size: int, count: int, start: int = START, largest: int = LARGEST, steps: int = STEPS, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, their unit vectors as columns, and the norms of the residuals."""
    count = min(count, size)
    draws = np.random.default_rng(seed)
    basis = np.linalg.qr(draws.normal(size=(size, min(size, max(start, count)))))[0]
    image = product(basis)
    best, stalled = math.inf, 0
    for _ in range(rounds):
        # Rayleigh-Ritz.
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        wanted, vectors = values[:count], basis @ turn[:, :count]
        residual = image @ turn[:, :count] - vectors * wanted
        norms = np.linalg.norm(residual, axis=0)
        limit = ROUNDING * max(abs(values[0]), abs(values[-1]))
        open_ = norms > limit
        worst = float(norms.max())
        stalled = stalled + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        if not open_.any() or basis.shape[1] == size or (stalled >= 3 and worst <= 64 * limit):
            break
        locked = int(np.argmax(open_))
        open_[:locked] = False
        steer = minres(product, wanted[open_], vectors, -residual[:, open_], steps)
        if basis.shape[1] + steer.shape[1] > min(largest, size):
            keep = min(basis.shape[1], count + max(2, start - count))
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
            basis, mixed = np.linalg.qr(basis)
            image = np.linalg.solve(mixed.T, image.T).T
        more = orthonormal(basis, steer)
        if not more.shape[1]:
            more = orthonormal(basis, draws.normal(size=(size, 1)))
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    # Once more by a fresh product, so that nothing that earlier rounds added up is left in the answer.
    vectors = np.linalg.qr(vectors)[0]
    image = product(vectors)
    small = vectors.T @ image
    wanted, turn = np.linalg.eigh((small + small.T) / 2)
    wanted, turn = wanted[::-1], turn[:, ::-1]
    return wanted, vectors @ turn, np.linalg.norm(image @ turn - (vectors @ turn) * wanted, axis=0)


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, size)


def _summed(df: DataFrame, run: Callable) -> np.ndarray:
    """Arrays of all tasks added up: in 16 tasks, then on the driver."""
    found = df.mapInArrow(run, "sums binary").repartition(16).mapInArrow(add_sums, "sums binary").collect()
    return sum((np.frombuffer(bytes(r[0]), np.float64) for r in found), np.zeros(1))


@dataclass(frozen=True)
class Covariance:
    """Centred products over a table of x-vectors (``written``): n, exact sums by dimension, divisor n."""

    table: DataFrame
    n: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> np.ndarray:
        whole = [divmod(s, self.n) for s in self.sums]
        return np.array([q + r / self.n for q, r in whole])

    def product(self, columns: np.ndarray) -> np.ndarray:
        mean, (size, k) = self.mean, columns.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, k))
            for batch in batches:
                y = _matrix(batch, size) - mean
                total += y.T @ (y @ columns)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return _summed(self.table.select("x"), run).reshape(size, k) / self.n

    def trace(self) -> float:
        mean, size = self.mean, len(self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(float(((_matrix(b, size) - mean) ** 2).sum()) for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([np.array([total]).tobytes()], pa.binary())], ["sums"])

        return float(_summed(self.table.select("x"), run)[0]) / self.n

    def moments(self, axes: np.ndarray) -> np.ndarray:
        """Covariance of the centred vectors projected on ``axes``."""
        mean, (size, k) = self.mean, axes.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k + 1))
            for batch in batches:
                w = np.hstack([(_matrix(batch, size) - mean) @ axes, np.ones((batch.num_rows, 1))])
                total += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        total = _summed(self.table.select("x"), run).reshape(k + 1, k + 1) / self.n
        return total[:k, :k] - np.outer(total[k, :k], total[k, :k])


def integer_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of the rows that stay, as a table in the shared folder."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    # exists() is null when a null entry is met and nothing else.
    bad = F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf)), F.lit(True))
    rows = rows.filter(F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(SCALE * F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), c))).cast("long") + SHIFT)
    found = written(rows.select("key", x.alias("x")))
    length = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.filter(F.size("x") == (length["d"] if length else 0))


def covariance(table: DataFrame) -> Covariance | None:
    """Counts and exact sums; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, batch.column("x").flatten().__len__() // batch.num_rows)
                # Entries have 52 bits at most: sums of both halves stay exact over 2^36 rows.
                n, low, high = n + batch.num_rows, low + (x & 0xFFFFFF).sum(0), high + (x >> 24).sum(0)
        if n:
            k = len(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, n)), pa.array(np.arange(k)), pa.array(low), pa.array(high)], ["n", "d", "low", "high"])

    parts = table.select("x").mapInArrow(run, "n long, d long, low long, high long")
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).orderBy("d").collect()
    return Covariance(table, rows[0]["n"], tuple((r["high"] << 24) + r["low"] for r in rows)) if rows else None


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[str]:
    """Sums over dimensions of (n * x - S)^2 as exact decimal text."""
    reach = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums.tolist()))
    if reach < 1 << 62:
        gap = n * x - sums.astype(np.int64)
        if int(np.abs(gap).max()) ** 2 * x.shape[1] < 1 << 62:
            return [str(v) for v in (gap * gap).sum(1).tolist()]
        gap = gap.astype(object)
    else:
        gap = n * x.astype(object) - sums
    return [str(v) for v in (gap * gap).sum(1).tolist()]


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation as decimal text, whitened array, explained array, residuals array, identity_error), one row for each vector that stays; arrays are by component."""
    table = integer_vectors(vectors, vector, key)
    key_type = vectors.schema[key].dataType.simpleString()
    schema = f"key {key_type}, n long, deviation string, whitened array<double>, explained array<double>, residuals array<double>, identity_error double"
    fit = covariance(table)
    if fit is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    size = len(fit.sums)
    trace = fit.trace()
    values, axes, residuals = jacobi_davidson(fit.product, size, count)
    varied = values > NO_VARIANCE * trace
    axes = axes[:, varied] / np.sqrt(values[varied])
    wrong = float(np.abs(fit.moments(axes) - np.eye(axes.shape[1])).max()) if axes.shape[1] else 0.0
    explained = (values / trace).tolist() if trace > 0 else [None] * len(values)
    mean, n, sums = fit.mean, fit.n, np.array(fit.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, m = _matrix(part, size), part.num_rows
                found = (x - mean) @ axes
                whitened = np.full((m, len(values)), np.nan)
                whitened[:, varied] = found
                flat = pa.array(whitened.ravel(), from_pandas=True)
                offsets = pa.array(np.arange(0, m * len(values) + 1, len(values), dtype=np.int32))
                same = lambda v, t: pa.array([v] * m, t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), same(n, pa.int64()), pa.array(_deviation(x, n, sums)), pa.ListArray.from_arrays(offsets, flat), same(explained, pa.list_(pa.float64())), same(residuals.tolist(), pa.list_(pa.float64())), same(wrong, pa.float64())],
                    ["key", "n", "deviation", "whitened", "explained", "residuals", "identity_error"],
                )

    return table.mapInArrow(run, schema).withColumnRenamed("key", key)


def components(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component. ``deviation`` is null where it has more than 63 bits; ``whiten`` has all of it."""
    rows = whiten(vectors, vector, key, count)
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return rows.select(key, "n", "deviation", "identity_error", parts).select(
        key, (F.col("at") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
