"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. Statistics of each text (counts of character kinds, word and line shapes, repetition) are computed once, in Arrow
   batches, and written to the shared folder: about 200 bytes a document.
2. They are standardised by their mean and deviation over the training rows. ``features`` cosines
   of random projections approximate a Gaussian kernel.
3. Each task sums the products of its training rows, by fold; sums of tasks are added up in 16 tasks, then on
   the driver. Their size depends on the number of features alone. Leaving a fold out is a subtraction, so
   out-of-fold ridge scores of all training rows cost one more pass over the statistics.
4. Out-of-fold scores and labels are counted in ``bins``; pooling adjacent violators over the bins gives
   the calibration, which is interpolated between bins.

Labels are used only of training rows. All training rows are used; nothing is sampled.

Defined cases: null or empty texts have zero statistics and get the score of such; null ids count as empty
text for ``held_out`` and have no label; null labels are left out; of an id with several labels the largest
counts; repeated rows get equal scores; other columns are ignored; without labels of both
kinds every score is the share of good labels, or 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajstats.llm.common import add_sums, chunks, mix, remainder, runs, text_buffers, word_hashes, written

#: Random features, ridge penalty per training row, kernel width in deviations, folds, bins of the calibration.
FEATURES, RIDGE, WIDTH, FOLDS, BINS = 256, 1e-4, 8.0, 4, 2000
#: Scores from here on predict label 1.
THRESHOLD = 0.7

_KINDS = ["lower", "upper", "digit", "blank", "newline", "stop", "comma", "bar", "mark", "high", "other"]


def _kinds() -> np.ndarray:
    out = np.full(256, _KINDS.index("other"), np.uint8)
    for name, chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("blank", b" \t"), ("newline", b"\n\r"), ("stop", b".!?"), ("comma", b",;:"), ("bar", b"|"), ("mark", b"#$%&*@~^=+<>{}[]\\/_")):
        out[list(chars)] = _KINDS.index(name)
    out[128:] = _KINDS.index("high")
    return out


KIND = _kinds()
STATISTICS = ["log_bytes", "log_words", *(f"share_{k}" for k in _KINDS), "word_bytes", "word_spread", "long_words", "short_words", "distinct_words", "distinct_pairs", "top_word", "doubled_bytes", "log_lines", "line_bytes", "distinct_lines", "repeated_line_bytes", "kinds_entropy", "stops_per_word", "capitals_per_stop"]


def _distinct(values: np.ndarray) -> tuple[int, int]:
    """How many distinct values there are, and how often the most frequent occurs."""
    if not len(values):
        return 0, 0
    _, length = runs(np.sort(values))
    return len(length), int(length.max())


def document_statistics(bounds: np.ndarray, raw: np.ndarray, first: int, last: int) -> np.ndarray:
    out = np.zeros((last - first, len(STATISTICS)))
    words, rows = word_hashes(bounds, raw, first, last)
    at = np.searchsorted(rows, np.arange(first, last + 1))
    for i in range(first, last):
        data = raw[bounds[i] : bounds[i + 1]]
        n = len(data)
        if not n:
            continue
        counts = np.bincount(KIND[data], minlength=len(_KINDS)).astype(float)
        share = counts / n
        solid = KIND[data]
        inside = (solid != 3) & (solid != 4)
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        length = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        word = words[at[i - first] : at[i - first + 1]]
        w = max(1, len(word))
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], breaks + 1])
        starts = starts[starts < n]
        sizes = np.diff(np.append(starts, n))
        sums = np.add.reduceat(mix(data.astype(np.uint64) + (np.arange(n) - np.repeat(starts, sizes)).astype(np.uint64) * np.uint64(257)), starts)
        order = np.argsort(sums, kind="stable")
        repeated = np.zeros(len(sums), bool)
        repeated[order[1:]] = sums[order[1:]] == sums[order[:-1]]
        pairs = word[:-1] * np.uint64(3) + mix(word[1:]) if len(word) > 1 else word[:0]
        entropy = -(share[share > 0] * np.log(share[share > 0])).sum()
        kinds, most = _distinct(word)
        lengths = length if len(length) else np.zeros(1)
        out[i - first] = [
            np.log1p(n), np.log1p(len(word)), *share, lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths <= 3).mean(), kinds / w, _distinct(pairs)[0] / max(1, len(pairs)), most / w,
            float((data[1:] == data[:-1]).mean()) if n > 1 else 0.0, np.log1p(len(starts)), np.log1p(n / max(1, len(starts))), (len(starts) - repeated.sum()) / max(1, len(starts)),
            sizes[repeated].sum() / n, entropy, counts[5] / w, counts[1] / max(1.0, counts[5]),
        ]
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            bounds, raw = text_buffers(batch.column("text"))
            parts = [document_statistics(bounds, raw, a, b) for a, b in chunks(bounds)]
            flat = pa.array(np.concatenate(parts).astype(np.float32).ravel())
            stats = pa.FixedSizeListArray.from_arrays(flat, len(STATISTICS)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), stats], ["doc_id", "held_out", "stats"])


def random_features(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def project(stats: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Cosines of random projections of the standardised statistics, and a constant."""
    directions, shifts = random_features()
    z = np.clip((stats - mean) / deviation, -8, 8)
    return np.hstack([np.cos(z @ directions + shifts) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)


def _sums_by_fold(mean: np.ndarray, deviation: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Normal equations of each fold: products of the features and of features and labels."""
        d = FEATURES + 1
        total = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = project(_matrix(part), mean, deviation)
                y = part.column("label").to_numpy().astype(float)
                fold = part.column("fold").to_numpy()
                for k in range(FOLDS):
                    own = x[fold == k]
                    total[k, :, :d] += own.T @ own
                    total[k, :, d] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def ridge(sums: np.ndarray) -> np.ndarray:
    d = sums.shape[0]
    penalty = RIDGE * max(1.0, sums[d - 1, d - 1]) * np.eye(d)
    penalty[d - 1, d - 1] = 1e-9
    return np.linalg.solve(sums[:, :d] + penalty, sums[:, d])


def isotonic(weight: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of good rows by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, g in zip(weight, good):
        blocks.append([w, g, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, g2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + g2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), g / w) for w, g, n in blocks])


def _binned(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((scores + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)


def _fold_scores(models: np.ndarray, mean: np.ndarray, deviation: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of out-of-fold scores by bin and label."""
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                scores = (project(_matrix(part), mean, deviation) * models[part.column("fold").to_numpy()]).sum(1)
                for label in (0, 1):
                    counts[label] += np.bincount(_binned(scores[part.column("label").to_numpy() == label]), minlength=BINS)
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.sum(0)[at]), pa.array(counts[1][at])], ["bin", "n", "good"])

    return run


@dataclass(frozen=True)
class Model:
    """A fitted classifier; ``weights`` is None where all scores are ``share``."""

    share: float
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    at: np.ndarray | None = None
    level: np.ndarray | None = None

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.share)
        return np.concatenate([np.interp(project(stats[a : a + 4096], self.mean, self.deviation) @ self.weights, self.at, self.level) for a in range(0, max(1, len(stats)), 4096)])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(_matrix(batch)))], ["doc_id", "held_out", "score"])

    return run


def _statistics(docs: DataFrame, folds: int, held_fold: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"), "text")
    return written(rows.mapInArrow(_measure, f"doc_id {id_type}, held_out boolean, stats array<float>"))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_fold: int = 2) -> Model:
    """The model of the labelled rows of ``stats`` (doc_id, held_out, stats) that aren't held out."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    known = known.filter(remainder("doc_id", folds) != held_fold)
    train = written(stats.filter("not held_out").join(known, "doc_id").select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")))
    d = len(STATISTICS)
    moments = train.agg(F.count(F.lit(1)), F.sum("label"), *(f(F.get("stats", F.lit(i))) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    n, good = moments[0], moments[1] or 0
    if not n or good in (0, n):
        return Model(good / n if n else 0.5)
    mean, deviation = np.array(moments[2::2], float), np.maximum(np.array(moments[3::2], float), 1e-6)
    found = train.mapInArrow(_sums_by_fold(mean, deviation), "sums binary").repartition(16).mapInArrow(add_sums, "sums binary").collect()
    sums = sum(np.frombuffer(bytes(r[0]), np.float64) for r in found).reshape(FOLDS, FEATURES + 1, FEATURES + 2)
    whole = sums.sum(0)
    models = np.array([ridge(whole - sums[k]) for k in range(FOLDS)])
    counts = train.mapInArrow(_fold_scores(models, mean, deviation), "bin long, n long, good long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    at = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in counts])
    level = isotonic(np.array([r["n"] for r in counts], float), np.array([r["good"] for r in counts], float))
    return Model(good / n, ridge(whole), mean, deviation, at, level)


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    stats = _statistics(docs, folds, held_fold)
    model = fit(stats, labels, label_col, folds, held_fold)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(_score(model), f"doc_id {id_type}, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, with all their columns."""
    model = fit(_statistics(docs, folds, held_fold), labels, label_col, folds, held_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bounds, raw = text_buffers(batch.column("text"))
                stats = np.concatenate([document_statistics(bounds, raw, a, b) for a, b in chunks(bounds)])
                yield batch.filter(pa.array(model.scores(stats.astype(np.float32).astype(np.float64)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
