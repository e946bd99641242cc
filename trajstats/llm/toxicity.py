"""Toxicity by a classifier chain over categories.

Terms are the starts of words (4 to 10 bytes) and whole words, lower-cased. Over a bounded sample of labelled
training rows (``sample_rows``), terms are counted in ``BUCKETS`` hash buckets by task and the ``terms`` that speak most for toxic
texts are kept; of terms that occur in the same rows one is kept, so that the starts of a word don't fill the places. A text's features are which of them it has, how many words have one, and its length.

The categories are predicted in order by logistic models. The model of a category sees the features and the
probabilities of the categories before it. In training those probabilities are out of fold: every fold's rows
are predicted by models of the other folds. Each Newton step sums gradients and curvatures by partition, for all
folds and the whole at once. Then every document is scored by the models of the whole.

Categories of the query: the label column ``toxic`` comes last; ``insult`` and ``contempt`` before it
are weak labels, toxic rows that have a word of a short list.

Defined cases: a null or empty text has no terms and gets the probabilities of such; null ids have no label;
null labels are left out; of an id with several labels the largest counts; a category without both kinds
of training rows gets its share as probability; repeated rows get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajstats.llm.common import BYTE_CODES, IS_SPACE, add_sums, chunks, mix, powers_to, remainder, text_buffers, word_hashes, written

#: Labelled rows that are used for training at most, terms kept, hash buckets of terms.
SAMPLE_ROWS, TERMS, BUCKETS = 20_000, 384, 1 << 20
#: Lengths in bytes of the word starts that are terms.
STARTS = range(4, 11)
#: Folds of the chain, Newton steps, ridge penalty.
FOLDS, STEPS, PENALTY = 3, 7, 0.3
#: A category is predicted from this probability on.
THRESHOLD = 0.5

# Words of the weakly labelled categories.
INSULT = "idiot moron clown loser stupid fool dumb imbecile jerk liar coward".split()
CONTEMPT = "trash pathetic worthless disgusting scum garbage filth vermin useless repulsive".split()


def word_terms(bounds: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of rows ``first`` to ``last``, the row of each, and the number of words by row."""
    words, rows = word_hashes(bounds, raw, first, last)
    count = np.bincount(rows - first, minlength=last - first)
    if not len(words):
        return words, rows, count
    lo = int(bounds[first])
    data = raw[lo : int(bounds[last])]
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[first + 1 : last] - lo
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    terms, owner = [words], [rows]
    stop = np.append(starts[1:], len(data))
    value, live = np.zeros(len(starts), np.uint64), np.arange(len(starts))
    powers = powers_to(STARTS[-1] + 1)
    for i in range(STARTS[-1]):
        live = live[(starts[live] + i < stop[live])]
        live = live[inside[starts[live] + i]]
        value[live] += BYTE_CODES[data[starts[live] + i]] * powers[i]
        if i + 1 in STARTS:
            terms.append(mix(value[live] + np.uint64(i + 1)))
            owner.append(rows[live])
    return np.concatenate(terms), np.concatenate(owner), count


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have a term of each bucket, by label, and the sums of both halves of their hashes, which tell sets of documents apart."""
    found, halves = np.zeros((2, BUCKETS), np.int32), np.zeros((2, BUCKETS))
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds, raw = text_buffers(batch.column("text"))
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        row_hash = batch.column("row").to_numpy().view(np.uint64)
        parts = (row_hash >> np.uint64(32)).astype(float), (row_hash & np.uint64(0xFFFFFFFF)).astype(float)
        for first, last in chunks(bounds):
            terms, rows, _ = word_terms(bounds, raw, first, last)
            both = np.unique((rows.astype(np.int64) << 20) | (terms & np.uint64(BUCKETS - 1)).astype(np.int64))
            at, bucket = both >> 20, both & (BUCKETS - 1)
            for k in (0, 1):
                found[k] += np.bincount(bucket[label[at] == k], minlength=BUCKETS).astype(np.int32)
                halves[k] += np.bincount(bucket, parts[k][at], BUCKETS)  # sums of at most sample_rows numbers below 2^32 are exact
    at = np.flatnonzero(found.any(0))
    columns = [at, *(x[at].astype(np.int64) for x in (found[1], found[0], halves[0], halves[1]))]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "toxic", "clean", "high", "low"])


class Featurizer:
    """Which of the kept buckets a text has terms of, and a few numbers."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = np.sort(np.asarray(buckets, np.int64))
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.buckets] = np.arange(len(self.buckets))
        self.size = len(self.buckets) + 4

    def __reduce__(self):  # the lookup is built anew where it is used
        return Featurizer, (self.buckets,)

    def rows(self, bounds: np.ndarray, raw: np.ndarray, first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, self.size), np.float32)
        terms, rows, words = word_terms(bounds, raw, first, last)
        place = self.place[(terms & np.uint64(BUCKETS - 1)).astype(np.int64)]
        hit = place >= 0
        row = rows[hit] - first
        out[row, place[hit]] = 1
        n = len(self.buckets)
        hits = np.bincount(row, minlength=last - first)
        out[:, n] = np.log1p(hits)
        out[:, n + 1] = np.minimum(1.0, 20 * hits / np.maximum(1, words))
        out[:, n + 2] = np.log1p(words) / 10
        out[:, n + 3] = 1
        return out


def _featurize(featurizer: Featurizer, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds, raw = text_buffers(batch.column("text"))
            for first, last in chunks(bounds):
                for a in range(first, last, 4096):
                    b = min(last, a + 4096)
                    flat = pa.array(featurizer.rows(bounds, raw, a, b).ravel())
                    stats = pa.FixedSizeListArray.from_arrays(flat, featurizer.size).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), stats], [*keep, "x"])

    return run


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)


def with_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """The features with the probabilities of the categories fitted so far, each from those before it."""
    for w in models:
        x = np.hstack([x, sigmoid(x @ w)[:, None]])
    return x


def _by_fold(x: np.ndarray, fold: np.ndarray, fitted: list[np.ndarray]) -> np.ndarray:
    """As ``with_chain``, each row by the models that haven't seen its fold; fitted[c][k] leaves out fold k."""
    for models in fitted:
        x = np.hstack([x, sigmoid((x * models[fold]).sum(1))[:, None]])
    return x


def _newton_sums(fitted: list[np.ndarray], weights: np.ndarray, label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gradient and curvature of each model: FOLDS that leave a fold out, and the whole."""
        d = weights.shape[1]
        total = np.zeros((FOLDS + 1, d, d + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                fold = part.column("fold").to_numpy()
                x = _by_fold(_matrix(part), fold, [m[:FOLDS] for m in fitted])
                y = part.column(label).to_numpy().astype(float)
                for k in range(FOLDS + 1):
                    own = fold != k
                    xs = x[own]
                    p = sigmoid(xs @ weights[k])
                    total[k, :, :d] += (xs * (p * (1 - p))[:, None]).T @ xs
                    total[k, :, d] += xs.T @ (y[own] - p)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def fit_category(train: DataFrame, fitted: list[np.ndarray], size: int, label: str) -> np.ndarray:
    """Weights of the category's models, the last one of the whole; by Newton steps."""
    d = size + len(fitted)
    weights = np.zeros((FOLDS + 1, d))
    for _ in range(STEPS):
        found = train.mapInArrow(_newton_sums(fitted, weights, label), "sums binary").repartition(2).mapInArrow(add_sums, "sums binary").collect()
        sums = sum(np.frombuffer(bytes(r[0]), np.float64).reshape(FOLDS + 1, d, d + 1) for r in found)
        penalty = PENALTY * np.eye(d)
        penalty[size - 1, size - 1] = 1e-6
        weights = np.array([w + np.linalg.solve(s[:, :d] + penalty, s[:, d] - penalty @ w) for w, s in zip(weights, sums)])
    return weights


def _score(featurizer: Featurizer, names: list[str], models: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds, raw = text_buffers(batch.column("text"))
            for first, last in chunks(bounds):
                for a in range(first, last, 4096):
                    b = min(last, a + 4096)
                    x = featurizer.rows(bounds, raw, a, b).astype(np.float64)
                    out = []
                    for w in models:
                        p = sigmoid(x @ w) if isinstance(w, np.ndarray) else np.full(len(x), w)
                        out.append(p)
                        if isinstance(w, np.ndarray):
                            x = np.hstack([x, p[:, None]])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), *map(pa.array, out)], ["doc_id", "held_out", *(f"p_{n}" for n in names)])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, categories: list[str], label_col: str = "toxic", folds: int = 4, held_fold: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, p_<category> ..., toxic), one row per input row. ``labels`` has doc_id and a 0/1 column for each category; ``label_col`` is the last."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"), "text")
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c), F.lit(0))).cast("int").alias(c) for c in categories))
    known = known.filter(remainder("doc_id", folds) != held_fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = F.broadcast(known)  # at most sample_rows rows
    sample = written(rows.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")).select("text", "fold", *categories).repartition(12))
    counts = sample.select("text", F.xxhash64("text").alias("row"), F.col(label_col).alias("toxic")).mapInArrow(_count_terms, "bucket long, toxic long, clean long, high long, low long")
    counts = counts.groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    shares = sample.agg(F.count(F.lit(1)), *(F.sum(c) for c in categories)).first()
    n, positives = shares[0], dict(zip(categories, (x or 0 for x in shares[1:])))
    toxic, clean = positives[label_col], n - positives[label_col]
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    distinct = counts.filter("t >= 2").groupBy("t", "c", "high", "low").agg(F.min("bucket").alias("bucket"))
    best = distinct.withColumn("gain", odds * F.sqrt(F.col("t"))).filter(odds > 1).orderBy(F.desc("gain"), "bucket").limit(TERMS)
    featurizer = Featurizer(np.array([r["bucket"] for r in best.collect()], np.int64))
    train = written(sample.mapInArrow(_featurize(featurizer, ["fold", *categories]), f"fold int, {', '.join(f'{c} int' for c in categories)}, x array<float>"))
    fitted, models = [], []
    for c in categories:
        if 0 < positives[c] < n:
            fitted.append(fit_category(train, fitted, featurizer.size, c))
            models.append(fitted[-1][FOLDS])
        else:
            models.append(positives[c] / n if n else 0.0)
    scored = rows.mapInArrow(_score(featurizer, categories, models), f"doc_id {id_type}, held_out boolean, {', '.join(f'p_{c} double' for c in categories)}")
    return scored.withColumn("toxic", F.col(f"p_{label_col}") >= THRESHOLD)


def weak_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, insult, contempt, toxic) of the labelled documents."""
    text = F.lower(F.coalesce("text", F.lit("")))
    has = lambda words: text.rlike(r"\b(" + "|".join(words) + r")\b").cast("int")
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = docs.select("doc_id", has(INSULT).alias("insult"), has(CONTEMPT).alias("contempt")).groupBy("doc_id").agg(F.max("insult").alias("insult"), F.max("contempt").alias("contempt"))
    rows = known.join(marked, "doc_id")
    return rows.select("doc_id", (F.col("insult") * F.col("toxic")).alias("insult"), (F.col("contempt") * F.col("toxic")).alias("contempt"), "toxic")
