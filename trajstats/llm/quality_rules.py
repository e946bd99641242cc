"""Quality rules: plain counts of each text, and the verdict of a logistic regression on hashed word and character n-grams.

1. Texts are read in pieces of about ``PIECE`` characters, in numpy arrays of code points. A piece ends at white space, and words, lines
   and n-grams that reach over its end are carried, so the cut changes nothing and a very long text needs little memory.
2. Features are shares: of all words of a text, the share of each class of words; likewise pairs of neighbouring words, and
   runs of ``GRAM`` characters. A class is a hash into ``CLASSES`` for each of the three kinds.
3. A bounded sample of labelled rows (``SAMPLE_ROWS``, the rows of least hash) is counted once and written as sparse rows. Models without each of
   ``FOLDS`` folds and the model of all rows are trained in one go: each step is one pass in which every task adds up loss and
   gradient of all models; L-BFGS on the driver holds classes x models numbers.
4. Scores of rows that a model hasn't seen and their labels give slope and offset of the probability (Platt).
5. All texts are scored in Arrow batches: a text's score is a mean of weights, so no feature vector is built. It is kept
   from probability ``KEEP_AT`` on, unless the plain counts fail it.

Plain counts: words (runs of other characters than 0x20 and 0x09-0x0D), characters in words, characters of ``SYMBOLS``, lines with a
word that equal an earlier line, words in runs of three words that come twice or more (by 64-bit hashes).
A text fails with fewer than ``LEAST_WORDS`` words or more than half of them repeated.

Defined cases: null and empty texts have no words and fail; null labels are left out; of an id with several labels the largest
counts; null ids have no label; repeated rows get equal results; without labels of both kinds every text that the counts pass is
kept if the share of good labels, or 1, reaches ``KEEP_AT``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajstats.llm.common import add_sums, mix, powers_to, runs, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: Probability from which a text is kept.
KEEP_AT = 0.5
#: Classes of each kind of feature (a power of two), characters of a run, most labelled rows of the fit, folds, penalty of squared weights, steps.
CLASSES, GRAM, SAMPLE_ROWS, FOLDS, PENALTY, STEPS = 1 << 12, 4, 8000, 3, 1e-5, 40
KINDS = 3
#: Characters that are looked at together.
PIECE = 1 << 18
#: Places in a word after which the factors of its hash are drawn anew.
WRAP = 1 << 12

_SALT = np.uint64(0x9E3779B97F4A7C15)


def _is_space(points: np.ndarray) -> np.ndarray:
    return (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))


def pieces(raw: memoryview | bytes) -> Iterator[np.ndarray]:
    """Code points of a UTF-8 text, about ``PIECE`` at a time, cut after white space where there is any."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), np.zeros(0, np.uint32)
    for a in range(0, len(raw), PIECE):
        text = decoder.decode(bytes(raw[a : a + PIECE]), a + PIECE >= len(raw))
        points = np.concatenate([held, np.frombuffer(text.encode("utf-32-le"), np.uint32)])
        cut = len(points)
        if a + PIECE < len(raw):
            space = np.flatnonzero(_is_space(points))
            cut = int(space[-1]) + 1 if len(space) else 0
            if not cut and len(points) > 4 * PIECE:
                cut = len(points)  # a word beyond any sense is cut; see Scan
        if cut:
            yield points[:cut]
        held = points[cut:]


@dataclass
class Counts:
    """Plain counts of one text."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of three words that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = mix(mix(words[:-2] + _SALT) * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:]
    order = np.argsort(windows, kind="stable")
    starts, length = runs(windows[order])
    twice = np.zeros(len(windows), bool)
    twice[order] = np.repeat(length > 1, length)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


class Scan:
    """What one text is made of, piece by piece. A word that is cut by the end of a piece is joined with its rest."""

    def __init__(self):
        self.counts = Counts()
        self.words: list[np.ndarray] = []
        self.seen: set[bytes] = set()
        self.line: list[np.ndarray] = []
        self.tail = np.zeros(0, np.uint32)  # the last GRAM - 1 characters
        self.open_word: tuple[np.ndarray, int] | None = None  # sum and length of a word that may go on

    def add(self, points: np.ndarray) -> np.ndarray:
        """Count a piece; the classes of its character runs come back."""
        inside = ~_is_space(points)
        self.counts.word_chars += int(inside.sum())
        self.counts.n_symbols += int(np.isin(points, [ord(c) for c in SYMBOLS]).sum())
        codes = mix(np.concatenate([self.tail, points]).astype(np.uint64) + _SALT)
        self._split_words(codes[len(self.tail) :], inside)
        self._split_lines(points)
        self.tail = np.concatenate([self.tail, points])[-(GRAM - 1) :]
        n = len(codes) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        grams = codes[:n].copy()
        for k in range(1, GRAM):
            grams += codes[k : k + n] * powers_to(GRAM)[k]
        return mix(grams)

    def _split_words(self, codes: np.ndarray, inside: np.ndarray) -> None:
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = np.flatnonzero(begins)
        if not len(starts):
            self._close_word()
            return
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        length = ends - starts
        place = np.zeros(len(codes), np.int64)
        place[inside] = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        joined = starts[0] == 0 and self.open_word is not None
        if joined:
            place[: ends[0]] += self.open_word[1]
        else:
            self._close_word()
        factor = powers_to(WRAP)[place % WRAP]
        if place.max() >= WRAP:
            factor = factor * (mix((place // WRAP).astype(np.uint64)) | np.uint64(1))
        sums = np.add.reduceat(np.where(inside, codes * factor, np.uint64(0)), starts)
        if joined:
            sums[:1] += self.open_word[0]
        self.open_word = None
        if ends[-1] == len(codes):
            self.open_word = (sums[-1:], int(place[-1]) + 1)
            sums = sums[:-1]
        self.words.append(mix(sums))

    def _close_word(self) -> None:
        if self.open_word is not None:
            self.words.append(mix(self.open_word[0]))
            self.open_word = None

    def _split_lines(self, points: np.ndarray) -> None:
        start = 0
        for at in np.flatnonzero(points == 0x0A):
            self.line.append(points[start:at])
            self._close_line()
            start = int(at) + 1
        self.line.append(points[start:].copy())

    def _close_line(self) -> None:
        line = np.concatenate(self.line) if len(self.line) > 1 else self.line[0]
        self.line = []
        if len(line) and not _is_space(line).all():
            key = hashlib.blake2b(line.tobytes(), digest_size=16).digest()
            self.counts.n_dup_lines += key in self.seen
            self.seen.add(key)

    def close(self) -> np.ndarray:
        """Finish the counts; hashes of the words come back."""
        self._close_word()
        if self.line:
            self._close_line()
        words = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.counts.n_words = len(words)
        self.counts.n_repeat_words = repeated_words(words)
        return words


def _class(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes & np.uint64(CLASSES - 1)).astype(np.int64) + kind * CLASSES


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(3) + mix(words[1:])) if len(words) > 1 else words[:0]


def counted(raw: memoryview | bytes, take: Callable[[np.ndarray, int], None]) -> Counts:
    """Plain counts of a text; ``take`` gets the classes of its features, kind by kind, maybe in several parts."""
    scan = Scan()
    for points in pieces(raw):
        take(_class(scan.add(points), 2), 2)
    words = scan.close()
    take(_class(words, 0), 0)
    take(_class(_pairs(words), 1), 1)
    return scan.counts


def features(raw: memoryview | bytes) -> tuple[np.ndarray, np.ndarray]:
    """(classes, shares) of a text."""
    total = np.zeros(KINDS * CLASSES)

    def take(classes: np.ndarray, kind: int) -> None:
        total[:] += np.bincount(classes, minlength=len(total))

    counted(raw, take)
    by_kind = total.reshape(KINDS, CLASSES)
    by_kind /= np.maximum(1.0, by_kind.sum(1, keepdims=True))
    at = np.flatnonzero(total)
    return at, total[at]


def _texts(column: pa.Array) -> Iterator[memoryview | bytes]:
    for x in column:
        buffer = x.as_buffer() if x.is_valid else None
        yield memoryview(buffer) if buffer is not None else b""


#: Shares are small numbers; the regression sees them times this.
GAIN = 64.0


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in _texts(batch.column("text"))]
        at = pa.array([r[0].astype(np.int16).tobytes() for r in rows], pa.binary())
        value = pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), at, value], ["label", "fold", "at", "value"])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, class and scaled value of each entry."""
    at = [np.frombuffer(x.as_py(), np.int16) for x in batch.column("at")]
    value = [np.frombuffer(x.as_py(), np.float32) for x in batch.column("value")]
    return np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at).astype(np.int64), np.concatenate(value) * GAIN


def _linear(rows: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Scores of n sparse rows by each column of weights; the last row of weights is the constant."""
    return np.stack([np.bincount(rows, w[at] * value, minlength=n) + w[-1] for w in weights.T], 1)


def _losses(weights: np.ndarray) -> Callable:
    """Loss and gradient of all models over a task's rows; column k leaves fold k out, the last one leaves none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, models = weights.shape
        total = np.zeros((size + 1, models))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows, at, value = _rows(part)
                y = part.column("label").to_numpy().astype(float)
                fold = part.column("fold").to_numpy()
                score = _linear(rows, at, value, len(y), weights)
                used = fold[:, None] != np.arange(models)
                sign = np.where(y > 0, 1.0, -1.0)[:, None]
                total[size] += (np.logaddexp(0, -sign * score) * used).sum(0)
                slope = -sign / (1 + np.exp(np.clip(sign * score, -60, 60))) * used
                for k in range(models):
                    total[:size, k] += np.bincount(at, slope[rows, k] * value, minlength=size)
                total[size - 1] += slope.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def minimise(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, models: int, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS for several models at once; ``evaluate`` gives losses and gradients at given columns. A step that doesn't lower a model's loss is halved."""
    x = np.zeros((size, models))
    loss, slope = evaluate(x)
    history: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(models)]
    scale = np.ones(models)

    def direction(k: int) -> np.ndarray:
        q, used = slope[:, k].copy(), []
        for s, y in reversed(history[k]):
            a = s @ q / (s @ y)
            q -= a * y
            used.append(a)
        if history[k]:
            s, y = history[k][-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1e-12, np.linalg.norm(q))
        for (s, y), a in zip(history[k], reversed(used)):
            q += s * (a - y @ q / (s @ y))
        return -q

    for _ in range(steps):
        towards = np.stack([direction(k) for k in range(models)], 1)
        trial = x + towards * scale
        new_loss, new_slope = evaluate(trial)
        for k in range(models):
            if new_loss[k] > loss[k] + 1e-4 * scale[k] * float(slope[:, k] @ towards[:, k]):
                scale[k] /= 2
                continue
            s, y = trial[:, k] - x[:, k], new_slope[:, k] - slope[:, k]
            if s @ y > 1e-12:
                history[k] = [*history[k], (s, y)][-memory:]
            x[:, k], loss[k], slope[:, k], scale[k] = trial[:, k], new_loss[k], new_slope[:, k], 1.0
        if np.abs(slope).max() < 1e-6:
            break
    return x


def platt(score: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability by Newton steps on binned scores: ``good`` of ``total`` rows at each score."""
    n1, n0 = good.sum(), (total - good).sum()
    # Targets a little off 0 and 1 keep separable scores finite.
    aim = (good * (n1 + 1) / (n1 + 2) + (total - good) / (n0 + 2)) / total
    a, b = 1.0, 0.0
    lost = lambda a, b: float((total * (np.logaddexp(0, a * score + b) - aim * (a * score + b))).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -60, 60)))
        g = np.array([(total * (p - aim) * score).sum(), (total * (p - aim)).sum()])
        w = total * p * (1 - p)
        h = np.array([[(w * score**2).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and lost(a - size * step[0], b - size * step[1]) > lost(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


@dataclass(frozen=True)
class Model:
    """A fitted regression; ``weights`` is None where every text has the probability ``share``."""

    share: float
    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def judge(self, raw: memoryview | bytes) -> tuple[Counts, float]:
        """Plain counts and probability of a text."""
        if self.weights is None:
            return counted(raw, lambda classes, kind: None), self.share
        sums, sizes = np.zeros(KINDS), np.zeros(KINDS)

        def take(classes: np.ndarray, kind: int) -> None:
            sums[kind] += self.weights[classes].sum()
            sizes[kind] += len(classes)

        counts = counted(raw, take)
        score = GAIN * float((sums / np.maximum(sizes, 1)).sum()) + self.weights[-1]
        return counts, 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -60, 60)))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, folds: int) -> DataFrame:
    """(text, label, fold) of at most ``rows`` labelled rows, those of least hash; equal ids share a fold."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.withColumn("draw", F.xxhash64("doc_id", F.lit(12))).orderBy("draw", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.select("text", "label", F.pmod("draw", F.lit(folds)).cast("int").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, folds: int = FOLDS, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """The model of a bounded sample of the labelled rows. ``rows`` bounds the labels that are used, and with them what is broadcast."""
    picked = sample(docs, labels, label_col, rows, folds).repartition(16).mapInArrow(_sparse, "label int, fold int, at binary, value binary")
    train = written(picked)
    n, good = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or good in (0, n):
        return Model(good / n if n else 1.0)
    size = KINDS * CLASSES + 1

    def evaluate(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = train.mapInArrow(_losses(weights), "sums binary").repartition(4).mapInArrow(add_sums, "sums binary").collect()
        total = sum(np.frombuffer(bytes(r[0]), np.float64) for r in found).reshape(size + 1, folds + 1) / n
        plain = np.vstack([weights[:-1], np.zeros((1, folds + 1))])
        return total[size] + penalty / 2 * (plain**2).sum(0), total[:size] + penalty * plain

    weights = minimise(evaluate, size, folds + 1, steps)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                score = _linear(*_rows(part), part.num_rows, weights[:, :folds])[np.arange(part.num_rows), part.column("fold").to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(score, -50, 50), 2)), part.column("label")], ["score", "label"])

    bins = train.mapInArrow(unseen, "score double, label int").groupBy("score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("total")).orderBy("score").collect()
    slope, offset = platt(*(np.array([r[c] for r in bins], float) for c in ("score", "good", "total")))
    return Model(good / n, weights[:, folds].copy(), slope, offset)


def _judged(model: Model, keep_at: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.judge(t) for t in _texts(batch.column("text"))]
            fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            cols = [pa.array([getattr(c, f) for c, _ in found], pa.int64()) for f in fields]
            failed, p = [c.failed for c, _ in found], [float(p) for _, p in found]
            kept = [not f and x >= keep_at for f, x in zip(failed, p)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(failed, pa.bool_()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", *fields, "base_failed", "probability", "kept"])

    return run


def verdicts(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept), one row per document."""
    model = fit(docs, labels, label_col, rows)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return docs.select("doc_id", "text").mapInArrow(_judged(model, keep_at), f"doc_id {id_type}, {counts}, base_failed boolean, probability double, kept boolean")
