"""Shared helpers: row keys, word hashes over Arrow text buffers, hashed hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trajstats.session import ensure_checkpoint_dir

#: Bytes of text that are hashed at a time; a longer text is hashed on its own.
CHUNK_BYTES = 1 << 19

_MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit number for each byte, A-Z as a-z and 0 for white space; and which bytes are white space."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    codes[space] = 0
    return codes, space


BYTE_CODES, IS_SPACE = _byte_tables()
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(8, (n - 1).bit_length())
        grown = np.full(size, _STEP, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bounds, raw


def chunks(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows that hold about ``CHUNK_BYTES`` of text each."""
    out, start = [], 0
    while start < len(bounds) - 1:
        end = int(np.searchsorted(bounds, bounds[start] + CHUNK_BYTES, "right")) - 1
        end = max(start + 1, end)
        out.append((start, end))
        start = end
    return out


def word_hashes(bounds: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of rows ``first`` to ``last`` (end exclusive), and the row of each word.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z counts as a-z.
    """
    lo, hi = int(bounds[first]), int(bounds[last])
    data = raw[lo:hi]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[first + 1 : last] - lo
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    place[~inside] = 0
    value = BYTE_CODES[data] * powers_to(int(place.max()) + 1)[place]
    words = mix(np.add.reduceat(value, starts))
    rows = np.searchsorted(bounds[first : last + 1] - lo, starts, "right") - 1 + first
    return words, rows.astype(np.int64)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared checkpoint folder; it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sum of the packed arrays of a partition."""
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            part = np.frombuffer(x.as_py(), np.float64)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])
