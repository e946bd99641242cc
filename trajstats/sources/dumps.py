"""Text dumps and frame tables as distributed scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from trajstats.session import small_side

# The dump layout that simulations write.
DUMP_MARKER = "ITEM: TIMESTEP\n"
STRESS_FIELDS = 16
STRESS_FIRST = 6
STRESS = ("pxx", "pyy", "pzz", "pxy", "pxz", "pyz")


def frame_slice(frames: DataFrame, frame: str, first: int, end: int, every: int = 1) -> DataFrame:
    """Frames first, first + every, ... below ``end``; the range part reaches the scan."""
    f = F.col(frame)
    out = frames.filter((f >= first) & (f < end))
    return out if every == 1 else out.filter((f - first) % every == 0)


def stride(frames: DataFrame, frame: str, n: int, offset: int = 0) -> DataFrame:
    """Keep frames offset, offset + n, ...; stateless, so it also thins a stream."""
    return frames.filter((F.col(frame) >= offset) & ((F.col(frame) - offset) % n == 0))


def on_multiples(rows: DataFrame, t: str, every: float, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose real-valued time is a multiple of ``every``, up to ``tolerance`` multiples."""
    k = F.col(t) / F.lit(float(every))
    return rows.filter(F.abs(k - F.bround(k)) < tolerance)


# --- lines -----------------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, pos, value): text lines with their order inside each input split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos"), "value"
    )


def read_frames(spark: SparkSession, path: str, marker: str = DUMP_MARKER) -> DataFrame:
    """(file, step, fields): rows of a dump whose frames start with a marker line.

    The marker is the record separator of the text reader, so a frame is one record and
    Spark splits the file between frames.
    """
    blocks = spark.read.option("lineSep", marker).text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines")).filter("trim(lines[0]) <> ''")
    rows = blocks.select("file", F.trim(F.col("lines")[0]).cast("long").alias("step"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    return rows.select("file", "step", F.split(F.trim("line"), r"\s+").alias("fields"))


def framed_rows(lines: DataFrame, is_header: Column, names: Sequence[str], types: Sequence[str], header: Column, header_name: str = "time") -> DataFrame:
    """Rows of a dump with header lines, each row with the value of its header.

    The header of a row is the last one before it. It is looked up inside the input
    split, and from the last header of an earlier split of the same file where the split
    starts in the middle of a frame. No task sees more than one split.
    """
    within = W.partitionBy("file", "split").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    tagged = lines.withColumn("_h", F.when(is_header, header)).withColumn("_here", F.last("_h", ignorenulls=True).over(within))
    ends = tagged.groupBy("file", "split").agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("pos"))).alias("_e"))
    carry = ends.select("file", "split", F.last("_e", ignorenulls=True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    rows = tagged.filter("_h IS NULL").join(small_side(carry), ["file", "split"])
    fields = F.split(F.trim("value"), r"\s+")
    return rows.select("file", F.coalesce("_here", "_carry").alias(header_name), *[F.try_element_at(fields, F.lit(k + 1)).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, types))])


def stress_rows(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """Keep the 16-field lines: atom id and six stress components."""
    out = rows.filter(F.size(fields) == STRESS_FIELDS)
    picked = [F.col(fields)[STRESS_FIRST + k].try_cast("double").alias(n) for k, n in enumerate(STRESS)]
    return out.select(*[c for c in rows.columns if c != fields], F.col(fields)[0].try_cast("long").alias("atom"), *picked)


def chain_stress(stress: DataFrame, atom_chain: DataFrame, keys: Sequence[str], step: str, window: Column, components: Sequence[str] = STRESS) -> DataFrame:
    """Per-atom stress summed per chain and step, with the window label to partition by."""
    joined = stress.join(small_side(atom_chain), "atom")
    return joined.groupBy(*keys, step, "chain_id").agg(*[F.sum(c).alias(c) for c in components]).withColumn("window_start", window)


# --- paths and logs --------------------------------------------------------------------

def time_label(path: Column) -> Column:
    """Trailing time of a file name as a whole number: 50 and 50.0 are the same label."""
    return F.regexp_extract(path, r"_(\d+(?:\.\d+)?)\.[A-Za-z]+$", 1).try_cast("double").cast("long")


def path_prefix(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)_\d+(?:\.\d+)?\.[A-Za-z]+$", 1)


def path_temperature(path: Column) -> Column:
    return F.regexp_extract(path, r"TEMP_(\d+)", 1).try_cast("int")


def path_mode(path: Column) -> Column:
    return F.when(F.lower(path).rlike("blocked|corr"), "correlated").otherwise("legacy")


def completeness(expected: DataFrame, found: DataFrame, keys: Sequence[str], size: str, modified: str | None = None, since: object = None) -> DataFrame:
    """Per key: expected and found number of files, empty files, stale files, and a verdict."""
    stale = F.count(F.when(F.col(modified) < F.lit(since), 1)) if modified else F.lit(0).cast("long")
    seen = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found"), F.count(F.when(F.col(size) == 0, 1)).alias("n_empty"), stale.alias("n_stale"))
    out = expected.join(seen, list(keys), "left").fillna(0, ["n_found", "n_empty", "n_stale"])
    return out.withColumn("complete", (F.col("n_found") >= F.col("n_expected")) & (F.col("n_empty") == 0) & (F.col("n_stale") == 0))


def first_failures(lines: DataFrame, file: str, pos: str, value: str, pattern: str) -> DataFrame:
    """First line of each file that matches the failure pattern."""
    hits = lines.filter(F.col(value).rlike(pattern))
    return hits.groupBy(file).agg(F.min(pos).alias(pos), F.min_by(value, pos).alias(value), F.count(F.lit(1)).alias("n_hits"))


def tag_parts(tag: Column) -> tuple[Column, Column]:
    """System and start time from a tag <system>_t<start>."""
    return F.regexp_extract(tag, r"^(.*?)_t\d+$", 1), F.regexp_extract(tag, r"_t(\d+)$", 1).try_cast("long")


def interval_parts(text: Column) -> tuple[Column, Column]:
    """Start and end of "a-b" or "a"; a reversed pair is swapped."""
    a = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")
    b = F.coalesce(F.regexp_extract(text, r"-\s*(\d+)\s*$", 1).try_cast("long"), a)
    return F.least(a, b), F.greatest(a, b)


# --- matrices --------------------------------------------------------------------------

def pair_blocks(cells: DataFrame, a: str, b: str, wanted: DataFrame) -> DataFrame:
    """Cells of the wanted (a, b) blocks; where only (b, a) is stored, its transpose.

    Which blocks are stored is decided on the table of block names, so the cells
    themselves are read once and joined to a small list.
    """
    stored = cells.select(a, b).distinct()
    direct = wanted.join(stored, [a, b], "left_semi").select(a, b, F.lit(False).alias("_flip"))
    turned = wanted.join(stored, [a, b], "left_anti").join(stored.select(F.col(a).alias(b), F.col(b).alias(a)), [a, b], "left_semi")
    use = direct.unionByName(turned.select(F.col(b).alias(a), F.col(a).alias(b), F.lit(True).alias("_flip")))
    picked = cells.join(small_side(use), [a, b])
    flip = F.col("_flip")
    return picked.select(
        F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a), F.when(flip, F.col(a)).otherwise(F.col(b)).alias(b),
        F.when(flip, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(flip, F.col("i")).otherwise(F.col("j")).alias("j"), "value",
    )


def write_long(df: DataFrame, path: str, partitions: Sequence[str], fmt: str = "parquet") -> None:
    """Long table as a partitioned sink (observables, intervals, provenance)."""
    df.write.mode("overwrite").partitionBy(*partitions).format(fmt).save(path)
