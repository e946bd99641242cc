"""Exact dedup that stays even under hot groups: local, salted and global combining, full texts compared each time.

1. Locally: rows are grouped by (digest, salt, whole text); Spark combines on the map side, so a task
   sends one row per distinct text.
2. Salted: digests that hold more than one in ``hot_parts`` rows are hot. There are fewer than
   ``hot_parts`` of them, so the list is small whatever the input. Their groups are merged in ``salts`` parts.
3. Globally: the winners of the parts of hot digests are merged by whole text again.

A group's text is a grouping key in every stage, so texts that merely share a digest stay apart.
Rows then find their group by digest; digests that hold several texts are joined by whole text.

Defined cases: a null text counts as empty; null ids lose against others, and a group of null ids keeps
a null id; of identical rows (id and text) one is kept; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from trajstats.llm.common import filled
from trajstats.session import cut_lineage


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _hot_digests(rows: DataFrame, hot_parts: int) -> DataFrame:
    """Digests with more than one in ``hot_parts`` rows: fewer than ``hot_parts`` rows come back to the driver."""
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    found = [r["digest"] for r in counts.filter(F.col("n") * hot_parts > total).select("digest").collect()]
    return rows.sparkSession.createDataFrame([(d, True) for d in found], "digest string, hot boolean")


def _salted(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    part = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    return rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot"), part).otherwise(F.lit(-1))).drop("hot")


def text_groups(docs: DataFrame, digest: Callable[[Column], Column], hot: DataFrame, salts: int) -> DataFrame:
    """(digest, keep_id, group_size), one row per distinct text."""
    base = _salted(docs.select("doc_id", filled().alias("text"), digest(filled()).alias("digest")), hot, salts)
    merged = base.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    split = F.col("salt") >= 0
    whole = merged.groupBy("digest", F.when(split, F.col("text")).alias("text"), F.when(~split, F.col("keep_id")).alias("own"), F.when(~split, F.xxhash64("text")).alias("apart"))
    return whole.agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, hot_parts: int = 500, salts: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row; the largest id of equal texts stays."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = docs.select("doc_id", digest(filled()).alias("digest"), sha256(filled()).alias("text_sha256"))
    hot = _hot_digests(ids, hot_parts)
    groups = cut_lineage(text_groups(docs, digest, hot, salts))
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    rows = ids.groupBy("doc_id", "digest", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    spread = groups.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1))))).drop("hot")
    if shared.isEmpty():
        found = _salted(rows, hot, salts).join(spread, ["digest", "salt"])
    else:
        lone = _salted(rows.join(shared, "digest", "left_anti"), hot, salts).join(spread, ["digest", "salt"])
        texts = docs.select("doc_id", filled().alias("text"), digest(filled()).alias("digest"), sha256(filled()).alias("text_sha256")).join(shared, "digest", "left_semi")
        apart = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        copies = texts.groupBy("doc_id", "digest", "text", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
        found = lone.select("doc_id", "keep_id", "group_size", "text_sha256", "copies").unionByName(copies.join(apart, ["digest", "text"]).select("doc_id", "keep_id", "group_size", "text_sha256", "copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def survivors(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of identical rows one."""
    kept = exact_dedup(docs, **options).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", sha256(filled()).alias("digest"))
    same = lambda right: rows["doc_id"].eqNullSafe(right["_id"]) & (rows["digest"] == right["_sha"])
    found = rows.join(kept, same(kept), "left_semi")
    repeated = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_sha"))
    if not repeated.isEmpty():
        once = found.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "digest"])
        found = found.join(repeated, same(repeated), "left_anti").unionByName(once)
    return found.select("row.*")
