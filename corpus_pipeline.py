"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir). The first four return the rows they keep with the columns of documents, the
last one the tokens.

Null and empty texts, null and repeated ids, ties, repeated rows and further columns are treated as the operators
say; an empty table runs through all stages. Further columns of documents stay up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajstats.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from trajstats.llm.queries import tokenizer_path
from trajstats.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles the one with the smallest id."""
    return jaccard_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text decoded from them."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), into="ids", decoded="decoded")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

#: The classifier has no SQL form; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; what lies between them is in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
