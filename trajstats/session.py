"""Session helpers: checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a side may be broadcast after it was counted.
BROADCAST_ROWS = 100_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trajstats")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names. Where none is named, make one in local mode (tests) and fail elsewhere:
    executors can't see each other's disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read it back.

    Iterative plans call this once per round, so that a lost executor costs one
    round and the plan does not grow with the number of rounds.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/trajstats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` was counted and found small.

    The count stops at ``max_rows + 1`` rows. A larger side comes back unhinted, and
    Spark then joins it by a shuffle that AQE can split on skew.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def group_side(df: DataFrame, max_rows: int = 2_000) -> DataFrame:
    """One row per group, to be joined to the rows of the groups: a broadcast of few groups, a sort merge join of many.

    Without the hint Spark may broadcast either side by the size of compressed files, which says little about its rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores over all cores.

    For scans that are followed by heavy work per row. A large table has many splits
    and comes back as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
