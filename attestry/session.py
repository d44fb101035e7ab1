"""Session settings for local work, and the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: str | None = None


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("attestry")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only a local master may leave it unset, and then gets a temporary folder.

    The caller owns the folder: nothing here deletes it, so the cluster should clean it by age.
    """
    global _LOCAL
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than there are cores; a large scan stays as it is.

    For work that costs far more per row than moving the row, such as cutting texts into n-grams. Use it on scans only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, purpose: str, block: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: every later branch sees the same rows at no second cost.

    Readers hold up to 4,096 rows of a row group at once; for rows of long arrays, ``block`` bytes make the groups smaller.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.options(**{"parquet.block.size": str(block)} if block else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
