"""Session helpers: recommended settings, settled tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings the jobs are written for. Broadcasts are left to Catalyst's own size check
# (autoBroadcastJoinThreshold) and AQE; skewed shuffle joins are split by AQE.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

BROADCAST_ROW_LIMIT = 20_000


def local_session(app="excerpta", cores="*", shuffle_partitions=8, memory="8g"):
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session, where every machine is this one, gets a folder of its own if none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="excerpta-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def settle(df: DataFrame, name="table") -> DataFrame:
    """Write ``df`` once into the shared folder and read it from there: lineage ends at a table that
    no lost executor can take away, and nothing above it is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads at most ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only when ``df`` provably has at most ``limit`` rows.

    The check reads at most ``limit + 1`` rows. Beyond it the frame comes back without a hint and
    the join becomes an ordinary shuffle join, split by AQE where a key is hot.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def spread_files(df: DataFrame) -> DataFrame:
    """Spread an input of fewer files than cores over the cores.

    A file with one row group would otherwise keep one core busy. An input of more files is returned as it is: its
    text is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def together(*jobs):
    """Run independent Spark actions at the same time and return their results in order.

    Stages of different jobs then share the cluster instead of waiting for each other's stragglers.
    """
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [future.result() for future in [pool.submit(job) for job in jobs]]
