"""Session settings and the size check shared by the operators."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "caseweave") -> SparkSession:
    """A session for tests and the bench; on a cluster use the one you are given."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return (
        b.config("spark.sql.shuffle.partitions", cores)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="caseweave-"))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and work tables that all executors reach.

    The cluster names it in ``spark.checkpoint.dir``; where that is not set it lies in the
    warehouse, which is shared as well.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/caseweave-work"
        path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/caseweave-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)  # only what exists can be marked for deletion
    files.deleteOnExit(hadoop)
    return f"{folder}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again (survives the loss of executors).

    ``checkpoint()`` would run the last stage twice and keep its rows without compression.
    """
    path = work_path(df.sparkSession, "cut")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


TASK_BYTES = 4 << 20


def sized(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Shuffles begin with a partition per 4 MB of the tables' files; AQE joins what is small, up to 16 MB.

    With a fixed number of partitions, or AQE's 64 MB, a task's sorts and hash tables grow with the input.
    """
    size = sum(int(str(d._jdf.queryExecution().analyzed().stats().sizeInBytes())) for d in tables)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(least, min(size // TASK_BYTES, 20_000)))
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


def at_most(df: DataFrame, n: int) -> bool:
    """True if ``df`` has no more than ``n`` rows; reads no more than ``n`` + 1."""
    return df.limit(n + 1).count() <= n


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that yields fewer partitions than there are cores (one small file).

    Tables of many files already fill the cluster and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
