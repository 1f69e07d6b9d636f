"""Session helpers and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "gridmine") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GRIDMINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    It is removed when the driver ends.

    Only a local master may fall back to a folder of this machine: on a cluster
    executors could not see it, so an unset setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = f"{base.rstrip('/')}/gridmine-{os.urandom(8).hex()}"
    elif spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="gridmine-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def partition_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of fewer partitions than cores before work that is heavy per row.

    A no-op on large inputs; small files arrive as one partition and would keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of an Arrow batch where each has a long text or vector: batches live outside the heap on either side of the pipe.
TEXT_BATCH = 1_000


def short_batches(df: DataFrame) -> DataFrame:
    """The rows, with the session told to hand them to Python in batches of at most ``TEXT_BATCH``."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_BATCH:
        conf.set(name, str(TEXT_BATCH))
    return df


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: for results used several times.

    Cuts lineage with a written table, so lost executors cost nothing that is done.
    """
    path = scratch_dir(df.sparkSession) + "/table.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
