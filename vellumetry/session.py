"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(app: str = "vellumetry", cpus: str = "8", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the benchmark, with stored tables in shared; clusters bring their own."""
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("VELLUMETRY_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir. Only a session within one process may do without; it gets one of its own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rsplit("/", 1)[0]
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="vellumetry-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vellumetry-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables this application has stored; DataFrames made from them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, what: str, schema: StructType | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back, by df's schema or another that fits.

    Survives the loss of executors, unlike a local checkpoint or a cache. The tables of an application
    go when it ends, or with drop_stored().
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    path = f"{_tables_dir(spark)}/{what}-{uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores, before costly work on few large input splits; else as it is.

    Only the files of df are looked at: no job runs here, as asking for the partitions of a plan with shuffles would start one.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if "Exchange" in (plan := df._jdf.queryExecution().executedPlan().toString()) or "AdaptiveSparkPlan" in plan:
        return df
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= want else df.repartition(want)
