"""Session settings the jobs rely on."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A group with more rows than this is never sorted or collected by one task; see operators/ordering.py.
HOT_ROWS_KEY = "spark.tradewright.hotGroupRows"
HOT_ROWS_DEFAULT = 1_000_000


def configure(spark: SparkSession) -> SparkSession:
    """Months, weekdays and hours are UTC; AQE splits skewed join partitions and sizes shuffles."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. In local mode, as in tests, one is made where none is named; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tradewright-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes a stage table to the shared folder and reads it back.

    The consumers share one computation, lost executors only re-read files, and the planner knows the size.
    """
    path = f"{stage_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """A stage table (cut) whose job's shuffle files go as soon as it is written, not when the driver's garbage is collected."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return cut(df)
    finally:
        conf.set(key, before)


def release(*tables: DataFrame) -> None:
    """Deletes the folders of stage tables that nothing reads any more, and lets Spark drop the shuffle files of finished jobs."""
    for df in tables:
        spark = df.sparkSession
        home = stage_dir(spark)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("stage-") and folder.rsplit("/", 1)[0].split(":")[-1].lstrip("/").startswith(home.split(":")[-1].lstrip("/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()  # Spark's cleaner works on what the driver's JVM has collected
