"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent a temporary folder is named, on a single machine only; a cluster raises.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            named = f"file://{tempfile.gettempdir()}/strataloom-checkpoints"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def until_end(spark: SparkSession, path: str) -> None:
    """Have what is written at path deleted when the application ends."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The table stays until the application ends, since frames are read late.
    """
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As stored, with the path for discard."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    until_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path
