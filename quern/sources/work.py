"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications whose session names none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only with a master on this machine, as in tests, a
    temporary folder may take its place, one an application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _local.get(app) or _local.setdefault(app, f"file://{tempfile.mkdtemp(prefix='quern-')}")
    return f"{root.rstrip('/')}/quern-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: later stages read it, lost executors don't lose it."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that only finished tables were made from."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_exchanges(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes the exchanges of plans nobody holds any more.

    Between long steps only: a collection costs the driver some tenths of a second.
    """
    spark._jvm.System.gc()


def remove_work_tables(spark: SparkSession) -> None:
    """Delete what this application has left in the shared folder, once its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
