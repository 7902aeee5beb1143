"""Writers: partitioned tables, versioned stages, small JSON and Markdown, provenance."""

from __future__ import annotations

import hashlib
import importlib.metadata
import importlib.util
import json
import logging
import platform
import sys
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def stage(df: DataFrame, root: str, version: str, partitions: tuple[str, ...] = ("scheme", "panel", "side")) -> str:
    """Write a version of a stage; a stage never overwrites what it reads."""
    path = f"{root}/{version}"
    df.write.mode("overwrite").partitionBy(*(p for p in partitions if p in df.columns)).parquet(path)
    return path


def delimited(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report(value: dict, spark: SparkSession, path: str) -> None:
    """A small JSON document through Spark's file systems."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: list[dict], digits: int = 3) -> str:
    """A Markdown table of collected rows."""
    if not rows:
        return ""
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(shown(r.get(n)) for n in names) + " |" for r in rows])


def copied(spark: SparkSession, source: str, target: str) -> str:
    """A file or folder copied under a stable name, through Spark's file systems; an older copy is replaced."""
    hadoop, configuration = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(target)
    from_, to = a.getFileSystem(configuration), b.getFileSystem(configuration)
    fresh = hadoop.Path(f"{target}.{uuid.uuid4().hex}")
    hadoop.FileUtil.copy(from_, a, to, fresh, False, True, configuration)
    to.delete(b, True)
    if not to.rename(fresh, b):
        raise OSError(f"{target} could not be replaced")
    return target


def logger(name: str, file: str | None = None) -> logging.Logger:
    """A logger to standard output and, if named, a file on the driver; asked for again it gets no second handler."""
    out = logging.getLogger(name)
    out.setLevel(logging.INFO)
    wanted = [logging.StreamHandler(sys.stdout)] + ([logging.FileHandler(file, encoding="utf-8")] if file else [])
    for handler in wanted:
        known = any(type(h) is type(handler) and getattr(h, "baseFilename", None) == getattr(handler, "baseFilename", None) for h in out.handlers)
        if not known:
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            out.addHandler(handler)
    return out


def environment() -> dict[str, str]:
    """Versions of what a result depends on."""
    names = ("pyspark", "pyarrow", "numpy", "pandas")
    found = {n: importlib.metadata.version(n) for n in names if importlib.util.find_spec(n)}
    return {"python": platform.python_version(), "system": platform.system(), "machine": platform.machine(), **found}


def file_digest(path: str) -> str:
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, md5 of files of up to 2 GB, read and digested by tasks through Spark's file systems."""
    if not paths:
        return spark.createDataFrame([], "path string, length long, md5 string")
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.md5("content").alias("md5"))


def _told(source: str, url: str | None, version: str | None, rows: int, checksum, filters: list[str] | None, extra: dict) -> dict:
    return {"source": source, "url": url, "version": version, "created": datetime.now(UTC).isoformat(), "rows": rows, "checksum": str(checksum), "filters": filters or [], **extra}


def provenance(source: str, df: DataFrame, url: str | None = None, version: str | None = None, filters: list[str] | None = None, **extra) -> dict:
    """What a table came from: source, time, rows and an order-free checksum of them."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return _told(source, url, version, row.n, row.h, filters, extra)


def recorded(df: DataFrame, path: str, source: str, url: str | None = None, version: str | None = None, filters: list[str] | None = None, digest: Column | None = None, **extra) -> dict:
    """Write df to path as Parquet and tell its provenance, rows and checksum counted by the tasks that write it.

    The checksum is the sum of the rows' digests (of all columns, or as given), so it doesn't depend on
    their order. The record also has the number, bytes and a digest of the files that df was read
    from; the files' own digests are a table at path.inputs (path, length, md5). Without such files, as for made tables, n_files is 0.
    """
    spark, seen = df.sparkSession, Observation()
    whole = F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)) if digest is None else digest
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(whole.cast("decimal(38,0)")).alias("checksum"))
    watched.write.mode("overwrite").parquet(path)
    file_digests(spark, df.inputFiles()).write.mode("overwrite").parquet(f"{path}.inputs")
    lines = F.sum(F.conv(F.substring(F.md5(F.concat_ws(" ", F.element_at(F.split("path", "/"), -1), "md5")), 1, 15), 16, 10).cast("decimal(38,0)"))
    files = spark.read.schema("path string, length long, md5 string").parquet(f"{path}.inputs")
    told = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), lines.alias("digest")).first()
    counted = seen.get
    return _told(source, url, version, counted["rows"], counted["checksum"], filters, {"n_files": told.n, "bytes": told.bytes, "files_digest": str(told.digest), **extra})
