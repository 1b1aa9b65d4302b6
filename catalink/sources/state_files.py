"""State between runs as JSON tables; a missing or damaged one is empty, and each save is a new version."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

CACHE = "sha256 string, title string, matched_via string"
INDEX = "file_name string, size long, mtime timestamp, sha256 string"
RENAMES = "output_directory string, old string, new string"


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version under ``path``; an empty table if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return spark.createDataFrame([], schema)
    versions = sorted(s.getPath().toString() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v="))
    done = [v for v in versions if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{v}/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], schema)
    try:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(done[-1])
        df.limit(1).count()
        return df
    except PySparkException:
        return spark.createDataFrame([], schema)


def save(df: DataFrame, path: str) -> str:
    """Write a version; earlier ones stay, so a run never overwrites what it reads."""
    target = f"{path.rstrip('/')}/v={time.time_ns():020d}"
    df.write.json(target)
    return target


def reset(spark: SparkSession, path: str, schema: str) -> str | None:
    """Save an empty version, so that the next run begins anew; a copy of the newest one is written first, and its path returned.

    Without rows to keep nothing is written. If the copy fails, the error leaves the saved state as it is."""
    old = load(spark, path, schema)
    if old.isEmpty():
        return None
    backup = f"{path.rstrip('/')}.bak"
    old.write.mode("overwrite").json(backup)
    save(spark.createDataFrame([], schema), path)
    return backup


def load_renames(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest's renames; rows without a directory or one of the names, and a damaged manifest, undo nothing."""
    return load(spark, path, RENAMES).where("output_directory <> '' AND old <> '' AND new <> ''")


def save_renames(df: DataFrame, path: str) -> str | None:
    """The manifest of a run; nothing is written for a run without renames."""
    return None if df.isEmpty() else save(df, path)
