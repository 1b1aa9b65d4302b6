"""Keyed state between runs: which files are unchanged, and merges of what a run has learnt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def incremental_partition(files: DataFrame, index: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``title, skip``: files whose name, size and time the index has, and whose hash the cache gives a title.

    Only metadata is read; texts of skipped files never are."""
    known = index.select("file_name", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "sha256").join(
        cache.where(F.coalesce("title", F.lit("")) != "").select("sha256", "title"), "sha256", "left")
    out = files.join(known.drop("sha256"), "file_name", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & F.col("title").isNotNull()
    skip = F.coalesce(same, F.lit(False))
    return out.withColumn("skip", skip).withColumn("title", F.when(skip, F.col("title"))).drop("_size", "_mtime")


def merge_cache(cache: DataFrame, automated: DataFrame, human: DataFrame) -> DataFrame:
    """``sha256, title, matched_via``: people's rows over cached ones, cached ones over automated ones.

    Automated rows without a title, of low confidence, or from the cache itself add nothing. Of
    several rows of a kind the first by ``pos`` counts, of people's the last."""
    low = F.coalesce(F.col("matched_via"), F.lit(""))
    auto = automated.where(F.col("title").isNotNull() & F.col("sha256").isNotNull() & ~low.contains("low confidence") & ~low.startswith("Fingerprint Cache"))
    rows = (
        human.select("sha256", "title", "matched_via", F.lit(0).alias("_k"), (-F.col("pos")).alias("_p"))
        .unionByName(cache.select("sha256", "title", "matched_via", F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_p")))
        .unionByName(auto.select("sha256", "title", "matched_via", F.lit(2).alias("_k"), F.col("pos").alias("_p")))
    )
    # a minimum of structs combines map-side, so a key of very many rows is no burden
    best = rows.groupBy("sha256").agg(F.min(F.struct("_k", "_p", "title", "matched_via")).alias("b"))
    return best.select("sha256", "b.title", "b.matched_via")


def merge_index(index: DataFrame, results: DataFrame) -> DataFrame:
    """``file_name, size, mtime, sha256``: confirmed files under their new name, unmatched and old names gone.

    ``results`` has file_name, new_name (null: unmatched), low_confidence and the new size, mtime and sha256. Files of low
    confidence keep their entry."""
    sure = results.where("not low_confidence")
    gone = sure.select("file_name").union(sure.where("new_name is not null").select(F.col("new_name"))).distinct()
    confirmed = sure.where("new_name is not null").groupBy("new_name").agg(F.max(F.struct("size", "mtime", "sha256")).alias("s")).select(F.col("new_name").alias("file_name"), "s.*")
    return index.join(gone, "file_name", "left_anti").select("file_name", "size", "mtime", "sha256").unionByName(confirmed)


def newest(rows: DataFrame, order: str, k: int) -> DataFrame:
    """The ``k`` rows of the greatest ``order``."""
    return rows.orderBy(F.desc(order)).limit(k)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
