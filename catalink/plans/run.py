"""The whole run over tables: features and catalog in, plans out."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions.text import clean_text
from catalink.operators import actions, cascade, catalog, review, state


def storing(spark: SparkSession):
    """Writes a table to the shared folder and reads it again: the batch barrier, and the end of its lineage."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="catalink-")

    def store(df: DataFrame) -> DataFrame:
        path = f"{root.rstrip('/')}/catalink-run-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def run(files: DataFrame, entries: DataFrame, images: DataFrame, cache: DataFrame, limits: cascade.Limits = cascade.Limits(), skipped: DataFrame | None = None) -> DataFrame:
    """Plans of a batch from raw entries (pos, title, notes, year, application_path) and features of files."""
    store = storing(files.sparkSession)
    full = store(catalog.with_display_name(catalog.with_siblings(catalog.derived(entries)), images))
    return cascade.link(files, full, images, cache, store, limits, skipped)


@dataclass
class Batch:
    """What a run leaves: tables, to be saved or shown."""

    plans: DataFrame  #: pos, stem, target_title, match_method, old, new: of skipped and scanned files, new null if the file stays
    counters: DataFrame
    cache: DataFrame
    index: DataFrame
    renames: DataFrame  #: the manifest's: pos, old, new
    low_confidence: DataFrame
    unmatched: DataFrame


def batch(
    files: DataFrame, entries: DataFrame, images: DataFrame, cache: DataFrame, index: DataFrame, mode: str = "incremental",
    rebuild_cache: bool = False, human: DataFrame | None = None, limits: cascade.Limits = cascade.Limits(),
) -> Batch:
    """A whole run. ``files``: features with file_name, size and mtime; ``index``: file_name, size, mtime, sha256.

    ``incremental``: files whose name, size and time the index has, and whose hash the cache names, are not scanned; their
    names are claimed and stay. ``full``: every file is scanned; with ``rebuild_cache`` the cache begins anew too
    (``state_files.reset`` keeps the saved one). ``human``: rows of the cache that people decided (sha256, title, matched_via, pos), which go over all others.
    """
    if mode not in ("incremental", "full"):
        raise ValueError("a run is incremental or full")
    store = storing(files.sparkSession)
    if rebuild_cache and mode != "full":
        raise ValueError("only a full run rebuilds the cache")
    if rebuild_cache:
        cache = cache.where(F.lit(False))
    unchanged = index if mode == "incremental" else index.where(F.lit(False))
    parted = store(state.incremental_partition(files.drop("title"), unchanged, cache))
    skip, scan = parted.where("skip"), parted.where("not skip").drop("skip", "title")
    skipped = skip.select("pos", "stem", F.col("title").alias("target_title"), F.lit("Fingerprint Cache: unchanged").alias("match_method"))
    plans = store(run(scan, entries, images, cache, limits, skip.select("stem")).unionByName(skipped))
    named = parted.select("pos", F.col("file_name").alias("old"), "sha256", "size", "mtime")
    numbered = actions.numbered(named.join(plans.select("pos", F.col("target_title").alias("title")), "pos").select("pos", "old", "title"))
    full = store(plans.join(numbered.select("pos", "new"), "pos").join(named, "pos"))
    low = F.coalesce(F.col("match_method"), F.lit("")).contains("low confidence")
    learnt = full.select("sha256", F.col("target_title").alias("title"), F.col("match_method").alias("matched_via"), "pos")
    people = human if human is not None else learnt.where(F.lit(False))
    results = full.select(F.col("old").alias("file_name"), F.col("new").alias("new_name"), low.alias("low_confidence"), "size", "mtime", "sha256")
    return Batch(
        plans=full.select("pos", "stem", "target_title", "match_method", "old", "new"), counters=review.counters(plans), cache=state.merge_cache(cache, learnt, people),
        index=state.merge_index(index, results), renames=full.where("new IS NOT NULL AND new <> old").select("pos", "old", "new"),
        low_confidence=review.low_confidence_queue(plans), unmatched=plans.where("target_title IS NULL").select("pos", "stem", "match_method").orderBy("pos"),
    )


def link_tables(spark: SparkSession, sf: str) -> DataFrame:
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")
    files = d.join(p, F.col("doc_id") == F.col("p_partkey"), "left").select(
        F.col("doc_id").alias("pos"), F.coalesce("p_name", F.concat(F.lit("file "), F.col("doc_id"))).alias("stem"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.col("n_chars").alias("size"), F.ceil(F.col("n_chars") / 2000).cast("int").alias("page_count"), clean_text("text").alias("text"),
        F.lit(None).cast("string").alias("ocr_front"), F.col("text").alias("ocr_back"), F.lit(None).cast("array<bigint>").alias("cover_hash"),
    ).withColumn("ocr_back", clean_text("ocr_back"))
    entries = b.select(
        F.col("item_id").alias("pos"), F.concat(F.lit("TSR"), F.col("item_id") + 2000, F.lit(": "), F.substring_index("text", " ", 5)).alias("title"),
        F.col("text").alias("notes"), F.lit("1990").alias("year"), F.lit("").alias("application_path"))
    images = spark.createDataFrame([], "pos long, original_name string, clean_name string, core_name string, phash array<bigint>")
    cache = spark.createDataFrame([], "sha256 string, title string, matched_via string")
    return run(files, entries, images, cache)
