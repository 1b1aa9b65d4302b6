"""Directories of documents and images, and features that outside tools extract from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalink.functions.text import clean_text, split_name, strip_code

IMAGES = ("png", "jpg", "jpeg", "bmp", "gif")
IGNORED = ("thumbs.db", "desktop.ini")


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """``pos, path, file_name, stem, ext, size, mtime`` of a directory's files, in order of name; contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
        .select("path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    parts = split_name("file_name")
    return rows.select(
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file_name")) - 1).cast("long").alias("pos"),  # names only
        "path", "file_name", parts["stem"].alias("stem"), F.lower(parts["ext"]).alias("ext"), "size", "mtime",
    )


def documents_in(spark: SparkSession, directory: str) -> DataFrame:
    return listing(spark, directory).where("ext = '.pdf'")


def others_in(spark: SparkSession, directory: str) -> DataFrame:
    """Files that are no documents and no system files."""
    return listing(spark, directory).where(~F.lower("file_name").isin(*IGNORED) & (F.col("ext") != ".pdf"))


def images_in(spark: SparkSession, directory: str) -> DataFrame:
    """``pos, original_name, clean_name, core_name, path``."""
    rows = listing(spark, directory).where(F.col("ext").isin(*[f".{e}" for e in IMAGES]))
    clean = clean_text("stem")
    return rows.select("pos", F.col("stem").alias("original_name"), clean.alias("clean_name"), strip_code(clean).alias("core_name"), "path")


def hashed(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Add ``sha256`` of each file's bytes, read in pieces; null if it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyarrow import fs

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    files, at = fs.FileSystem.from_uri(path)
                    digest = hashlib.sha256()
                    with files.open_input_stream(at) as f:
                        while piece := f.read(4 << 20):
                            digest.update(piece)
                    out.append(digest.hexdigest())
                except OSError:
                    out.append(None)
            yield pdf.assign(sha256=out)

    return files.mapInPandas(run, f"{files._jdf.schema().toDDL()}, sha256 string")


def extracted(files: DataFrame, extractor: Callable[[str], dict], schema: str = "page_count int, text string, ocr_front string, ocr_back string, cover_hash array<bigint>") -> DataFrame:
    """Add what ``extractor(path)`` finds. It runs only on the rows given, so give it those that cheaper layers left.

    An extractor that fails leaves its row without features; a time limit is its own affair.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    found = extractor(path)
                except Exception:
                    found = {}
                rows.append([found.get(n) for n in names])
            yield pd.concat([pdf, pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)

    return files.mapInPandas(run, f"{files._jdf.schema().toDDL()}, {schema}")


def pages_to_read(count: int, first: int = 20, last: int = 10) -> list[int]:
    """The pages whose text is taken: the first and the last ones."""
    return sorted({*range(min(first, count)), *range(max(0, count - last), count)})


def confident_text(words: DataFrame) -> DataFrame:
    """``page, threshold, word, conf`` rows -> the text of each page at its most confident threshold (the first of equal ones).

    Words of negative confidence and blank ones don't count; a page stops at the first threshold that reaches 80."""
    good = words.where((F.col("conf") >= 0) & (F.trim("word") != ""))
    each = good.groupBy("page", "threshold").agg(F.avg("conf").alias("conf"), F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]).alias("w"))
    enough = each.where("conf >= 80").groupBy("page").agg(F.min("threshold").alias("stop"))
    tried = each.join(enough, "page", "left").where(F.col("stop").isNull() | (F.col("threshold") <= F.col("stop")))
    best = tried.groupBy("page").agg(F.max_by(F.struct("w", "conf"), F.struct("conf", -F.col("threshold"))).alias("b"))
    return best.select("page", F.array_join("b.w", " ").alias("text"), F.col("b.conf").alias("conf"))
