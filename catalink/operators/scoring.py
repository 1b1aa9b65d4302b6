"""Scores of (file, entry) pairs from weighted words, page counts, density and titles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from catalink.functions.text import PAGE_BONUS, density_bonus, has_verbatim_title, is_telling_title, page_bonus, page_numbers, significant_words, speaks_of_colour
from catalink.operators import scan
from catalink.operators.select import collected, small

LEAST_WORDS = 20  #: an entry of fewer different words has no overlap score


def idf(entries: DataFrame) -> DataFrame:
    """``word, idf``: log(entries / entries with the word) + 1. ``entries`` has words, an array without repeats."""
    total = entries.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    counts = entries.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(total)).select("word", (F.log(F.col("total") / F.col("df")) + 1).alias("idf"))  # total is one row


def _index(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """``item_id, word, idf, whole``: an inverted index on the words."""
    full = entries.where(F.size("words") >= LEAST_WORDS).select("item_id", F.explode("words").alias("word")).join(weights, "word")
    return full.join(full.groupBy("item_id").agg(F.sum("idf").alias("whole")), "item_id")


def _pairs(files: DataFrame, entries: DataFrame, *values: str) -> StructType:
    out = StructType().add("file_id", files.schema["file_id"].dataType).add("item_id", entries.schema["item_id"].dataType)
    for v in values:
        out = out.add(v, DoubleType())
    return out


def overlap(files: DataFrame, entries: DataFrame, weights: DataFrame) -> DataFrame:
    """``file_id, item_id, overlap``: the weight of shared words over the weight of the entry's words.

    Pairs without a shared word are absent. A file meets the index in its own task, up to a counted size of the index.
    """
    rows = collected(_index(entries, weights))
    if rows is None:
        return joined_overlap(files, entries, weights)
    items = rows["item_id"].combine_chunks().unique()
    index = scan.Overlaps(rows, items)

    def run(batches):
        for part in scan.parts(batches, "_text", len(items)):
            shared = index.of(part.column("words"))
            row, item = np.nonzero(shared)
            yield pa.RecordBatch.from_arrays([part.column("file_id").take(pa.array(row)), items.take(pa.array(item)), pa.array(shared[row, item])], ["file_id", "item_id", "overlap"])

    return files.select("file_id", "words", F.lit("").alias("_text")).mapInArrow(run, _pairs(files, entries, "overlap"))


def joined_overlap(files: DataFrame, entries: DataFrame, weights: DataFrame) -> DataFrame:
    """The same for an index of any size; sums are combined map-side."""
    words = files.select("file_id", F.explode("words").alias("word"))
    return (
        words.join(_index(entries, weights), "word").groupBy("file_id", "item_id")
        .agg(F.round(F.sum("idf") / F.first("whole"), 9).alias("overlap"))
    )


def _titles(entries: DataFrame) -> DataFrame:
    """``item_id, core_title, word`` of telling titles, with their longest word that is neither first nor last: a title may begin or end within a word."""
    inner = significant_words(F.array_join(F.slice("_w", F.lit(2), F.size("_w") - 2), " "))
    telling = entries.where(is_telling_title("core_title")).withColumn("_w", F.split("core_title", " "))
    return telling.select("item_id", "core_title", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))


def verbatim_titles(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``file_id, item_id`` of telling titles that stand in texts."""
    titles = _titles(entries)
    rows = collected(titles)
    if rows is None:
        words = files.select("file_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
        return words.join(titles, "word").where(F.contains("text", F.col("core_title"))).select("file_id", "item_id")
    items = rows["item_id"].combine_chunks()
    index = scan.Titles(rows, items)

    def run(batches):
        for part in scan.parts(batches, "text", len(items)):
            row, item = index.of(part.column("text"), pc.split_pattern(part.column("text"), " "))
            yield pa.RecordBatch.from_arrays([part.column("file_id").take(pa.array(row)), items.take(pa.array(item))], ["file_id", "item_id"])

    return files.select("file_id", "text").mapInArrow(run, _pairs(files, entries))


def bonus_pairs(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``file_id, item_id`` of pairs that have a page or title bonus.

    Pairs that share no word can still be runner-up on bonuses alone. Pages join on the number; the density
    bonus of entries alone never exceeds 0.1 and is given to pairs found otherwise.
    """
    paged = entries.select("item_id", F.explode(F.array_distinct(page_numbers("notes"))).alias("page_count")).where("page_count > 0")
    by_page = files.select("file_id", "page_count").join(small(paged), "page_count").select("file_id", "item_id")
    return by_page.union(verbatim_titles(files, entries)).distinct()


def scores(files: DataFrame, entries: DataFrame, weights: DataFrame, title_bonus: float = 0.2, hidden: Column | None = None) -> DataFrame:
    """``file_id, item_id, score``: overlap plus bonuses, for pairs with a shared word or a page or title bonus.

    A file's words are those of its ``text``, clean, and an entry's the significant ones of its notes. Of entries that
    are ``hidden`` only pairs with files that have their name (clean_name, clean_title) are kept.
    """
    e = entries.withColumn("_hidden", F.coalesce(hidden, F.lit(True)) if hidden is not None else F.lit(False))
    e = e if hidden is not None else e.withColumn("clean_title", F.lit(""))
    f = files if hidden is not None else files.withColumn("clean_name", F.lit(""))
    facts = collected(e.select("item_id", F.array_distinct(page_numbers("notes")).alias("pages"), speaks_of_colour("notes").alias("colour"), "_hidden", "clean_title"))
    words = collected(_index(e, weights)) if facts is not None else None
    if facts is None or words is None:
        return joined_scores(f, e, weights, title_bonus)
    items = facts["item_id"].combine_chunks()
    overlaps, titles = scan.Overlaps(words, items), scan.Titles(collected(_titles(e)), items)
    lists = facts["pages"].combine_chunks()
    page_items = np.repeat(np.arange(len(items)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pages = scan.Postings(lists.flatten(), page_items)
    names = scan.Postings(facts["clean_title"], np.arange(len(items)))
    name, out = names.codes(facts["clean_title"].combine_chunks()), facts["_hidden"].to_numpy()
    colour = facts["colour"].cast("int8").fill_null(-1).to_numpy()

    def run(batches):
        for part in scan.parts(batches, "text", len(items)):
            text, tokens = part.column("text"), pc.split_pattern(part.column("text"), " ")
            shared = overlaps.of(tokens)
            bonus = np.zeros(shared.shape)
            code = pages.codes(part.column("pages"))
            row, at = pages.met(np.flatnonzero(code >= 0), code[code >= 0])
            bonus[row, pages.places[at]] = PAGE_BONUS
            row, item = titles.of(text, tokens)
            bonus[row, item] += title_bonus
            wanted = (shared > 0) | (bonus > 0)
            if out.any():
                wanted &= ~out | (names.codes(part.column("clean_name"))[:, None] == name)
            row, item = np.nonzero(wanted)
            with_colour, plain = part.column("with_colour").to_numpy()[row], part.column("plain").to_numpy()[row]
            density = np.where(colour[item] == 1, with_colour, np.where(colour[item] == 0, plain, 0.0))
            score = scan.rounded(shared[row, item] + bonus[row, item] + density)
            yield pa.RecordBatch.from_arrays([part.column("file_id").take(pa.array(row)), items.take(pa.array(item)), pa.array(score)], ["file_id", "item_id", "score"])

    known = f.select(
        "file_id", "text", "clean_name", F.when(F.col("page_count") > 0, F.col("page_count").cast("int")).alias("pages"),
        density_bonus("bytes_per_page", F.lit("color")).alias("with_colour"), density_bonus("bytes_per_page", F.lit("")).alias("plain"),
    )
    return known.mapInArrow(run, _pairs(files, entries, "score"))


def joined_scores(files: DataFrame, entries: DataFrame, weights: DataFrame, title_bonus: float = 0.2) -> DataFrame:
    """The same for entries of any number; files have clean_name, entries clean_title and _hidden."""
    pairs = joined_overlap(files.withColumn("words", significant_words("text")), entries, weights).join(bonus_pairs(files, entries), ["file_id", "item_id"], "full")
    f = files.select("file_id", "text", "page_count", "bytes_per_page", "clean_name")
    e = small(entries.select("item_id", "notes", "core_title", "clean_title", "_hidden"))
    total = (
        F.coalesce("overlap", F.lit(0.0)) + page_bonus("page_count", "notes") + density_bonus("bytes_per_page", "notes")
        + F.when(has_verbatim_title("core_title", "text"), title_bonus).otherwise(0.0)
    )
    met = pairs.join(f, "file_id").join(e, "item_id").where("NOT _hidden OR clean_title = clean_name")
    return met.select("file_id", "item_id", F.round(total, 9).alias("score"))
