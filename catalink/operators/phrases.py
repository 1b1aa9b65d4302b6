"""Phrase matches: long runs of words that a text shares with an entry."""

from __future__ import annotations

import difflib

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DataType, DoubleType, LongType, StructType

from catalink.operators import scan
from catalink.operators.select import collected, small

RUN = 4  #: words of the shortest run that counts


def shingles(clean: Column) -> Column:
    """The different runs of ``RUN`` words of a clean text."""
    words = F.split(clean, " ")
    n = F.greatest(F.size(words) - (RUN - 1), F.lit(0))
    # shifted copies side by side: a lambda that sliced the words would split the text for each run
    side = F.arrays_zip(*[F.slice(words, F.lit(i + 1), n) for i in range(RUN)])
    return F.array_distinct(F.transform(side, lambda x: F.concat_ws(" ", *[x[str(i)] for i in range(RUN)])))


def _runs(entries: DataFrame) -> DataFrame:
    return entries.select("item_id", F.explode(shingles(F.col("clean_notes"))).alias("s"))


def shingle_candidates(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``file_id, item_id, shared``: pairs that share a run. A matching block of ``RUN`` words or more is one, so none is lost."""
    runs = collected(_runs(entries))
    if runs is None:
        f = files.select("file_id", F.explode(shingles(F.col("text"))).alias("s"))
        return f.join(_runs(entries), "s").groupBy("file_id", "item_id").agg(F.count("*").alias("shared"))
    return _met(files, entries, runs, "shared", LongType(), lambda text, place, shared: shared)


def _met(files: DataFrame, entries: DataFrame, runs: pa.Table, name: str, kind: DataType, value, least_text: int = 0) -> DataFrame:
    """``file_id, item_id`` and a value of each pair that shares a run, in one pass over the files; ``value`` gets texts, places of entries and numbers of shared runs."""
    items = runs["item_id"].combine_chunks().unique()
    index = scan.Shingles(runs, items, RUN)

    def run(batches):
        for part in scan.parts(batches, "text", 1):
            part = part.filter(pc.greater_equal(pc.utf8_length(part.column("text")), least_text))  # here, as Spark would clean a text again for its filter
            row, place, shared = index.of(part.column("text"))
            row = pa.array(row)
            made = value(part.column("text").take(row), items.take(pa.array(place)), pa.array(shared))
            yield pa.RecordBatch.from_arrays([part.column("file_id").take(row), items.take(pa.array(place)), made], ["file_id", "item_id", name])

    out = StructType().add("file_id", files.schema["file_id"].dataType).add("item_id", entries.schema["item_id"].dataType).add(name, kind)
    return files.select("file_id", "text").mapInArrow(run, out)


def share(text: str, notes: str) -> float:
    """Words in matching blocks of ``RUN`` or more, over the notes' words (Ratcliff-Obershelp)."""
    a, b = text.split(), notes.split()
    if not a or not b:
        return 0.0
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    return sum(m.size for m in blocks if m.size >= RUN) / len(b)


@pandas_udf(DoubleType())
def block_share(text: pd.Series, notes: pd.Series) -> pd.Series:
    return pd.Series([share(t, n) for t, n in zip(text, notes)])


def phrase_scores(files: DataFrame, entries: DataFrame, least_text: int = 100) -> DataFrame:
    """``file_id, item_id, score`` of the candidate pairs; texts shorter than ``least_text`` have none."""
    runs, notes = collected(_runs(entries)), collected(entries.select("item_id", "clean_notes"))
    if runs is None or notes is None:
        f = files.where(F.length("text") >= least_text)
        pairs = shingle_candidates(f, entries).select("file_id", "item_id")
        e = small(entries.select("item_id", "clean_notes"))
        return pairs.join(f.select("file_id", "text"), "file_id").join(e, "item_id").select("file_id", "item_id", F.round(block_share("text", "clean_notes"), 9).alias("score"))
    known = dict(zip(notes["item_id"].to_pylist(), notes["clean_notes"].to_pylist()))

    def value(texts, items, shared):
        return pa.array([share(t.as_py(), known[i]) for t, i in zip(texts, items.to_pylist())], pa.float64())

    return _met(files, entries, runs, "score", DoubleType(), value, least_text).withColumn("score", F.round("score", 9))
