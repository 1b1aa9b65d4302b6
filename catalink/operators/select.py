"""The best candidate and its lead over the next one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalink.functions.text import hamming
from catalink.operators import scan

#: Rows of a dimension, up to which it is broadcast after it has been counted.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose counted size allows it; else leave the join to the shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def collected(df: DataFrame) -> pa.Table | None:
    """The rows of a table that is small enough to be broadcast, else none."""
    rows = df.limit(BROADCAST_ROWS + 1).toArrow()
    return rows if rows.num_rows <= BROADCAST_ROWS else None


def top2(scored: DataFrame, key: str, item: str, score: str, default: float = 0.0, smallest: bool = False) -> DataFrame:
    """``key, item, score, runner_up``: each key's best item and the second's score.

    Ties go to the lesser item, catalog order. Two rows a key survive each task (a
    window group limit), so the candidates of a key never all meet.
    """
    order = F.col(score).asc() if smallest else F.col(score).desc()
    ranked = scored.select(key, item, score).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, item))).where("_r <= 2")
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("_r") == 1, F.col(item))).alias(item), F.max(F.when(F.col("_r") == 1, F.col(score))).alias(score),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(score))), F.lit(default)).alias("runner_up"),
    )


def nearest2(asked: DataFrame, hashes: DataFrame, default: int) -> DataFrame:
    """``file_id, item_id, distance, runner_up``: the hash nearest to each asked one (file_id, a) among all others (item_id, b), by bits that differ.

    Numbers are longs, hashes arrays of longs of one length. Every pair is compared, in the task that reads the hash; a
    task keeps two rows an asked one. Beyond the size of a broadcast, pairs are joined.
    """
    rows = collected(asked.select("file_id", "a"))
    if rows is None:
        pairs = hashes.join(asked, F.col("file_id") != F.col("item_id"))
        return top2(pairs.select("file_id", "item_id", hamming("a", "b").alias("distance")), "file_id", "item_id", "distance", default, smallest=True)
    names, bits = rows["file_id"].to_numpy(), scan.words_of(rows["a"].combine_chunks())

    def run(batches):
        best = (np.zeros(0, dtype=np.int64),) * 3
        for batch in batches:
            if batch.num_rows and len(names):
                found = scan.nearest(names, bits, batch.column("item_id").to_numpy(), scan.words_of(batch.column("b")))
                best = scan.first_two(*(np.concatenate(x) for x in zip(best, found)))
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]], pa.int64()), *map(pa.array, best[1:])], ["file_id", "item_id", "distance"])

    near = hashes.where("item_id IS NOT NULL").select("item_id", "b").mapInArrow(run, "file_id long, item_id long, distance long")
    return top2(near, "file_id", "item_id", "distance", default, smallest=True)


def accept(best: DataFrame, score: str, least: float, margin: float, strict: bool = False) -> DataFrame:
    """Rows that reach the score and lead by the margin (or at all, if ``strict``)."""
    lead = F.col(score) - F.col("runner_up")
    return best.where((F.col(score) >= least) & ((lead > 0) if strict else (F.round(lead, 9) >= margin)))
