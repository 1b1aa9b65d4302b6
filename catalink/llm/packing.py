"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A map over the texts cuts each document's ids into pieces: whole windows, then
near-equal parts of what is left. Only rows of a few numbers leave it. These are
dealt at random into groups of bounded size, and each group's parts are spread over
its own windows by multiway differencing.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm.shared import documents, slices, stored
from catalink.llm.tokenizing import CACHED, encoder, vocabulary


@dataclass(frozen=True)
class Packing:
    tokenizer: str = "word_bpe_49k.json"
    end: int = 2
    window: int = 4096
    part: int = 1024  #: what is left of a document is cut into near-equal parts of at most this
    group: int = 1024  #: parts that are spread together, about
    batch: int = 8 << 20  #: bytes of text that are encoded at once, about
    cached: int = CACHED  #: entries of each of the tokenizer's caches


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spread ``sizes`` over ``k`` windows: (window of each, sum of each window).

    Each size starts as a partial partition of k sums. The two partitions of the
    widest spread are merged, the largest sums of one with the smallest of the
    other, until one is left; ties go to the older partition.
    """
    sums = [np.zeros(k, np.int64) for _ in sizes]
    for s, n in zip(sums, sizes):
        s[0] = n
    heap = [(-int(n) if k > 1 else 0, i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        merged.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums)))
        sums.append(both)
    n = len(sizes)
    slots: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    window = np.zeros(n, np.int64)
    for node in range(len(sums) - 1, -1, -1):
        at = slots.pop(node)
        if node < n:
            window[node] = at[0]
        else:
            a, b, order = merged[node - n]
            slots[a], slots[b] = np.empty(k, np.int64), np.empty(k, np.int64)
            slots[a][order] = at
            slots[b][k - 1 - order] = at
    return window, sums[-1]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; the number of windows rises until none is over capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, k)
        if sums.max() <= capacity:
            return window
        k += max(1, int(np.maximum(sums - capacity, 0).sum()) // capacity)


def cut(ids: np.ndarray, how: Packing) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces."""
    whole = len(ids) // how.window * how.window
    rest = len(ids) - whole
    parts = -(-rest // how.part)
    edges = [*range(0, whole, how.window), *(whole + rest * i // max(parts, 1) for i in range(parts)), len(ids)]
    wide = ids.astype("<u4")
    return [(a, b - a, zlib.crc32(wide[a:b])) for a, b in zip(edges, edges[1:])]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """A row for each piece, with a number ``row`` that is the piece's own."""
    path = vocabulary(how.tokenizer)

    def run(batches):
        enc, row = encoder(path, False, how.cached), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1, 3000, how.batch):
                ids, ends = enc.encode_all(part.column(1), how.end)
                out, lo = [], 0
                for doc_id, hi in zip(part.column(0).to_pylist(), ends.tolist()):
                    for start, length, crc in cut(ids[lo:hi], how):
                        out.append((doc_id, start, length, crc, hi - lo, row))
                        row += 1
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{_PIECE}, row long")


def pack(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with ``sequence_id`` and ``offset``.

    Null and empty texts give one piece, the end id alone. Rows equal in id and text are
    packed each for itself. A piece of a whole window is a sequence alone. Other
    columns are ignored; an empty table gives no piece.
    """
    table = stored(pieces(docs, how), "pieces")
    groups = max(1, round(table.where(F.col("length") < how.window).count() / how.group))

    def spread(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        length = group["length"].to_numpy()
        full = length == how.window
        seq = np.empty(len(length), np.int64)
        parts = length[~full]
        seq[~full] = windows(parts, how.window) if len(parts) else 0
        first = int(seq[~full].max()) + 1 if len(parts) else 0
        seq[full] = first + np.arange(full.sum())
        order = np.argsort(seq, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        starts = np.concatenate([[True], np.diff(seq[order]) > 0])
        offset = np.empty_like(seq)
        offset[order] = before - np.maximum.accumulate(np.where(starts, before, 0))
        sequence_id = (group["pk_group"].to_numpy() << 32) + seq
        return group.drop_columns(["row", "pk_group"]).append_column("sequence_id", pa.array(sequence_id)).append_column("offset", pa.array(offset))

    grouped = table.withColumn("pk_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return grouped.groupBy("pk_group").applyInArrow(spread, f"{_PIECE}, sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
