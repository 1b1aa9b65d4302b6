"""Near-duplicates by SimHash: Golay keys give candidates, Hamming distance verifies.

Copies of a fingerprint collapse first (a minimum, combined map-side). The keys of the
distinct fingerprints are sorted by key, and a task walks over its groups with numpy,
emitting a spanning forest of the links it verified, never all pairs. A group beyond
``Neighbours.group`` rows leaves the first walk as it came and is split into blocks;
each pair of blocks is then a group of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.llm import golay
from catalink.llm.components import components
from catalink.llm.shared import documents, stored, width


@dataclass(frozen=True)
class Neighbours:
    words: int = 3
    seed: int = 42
    distance: int = 3  #: what the keys are made for
    group: int = 20_000  #: rows of a key that one task compares among themselves


_SHINGLES = 1 << 16  #: hashes whose bits are counted at once


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set if over half of the hashed shingles have it; 0 without a word."""
    import xxhash

    w = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    count = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _SHINGLES):
        part = w[lo : lo + _SHINGLES + words - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
        h = np.array([digest(s, seed) for s in shingles], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, how: Neighbours = Neighbours()) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of whole texts; null text is an empty one."""

    def run(batches):
        for batch in batches:
            fps = np.array([simhash(t.as_py(), how.words, how.seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a-b connects: each node with the least one of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _walk(fp: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect the neighbours in a large group: each step compares with what no link has reached."""
    left, a, b, todo = np.unique(fp), [], [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        p = todo.pop()
        near = np.bitwise_count(left ^ p) <= distance
        if near.any():
            found, left = left[near], left[~near]
            a.append(np.full(len(found), p, np.uint64))
            b.append(found)
            todo.extend(found)
        if not len(left):
            break
    return a, b


def links_in(key: np.ndarray, role: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of equal keys; ``key`` is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([starts, [len(key)]]))
    a, b = [], []
    for s, n in zip(starts[size > 64], size[size > 64]):
        x, y = _walk(fp[s : s + n], distance)
        a += x
        b += y
    i = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
    for step in range(1, 64):
        i = i[i + step < len(key)]
        i = i[key[i] == key[np.minimum(i + step, len(key) - 1)]]
        if not len(i):
            break
        j = i + step
        ok = ((role[i] & golay.LEFT) & ((role[j] & golay.RIGHT) >> 1)) | (((role[i] & golay.RIGHT) >> 1) & (role[j] & golay.LEFT))
        p, q = i[ok.astype(bool)], j[ok.astype(bool)]
        n_bits = np.bitwise_count(fp[p] ^ fp[q])
        good = (n_bits <= distance) & (n_bits > 0)
        a.append(fp[p[good]])
        b.append(fp[q[good]])
    if not a or not sum(map(len, a)):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


_CHUNK = 1 << 20  #: rows of whole groups that are compared at once


def _groups(batches, limit: int):
    """Sorted batches -> (key, role, fp) arrays of whole groups; with True instead, parts of groups over ``limit``."""
    held: list[tuple[np.ndarray, ...]] = []
    rows, large = 0, None
    for batch in batches:
        part = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if large is not None:
            n = int(np.searchsorted(part[0], large, "right"))
            if n:
                yield True, tuple(x[:n] for x in part)
                part = tuple(x[n:] for x in part)
            if not len(part[0]):
                continue
            large = None
        held.append(part)
        rows += len(part[0])
        if rows < _CHUNK and held[0][0][0] != part[0][-1]:
            continue
        if rows < min(_CHUNK, limit):
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(whole[0], whole[0][-1], "left"))
        if last:
            yield from _split(tuple(x[:last] for x in whole), limit)
        rest = tuple(x[last:] for x in whole)
        held, rows = [rest], len(rest[0])
        if rows > limit:
            large = rest[0][0]
            yield True, rest
            held, rows = [], 0
    if held and rows:
        yield from _split(tuple(np.concatenate(x) for x in zip(*held)), limit)


def _split(whole, limit: int):
    key = whole[0]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([starts, [len(key)]]))
    for s, n in zip(starts[size > limit], size[size > limit]):
        yield True, tuple(x[s : s + n] for x in whole)
    small = np.repeat(size <= limit, size)
    if small.any():
        yield False, tuple(x[small] for x in whole)


_LINK = "key long, role byte, a long, b long"


def _linked(rows: DataFrame, by: list[str], distance: int, limit: int) -> DataFrame:
    """Links (key null) of groups of equal ``key``, and the rows (b null) of groups over ``limit``."""

    def run(batches):
        for over, (key, role, fp) in _groups(batches, limit):
            if over:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(fp), pa.nulls(len(fp), pa.int64())], ["key", "role", "a", "b"])
                continue
            a, b = links_in(key, role, fp.view(np.uint64), distance)
            for lo in range(0, len(a), 50_000):
                x, y = a[lo : lo + 50_000].view(np.int64), b[lo : lo + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int8()), pa.array(x), pa.array(y)], ["key", "role", "a", "b"])

    return rows.sortWithinPartitions(*by).select("key", "role", "fp").mapInArrow(run, _LINK)


def neighbour_links(distinct: DataFrame, how: Neighbours = Neighbours()) -> DataFrame:
    """``distinct`` (fp) -> ``a, b``: links that connect all fingerprints within the distance."""
    if how.distance > 3:
        raise ValueError("the keys find neighbours at 3 bits at most")
    spark = distinct.sparkSession

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                fp = batch.column(0).slice(lo, 5000).to_numpy().view(np.uint64)
                key, role, fp = golay.keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(fp.view(np.int64))], ["key", "role", "fp"])

    keys = distinct.select("fp").mapInArrow(run, "key long, role byte, fp long").repartition(width(spark), "key")
    found = stored(_linked(keys, ["key"], how.distance, how.group), "neighbours")
    links, large = found.where("key is null").select("a", "b"), found.where("key is not null")
    if large.isEmpty():
        return links
    blocks = F.ceil(F.col("n") / how.group).cast("int")
    split = (
        large.select("key", "role", F.col("a").alias("fp")).join(large.groupBy("key").agg(F.count("*").alias("n")), "key")
        .withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        # a pair of blocks is named by hash; rows of two pairs that share a name are compared too, which does no harm
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.lit(3).cast("byte").alias("role"), "fp")
    )
    pairs = _linked(split.repartition(width(spark), "key"), ["key"], how.distance, 1 << 62)
    return links.union(pairs.select("a", "b"))


def near_duplicates(docs: DataFrame, how: Neighbours = Neighbours()) -> DataFrame:
    """``doc_id, fp, component_id``, a row for each row of ``docs`` (doc_id, text).

    The component is that of links at ``distance`` bits or fewer, its id the smallest doc_id
    in it. Null and empty texts have fingerprint 0 and are linked like any other; long texts are taken whole. Null
    ids never name a component unless it has no other. Repeated rows are in one component, each with
    a row of its own. Other columns are ignored; an empty table gives no row.
    """
    rows = stored(fingerprints(docs, how), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct").withColumn("node", F.xxhash64("fp"))
    links = neighbour_links(distinct, how).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    roots = components(links)
    of = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
