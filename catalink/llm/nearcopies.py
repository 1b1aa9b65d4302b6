"""Near copies by likeness: one document of each component of pairs alike in five-word shingles.

Candidates come from SimHash fingerprints of five words (equal, or joined by the Golay keys)
and from bands of minwise hashes, which also reach the pairs that differ in more bits than the
keys allow. Every candidate is verified by the Jaccard likeness of the sets of shingles.
Texts of equal words collapse first. All pairs of a small band are candidates; the rows of a
larger one meet eight of its rows (``Likeness.hubs``), so candidates grow with the rows. Where a larger band then
still holds several components, its rows are compared across them within a task, in blocks, by their minwise hashes
and then by their shingles: no band is cut short, and a task gives links that join components, not all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm.components import components
from catalink.llm.neardup import Neighbours, neighbour_links
from catalink.llm.shared import free_names, slices, stored, width


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    seed: int = 42
    least: float = 0.8  #: Jaccard likeness of two texts that count as near copies
    bands: int = 20
    band: int = 5  #: minwise hashes of a band; a pair of likeness 0.8 shares one of 20 bands at 99.96 %
    group: int = 16  #: rows of a band that all meet each other
    hubs: int = 8  #: rows, the same for all bands where they have them, that the rows of a larger band meet
    nearly: float = 0.64  #: share of equal minwise hashes that two rows of a larger band need to be compared; 99.99 % of pairs at 0.8 have it
    kept: int = 1024  #: least shingles that are compared there; longer texts that seem alike by them, within 4 deviations, are verified as a whole
    block: int = 4096  #: rows of a band that are compared at once


_SHINGLES = 1 << 12  #: hashes that are taken at once


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only


def shingles(w: list[bytes], how: Likeness = Likeness()) -> np.ndarray:
    """Hashes of the shingles, repeats included; of fewer words than one needs, all as one."""
    import xxhash

    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*[w[i:] for i in range(how.words)])) if len(w) >= how.words else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(s, how.seed) for s in runs], np.uint64)


def simhash_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def _factors(how: Likeness) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(how.seed)
    n = how.bands * how.band
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def least_hashes(h: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value that each hash function gives to the shingles."""
    a, b = factors
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), _SHINGLES):
        np.minimum(least, (h[lo : lo + _SHINGLES, None] * a + b).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, how: Likeness) -> np.ndarray:
    """A 64-bit key for each band."""
    import xxhash

    rows = least.astype("<u8").reshape(how.bands, how.band)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64)


def sketches(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``doc_id, text_key, node, fp, bands``: ``node`` is a hash of the words, ``bands`` the keys' bytes (null without a word)."""

    def run(batches):
        import xxhash

        factors = _factors(how)
        for batch in batches:
            for part in slices(batch, 2):
                node, fp, bands = [], [], []
                for t in part.column(2):
                    w = words_of(t.as_py())
                    h = shingles(w, how)
                    node.append(xxhash.xxh64_intdigest(b" ".join(w), how.seed))
                    fp.append(simhash_of(h))
                    bands.append(band_keys(least_hashes(h, factors), how).tobytes() if w else None)
                numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, pa.array(bands, pa.binary())], ["doc_id", "text_key", "node", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, fp long, bands binary")


def shared_bands(nodes: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``key, node, n`` of the bands of ``nodes`` (node, bands) that several nodes have, with their number."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), how.bands))], ["key", "node"])

    keys = stored(nodes.where("bands IS NOT NULL").select("node", "bands").mapInArrow(run, "key long, node long"), "bands")
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def candidates(nodes: DataFrame, met: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``nodes`` (node, fp, bands) -> ``a, b``, a < b: different pairs of nodes that share a small band, a hub or near fingerprints."""
    small, large = met.where(F.col("n") <= how.group), met.where(F.col("n") > how.group)
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").select("a", "b")
    hubs = large.groupBy("key").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).alias(f"h{i}") for i in range(how.hubs)))
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array(*(f"h{i}.node" for i in range(how.hubs))))).alias("b"))
    ends = large.select("key", F.col("node").alias("a")).join(hubs, "key").select("a", "b")

    first = stored(nodes.where("bands IS NOT NULL").groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.where("bands IS NOT NULL").join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = neighbour_links(first.select("fp"), Neighbours(words=how.words, seed=how.seed))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return _different(pairs.union(ends).union(same).union(near.select("x", "y")))


def _different(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compared(texts: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``texts`` (node, text) -> ``node, low, few``: 16 bits of each minwise hash, and the ``kept`` least different shingles in order."""

    def run(batches):
        factors = _factors(how)
        for batch in batches:
            for part in slices(batch, 1):
                low, few = [], []
                for t in part.column(1):
                    h = np.unique(shingles(words_of(t.as_py()), how))
                    low.append((least_hashes(h, factors) >> np.uint64(40)).astype("<u2").tobytes())
                    few.append(h[: how.kept].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(low, pa.binary()), pa.array(few, pa.binary())], ["node", "low", "few"])

    return texts.select("node", "text").mapInArrow(run, "node long, low binary, few binary")


def seem_alike(p: np.ndarray, q: np.ndarray, how: Likeness) -> tuple[bool, bool]:
    """(alike by their least shingles, certain): exact where both have fewer than ``kept``."""
    both = np.intersect1d(p, q, assume_unique=True)
    if len(p) < how.kept and len(q) < how.kept:
        return len(both) >= how.least * (len(p) + len(q) - len(both)), True
    least = np.union1d(p, q)[: how.kept]
    share = np.isin(least, both, assume_unique=True).mean()
    return share >= how.least - 4 * np.sqrt(how.least * (1 - how.least) / len(least)), False


def across(low: np.ndarray, few: list[np.ndarray], comp: np.ndarray, how: Likeness) -> list[tuple[int, int]]:
    """Pairs of rows that are alike, or seem so, and join different ``comp``; each row is compared with all of others'."""
    kind, of, many = np.unique(comp, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(of != many.argmax())  # rows of the largest one meet all others only
    least, rank = how.nearly * low.shape[1], np.full(len(low), -1)
    rank[rest] = np.arange(len(rest))
    pairs = []
    for i in rest.tolist():
        j = np.flatnonzero((of != of[i]) & (rank < rank[i]))
        for k in j[(low[j] == low[i]).sum(axis=1) >= least].tolist():
            if of[k] == of[i]:
                continue  # joined by a row before
            alike, certain = seem_alike(few[i], few[k], how)
            if alike:
                pairs.append((i, k))
            if alike and certain:
                of[of == of[i]] = of[k]
    return pairs


def crossing(met: DataFrame, roots: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``key, node, n, comp``: the rows of larger bands that hold several components of ``roots``."""
    large = met.where(F.col("n") > how.group).select("key", "node", "n").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    several = large.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return large.join(several, "key", "left_semi")


def unmet(rest: DataFrame, texts: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``a, b``: pairs of nodes that are alike, or seem so, and join the components of ``crossing``."""
    rows = rest.join(compared(texts, how), "node")
    blocks = F.ceil(F.col("n") / how.block).cast("int")
    split = (
        rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        # a pair of blocks is named by hash; rows of two pairs that share a name are compared too, which does no harm
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "comp", "node", "low", "few")
    )

    def found(group):
        # a RecordBatch; its rows are whole groups
        for lo, hi in zip(*_runs(group.column(0).to_numpy())):
            own = group.slice(lo, hi - lo)
            low = np.frombuffer(b"".join(own.column(3).to_pylist()), "<u2").reshape(hi - lo, -1)
            pairs = across(low, [np.frombuffer(x, np.uint64) for x in own.column(4).to_pylist()], own.column(1).to_numpy(), how)
            node = own.column(2).to_numpy()
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(node[list(a)]), pa.array(node[list(b)])], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left")) if key[0] != key[-1] or (held and held[0].column(0)[0].as_py() != key[-1]) else -1
            if last < 0:
                held.append(batch)
                continue
            yield from found(_joined([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield from found(_joined(held))

    pairs = split.repartition(width(split.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return _different(pairs)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if sum(b.num_rows for b in batches) else batches[0]


def _runs(key: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal keys begin and end."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])).tolist() if len(key) else [0]
    return edges[:-1], edges[1:]


def verified(pairs: DataFrame, texts: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """Of ``pairs`` (a, b), those whose ``texts`` (node, text) are alike enough."""

    def run(batches):
        known: dict[int, np.ndarray] = {}

        def of(node, text):
            if node not in known:
                if len(known) >= 500:
                    known.clear()
                known[node] = np.unique(shingles(words_of(text.as_py()), how))
            return known[node]

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            good = []
            for i, (x, y) in enumerate(zip(a, b)):
                p, q = of(x, batch.column(2)[i]), of(y, batch.column(3)[i])
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= how.least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c, t: texts.select(F.col("node").alias(c), F.col("text").alias(t))
    return pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``doc_id, text_key, root``, a row for each row of ``docs`` (doc_id, text): ``root`` names its component.

    Texts without a word, null ones among them, are a component. Long texts are taken whole.
    """
    rows = stored(sketches(docs, how), "sketches")
    nodes = stored(rows.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    met = stored(shared_bands(nodes, how), "met")

    def texts(wanted: DataFrame) -> DataFrame:
        one = nodes.join(wanted.distinct(), "node", "left_semi").select("node", "text_key")
        of = docs.select(F.xxhash64("text").alias("text_key"), "text").join(one, "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
        return stored(of.join(one, "text_key").select("node", "text"), "texts")

    pairs = stored(candidates(nodes, met, how), "candidates")
    links = stored(verified(pairs, texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), how), "verified")
    roots = components(links)
    rest = stored(crossing(met, roots, how), "crossing")
    if not rest.isEmpty():
        own = texts(rest.select("node"))
        more = stored(verified(stored(unmet(rest, own, how), "unmet"), own, how), "verified")
        roots = components(links.union(more))
    return rows.select("doc_id", "text_key", "node").join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """One row of each component: of its smallest id (null only if it has no other), and of that id's texts one.

    Rows equal in id and text count as one, whichever of them stays; ids need not be different. All columns are kept, whatever their names.
    An empty table stays empty.
    """
    labels = stored(labelled(docs, how), "labels")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("text_key").alias("k2")))
    keep = labels.groupBy("root").agg(least.alias("k")).select("k.*")
    own = free_names(docs.columns, "id_null", "id", "text_key")
    keep = keep.toDF(*free_names([*docs.columns, *own], "keep_null", "keep_id", "keep_key"))
    rows = docs.withColumns(dict(zip(own, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")))))
    same = [F.col(a) == F.col(b) for a, b in zip(own, keep.columns)]
    return rows.join(keep, same, "left_semi").dropDuplicates(own).select(*docs.columns)
