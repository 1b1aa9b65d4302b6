"""Quality scores by histogram gradient-boosted trees over document statistics.

One map computes every document's statistics from its whole text; the model is fitted
on the driver on a bounded sample of labelled rows, and its trees, complete and
of equal depth, are arrays that numpy walks for a whole batch at once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.llm.shared import documents, held_out, stored


@dataclass(frozen=True)
class Boosting:
    sample: int = 20_000  #: labelled rows, at most, on which the model is fitted
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    least: float = 1.0  #: sum of second derivatives that a leaf needs
    threshold: float = 0.3  #: scores from here on are predicted 1


def _classes() -> np.ndarray:
    """Bytes of UTF-8 by kind: letters, capitals, digits, white space, stops, symbols, ! and ?, bars, bytes beyond ASCII."""
    kinds = (
        b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"-()",
        b"#$%&*+/<=>@[\\]^_`{}~", b"!?", b"|", bytes(range(128, 256)),
    )
    out = np.zeros((256, len(kinds)))
    for i, k in enumerate(kinds):
        out[list(k), i] = 1
    return out


_KINDS = _classes()
STATISTICS = (
    "log_bytes", "letters", "capitals", "digits", "space", "stops", "symbols", "marks", "bars", "beyond_ascii",
    "log_words", "word_length", "distinct", "commonest", "same_as_last", "longest_run", "short_words", "ends_in_symbol", "longest_word",
    "lines", "line_length", "repeated_lines", "closed_lines", "repeated_triples", "compressed", "capitalised",
)


def statistics(text: str | None) -> list[float]:
    """``STATISTICS`` of a text; an empty one gives zeros."""
    data = (text or "").encode()
    words = (text or "").split()
    if not words:
        return [math.log1p(len(data)), *[0.0] * (len(STATISTICS) - 1)]
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS / len(data)
    n, count = len(words), Counter(words)
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        math.log1p(len(data)), *share.tolist(), math.log1p(n), float(lengths.mean()), len(count) / n, count.most_common(1)[0][1] / n,
        sum(same) / n, longest / n, float((lengths <= 2).mean()), sum(w[-1] in "#$%&*|!~^=" for w in words) / n, math.log1p(int(lengths.max())),
        math.log1p(len(lines)), math.log1p(len(data) / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / len(lines),
        1 - triples, len(zlib.compress(data, 1)) / len(data), sum(w[:1].isupper() for w in words) / n,
    ]


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every row."""

    def run(batches):
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<float>")


@dataclass
class Model:
    base: float
    feature: np.ndarray  #: (trees, 2**depth - 1), node i has children 2i+1 and 2i+2
    limit: np.ndarray  #: a row with more goes right
    leaf: np.ndarray  #: (trees, 2**depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:  # all rows are at the same depth
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()) -> Model:
    """Boosted trees for log loss; splits come from histograms of the derivatives over quantile bins."""
    inner, leaves = (1 << how.depth) - 1, 1 << how.depth
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Model(math.log(p / (1 - p)), np.zeros((how.trees, inner), np.int64), np.full((how.trees, inner), np.inf), np.zeros((how.trees, leaves)))
    if len(np.unique(y)) < 2:
        return model
    n, width = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # bin b: up to edge b
    total = np.full(n, model.base)
    for t in range(how.trees):
        pred = 1 / (1 + np.exp(-total))
        g, h = pred - y, pred * (1 - pred)
        node = np.zeros(n, np.int64)
        for level in range(how.depth):
            first, many = (1 << level) - 1, 1 << level
            at = (((node - first)[:, None] * width + np.arange(width)) * how.bins + binned).ravel()
            shape = (many, width, how.bins)
            sums = [np.bincount(at, np.repeat(v, width), many * width * how.bins).reshape(shape).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + how.ridge) + (gt - gl) ** 2 / (ht - hl + how.ridge) - gt**2 / (ht + how.ridge)
            gain[(hl < how.least) | (ht - hl < how.least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), how.bins)
                if gain[i, f, cut] > 1e-6 and cut < len(edges[f]):
                    model.feature[t, first + i], model.limit[t, first + i] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.limit[t, node])
        leaf = node - inner
        value = -np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + how.ridge) * how.rate
        model.leaf[t] = value
        total += value[leaf]
    return model


def picked(labels: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """``doc_id, quality`` of labelled rows that are not held out, ``how.sample`` of them at most, by hash of their id."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(how.sample)


def fitted(stats: DataFrame, labels: DataFrame, how: Boosting = Boosting()) -> Model:
    """A model of ``labels.quality`` from the rows that ``picked`` gives."""
    rows = stats.join(F.broadcast(picked(labels, how)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "stats").limit(how.sample).collect()
    x = np.array([r["stats"] for r in rows], np.float32).reshape(len(rows), len(STATISTICS))
    return fit(x.astype(np.float64), np.array([float(r["quality"] > 0) for r in rows]), how)


def scored(docs: DataFrame, labels: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each row of ``docs`` (doc_id, text).

    Null text counts as empty and is scored like any other; a null id is held out only if crc32 of the empty
    text says so. Rows repeat as they do in ``docs``; other columns are ignored; long texts are taken whole; an empty
    table gives no row. Without labels of both kinds the score is their share, or 0.5.
    """
    stats = stored(featured(docs), "stats")
    model = docs.sparkSession.sparkContext.broadcast(fitted(stats, labels, how))

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = model.value.score(flat.reshape(batch.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be of quality, with all their columns, whatever their names.

    Null texts count as empty ones; rows of equal text share their fate; without labels of both kinds all go or stay. The
    model is fitted on the statistics of the labelled rows only; an empty table stays empty.
    """
    few = docs.select("doc_id", "text").join(F.broadcast(picked(labels, how).select("doc_id").distinct()), "doc_id", "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(fitted(stored(featured(few), "stats"), labels, how))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            score = model.value.score(np.array([statistics(t.as_py()) for t in texts], np.float32).astype(np.float64).reshape(batch.num_rows, -1))
            yield batch.filter(pa.array(score >= how.threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
