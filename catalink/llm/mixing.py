"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Within a source the rows stand in key order;
a source's budget is some whole epochs plus a rest, and the rest takes the rows
below one cut in that order. The cut is found without sorting everything: the
first hex digits of the key deal the rows into ranges, sums by range (combined
map-side) give distributed prefix sums, and only the range that holds the cut is
sorted row by row. The final pass is a map over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalink.llm.shared import WORD, documents, stored

#: A plan of at most so many sources is broadcast; a larger one is joined by shuffle,
#: where adaptive execution splits the partitions of a hot source.
BROADCAST_SOURCES = 20_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5  #: of all words, what the mix takes
    epochs: float = 2.0  #: of its own words, what a source gives at most
    seed: str = "mix"
    range_digits: int = 3  #: hex digits of the key that name a range: 16**3 a source


def keyed(docs: DataFrame, mix: Mix) -> DataFrame:
    """``mx_row`` (the row), ``doc_id, source, mx_size, mx_key, mx_range``; rows share a key only if both id and text are equal."""
    identity = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    body = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mx_row"), "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("mx_size"),
        F.concat(identity, body).alias("mx_key"), F.substring(identity, 1, mix.range_digits).alias("mx_range"),
    )


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source, source_size`` -> with ``target``.

    Sources in code-point order, null last, take the weights in turn. A source's
    target is lambda times its weight or its ceiling, whichever is less; sorted by
    ceiling over weight, the sources at their ceiling come first, so lambda comes
    from running sums (one row a source).
    """
    all_rows = Window.partitionBy(F.lit(0))
    by_name = all_rows.orderBy(F.col("source").asc_nulls_last())
    by_ratio = all_rows.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), ((F.row_number().over(by_name) - 1) % len(mix.weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", turn)
        .withColumn("ceiling", F.lit(mix.epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
        .withColumn("budget", F.lit(mix.share) * F.sum("source_size").over(all_rows))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("ceiling").over(upto), F.lit(0.0))) / F.sum("weight").over(here_on))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("lambda", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole))
        .select("source", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("lambda") * F.col("weight")).alias("target"))
    )


def cuts(slim: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: its target, whole epochs, and the key at which the rest ends."""
    ranges = stored(slim.groupBy("source", "mx_range").agg(F.sum("mx_size").alias("in_range")), "ranges")
    plan = (
        targets(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), mix)
        .withColumn("words", F.floor("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
    )
    in_order = Window.partitionBy("source").orderBy("mx_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("range_before", F.coalesce(F.sum("in_range").over(in_order), F.lit(0)))
    holds = (F.col("range_before") <= F.col("rest")) & (F.col("rest") < F.col("range_before") + F.col("in_range"))
    cut_range = _match(plan, before, "source").where(holds).select("source", "mx_range", "range_before", "rest")
    by_key = Window.partitionBy("source").orderBy("mx_key").rowsBetween(Window.unboundedPreceding, -1)
    keys = (
        _match(slim, _small(cut_range), "source", "mx_range")
        .groupBy("source", "mx_key", "range_before", "rest").agg(F.sum("mx_size").alias("at_key"), F.count("*").alias("ties"))
        .withColumn("key_before", F.col("range_before") + F.coalesce(F.sum("at_key").over(by_key), F.lit(0)))
        .where((F.col("key_before") <= F.col("rest")) & (F.col("rest") < F.col("key_before") + F.col("at_key")))
        .select("source", F.col("mx_key").alias("cut_key"), F.expr("(rest - key_before) div ties").alias("cut_words"))
    )
    return stored(_match(plan, keys, "source", how="left").select("source", "source_size", "target", "whole", "cut_key", "cut_words"), "cuts")


def _match(left: DataFrame, right: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null."""
    for c in on:
        right = right.withColumnRenamed(c, f"mx_r_{c}")
    condition: Column = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"mx_r_{c}"))
    return left.join(right, condition, how).drop(*[f"mx_r_{c}" for c in on])


def _small(plan: DataFrame) -> DataFrame:
    """Broadcast a table of one row a source if its counted size allows it."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


_RESULTS = ("size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, mix: Mix, slim: bool = False) -> DataFrame:
    """``doc_id`` and the results, and the row itself as ``mx_row`` unless ``slim``."""
    rows = keyed(docs, mix)
    light = stored(rows.select("doc_id", "source", "mx_size", "mx_key", "mx_range"), "mixkeys")
    plan = cuts(light, mix)
    plan = _small(plan.select(F.col("source"), *[F.col(c).alias(f"mx_{c}") for c in ("source_size", "target", "whole", "cut_key", "cut_words")]))
    more = (
        F.when(F.col("mx_key") < F.col("mx_cut_key"), F.col("mx_size"))
        .when(F.col("mx_key") == F.col("mx_cut_key"), F.col("mx_cut_words"))
        .otherwise(F.lit(0))
    )
    return _match(light if slim else rows, plan, "source").select(
        *(() if slim else ("mx_row",)), "doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"),
        (F.col("mx_whole") * F.col("mx_size") + more).cast("long").alias("taken"),
    )


def mix_sources(docs: DataFrame, mix: Mix = Mix(), slim: bool = False) -> DataFrame:
    """Add ``size, source_size, target, taken`` to every row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns pass through, whatever their names, but
    columns of the four result names are replaced. ``taken`` counts the words the mix
    takes of the row, repeats included: whole epochs, one more below the cut, and
    at the cut the words still missing (rows equal in id and text share these
    equally). Null text has size 0, long texts count whole; null sources form one source, the last. An
    empty table gives an empty result. ``slim`` keeps only doc_id and the results.
    """
    out = _mixed(docs, mix, slim)
    return out if slim else out.select(*(F.col(f"mx_row.`{c}`") for c in docs.columns if c not in _RESULTS), *_RESULTS)


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: rows of ``docs``, each once per epoch it is taken for.

    Whole texts only: the row at the cut is taken again if at least half of its
    words are. A row of no words, null text included, is kept once; repeated rows are each taken so often. All columns
    keep their values, whatever their names; an empty table stays empty.
    """
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    repeated = _mixed(docs, mix).withColumn("mx_times", times).where("mx_times > 0").withColumn("mx_time", F.explode(F.sequence(F.lit(1), "mx_times")))
    return repeated.select(*(F.col(f"mx_row.`{c}`") for c in docs.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), slim=True)


OP9_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) || md5(coalesce(text, '')) AS k
  FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
         2.0::DOUBLE * source_size AS ceiling, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget
  FROM sized),
levelled AS (
  SELECT *, ceiling / weight AS ratio,
         (budget - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
plan AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level THEN ceiling
              ELSE (SELECT max_by(level, -ratio) FROM (SELECT level, ratio FROM levelled WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1)) * weight END AS target
  FROM levelled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole,
         CAST(floor(target) AS BIGINT) - CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END * source_size AS rest
  FROM plan),
keys AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS at_key, count(*) AS ties FROM rows_ GROUP BY source, k),
running AS (
  SELECT *, CAST(coalesce(sum(at_key) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM keys)
SELECT r.doc_id, r.size, p.source_size, p.target,
       CAST(p.whole * r.size + CASE WHEN u.before + u.at_key <= p.rest THEN r.size
                                    WHEN u.before < p.rest THEN (p.rest - u.before) // u.ties ELSE 0 END AS BIGINT) AS taken
FROM rows_ r
JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
JOIN running u ON u.source IS NOT DISTINCT FROM r.source AND u.k = r.k
"""
