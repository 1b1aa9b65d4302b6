"""Review by people: what is put before them, and what their decisions do, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.operators.catalog import first_claims

#: What a decision may be. The last two end the review at their row; ``switch_to_auto`` hands the rest to the automated run.
DECISIONS = ("yes", "no", "keep", "stop", "switch_to_auto")


def already_correct(files: DataFrame, titles: DataFrame) -> DataFrame:
    """Add ``is_correct``: the stem is a title of the catalog already."""
    known = titles.select(F.col("title").alias("_t")).distinct()
    return files.join(known, F.col("stem") == F.col("_t"), "left").withColumn("is_correct", F.col("_t").isNotNull()).drop("_t")


def box_art(names: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``art_path``: the file of the first image of that name."""
    first = images.groupBy("original_name").agg(F.min_by("path", "pos").alias("art_path")).withColumnRenamed("original_name", "display_name")
    return names.join(first, "display_name", "left")


def low_confidence_queue(results: DataFrame) -> DataFrame:
    """Rows of low confidence, in their order."""
    return results.where(F.col("match_method").contains("low confidence")).orderBy("pos")


def unmatched_queue(results: DataFrame, guesses: DataFrame) -> DataFrame:
    """Rows without a target, with the best guess (``suggested``, ``score``, ``source``) where there is one."""
    left = results.where("target_title is null").select("pos", "stem")
    return left.join(guesses.select(F.col("file_id").alias("pos"), "suggested", "score", "source"), "pos", "left").orderBy("pos")


def decided(queue: DataFrame, decisions: DataFrame, titles: DataFrame) -> DataFrame:
    """``pos, stem, outcome, title, matched_via`` of a queue (pos, stem, suggested) after ``decisions`` (pos, decision, chosen_title).

    yes takes the chosen title, else the suggested one; keep takes the present name; a title is given once,
    to the first row. Outcomes: linked, kept, claimed (the title was gone), refused, left (after a stop, or
    undecided) and auto (after a switch).
    """
    rows = queue.join(decisions.select("pos", "decision", "chosen_title"), "pos", "left")
    ends = F.col("decision").isin("stop", "switch_to_auto")
    end = rows.agg(F.min(F.when(ends, F.col("pos"))).alias("_end"), F.min_by("decision", F.when(ends, F.col("pos"))).alias("_how"))
    over = F.col("_end").isNotNull() & (F.col("pos") >= F.col("_end"))
    title = F.when(F.col("decision") == "yes", F.coalesce("chosen_title", "suggested")).when(F.col("decision") == "keep", F.col("stem"))
    rows = rows.crossJoin(F.broadcast(end)).withColumn("_over", over).withColumn("title", F.when(~over, title))  # end is one row
    won = first_claims(rows.where("title is not null"), "title", "pos").select("pos", F.lit(True).alias("_won"))
    known = titles.select(F.col("title").alias("_known")).distinct()
    out = rows.join(won, "pos", "left").join(known, F.col("title") == F.col("_known"), "left")
    outcome = (
        F.when(F.col("_over"), F.when(F.col("_how") == "stop", "left").otherwise("auto")).when(F.col("decision") == "no", "refused")
        .when(F.col("title").isNull(), "left").when(F.col("_won").isNull(), "claimed").when(F.col("decision") == "keep", "kept").otherwise("linked")
    )
    via = (
        F.when(F.col("title").eqNullSafe(F.col("suggested")) | (F.col("decision") == "keep"), "Human-Confirmed")
        .when(F.col("_known").isNotNull(), "Human-Selected").otherwise("Human-Entered")
    )
    out = out.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("linked", "kept")
    return out.select("pos", "stem", "outcome", F.when(taken, F.col("title")).alias("title"), F.when(taken, via).alias("matched_via"))


def counters(results: DataFrame) -> DataFrame:
    """One row: files, matched, already correct, from the cache, of low confidence, unmatched."""
    method = F.coalesce("match_method", F.lit(""))
    some = F.col("target_title").isNotNull()
    return results.agg(
        F.count("*").alias("files"), F.count_if(some).alias("matched"), F.count_if(some & (F.col("target_title") == F.col("stem"))).alias("already_correct"),
        F.count_if(method.startswith("Fingerprint Cache")).alias("from_cache"), F.count_if(method.contains("low confidence")).alias("low_confidence"), F.count_if(~some).alias("unmatched"),
    )
