"""What a whole batch of plans must satisfy, and collisions of names on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalink.functions.text import safe_file_name

LOW = "(low confidence)"
# What a refused plan's method says.
SAME_TARGET = "Skipped -> %d files in this batch all matched '%s' - ambiguous, left for manual review"
STAYING_NAME = "Skipped -> matches the current name of a different file staying in place ('%s') - ambiguous, left for manual review"
#: A numbered copy's name: its base and its number.
NUMBERED = r"^(.*) \((\d+)\)\.pdf$"


def duplicate_targets(plans: DataFrame, target: str = "target_title") -> DataFrame:
    """Add ``is_duplicate`` and ``n_same``, how many rows want the target: if more than one, all of them are refused.

    Rows without a target are spread by their other columns, so they never meet in one task."""
    one = F.when(F.col(target).isNull(), F.xxhash64(*plans.columns))
    n = F.count(target).over(Window.partitionBy(target, one))
    return plans.withColumn("n_same", n).withColumn("is_duplicate", F.col("n_same") > 1)


def refuse_duplicates(plans: DataFrame) -> DataFrame:
    """Plans of one target all lose it, and say so."""
    marked = duplicate_targets(plans)
    label = F.format_string(SAME_TARGET, "n_same", "target_title")
    method = [F.when(F.col("is_duplicate"), label).otherwise(F.col("match_method")).alias("match_method")] if "match_method" in plans.columns else []
    rest = [c for c in plans.columns if c not in ("target_title", "match_method")]
    return marked.select(*rest, F.when(~F.col("is_duplicate"), F.col("target_title")).alias("target_title"), *method)


def refuse_stable_names(second: DataFrame, first: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Plans of pass 2 lose a target whose file name is a file's name now, if pass 1 keeps the name or has no target for the file.

    Names of files that pass 2 itself will move count too, and those of ``skipped`` files (stem). A file may keep its own name.
    """
    name, wanted = F.concat("stem", F.lit(".pdf")), safe_file_name("target_title")
    stable = first.where(F.col("target_title").isNull() | (wanted == name)).select(name.alias("_name"))
    if skipped is not None:
        stable = stable.union(skipped.select(name.alias("_name")))
    out = second.withColumn("_wanted", wanted).join(stable.distinct(), F.col("_wanted") == F.col("_name"), "left")
    refused = F.col("_name").isNotNull() & (F.col("_wanted") != name)
    method = [F.when(refused, F.format_string(STAYING_NAME, "target_title")).otherwise(F.col("match_method")).alias("match_method")] if "match_method" in second.columns else []
    rest = [c for c in second.columns if c not in ("target_title", "match_method")]
    return out.select(*rest, F.when(~refused, F.col("target_title")).alias("target_title"), *method)


def tag_ambiguous(plans: DataFrame, notes: DataFrame) -> DataFrame:
    """Methods of ambiguous titles get the low-confidence tag; cached, verified and tagged ones stay."""
    out = plans.join(notes.select(F.col("display_name").alias("target_title"), "others"), "target_title", "left")
    trusted = F.col("match_method").startswith("Fingerprint Cache") | F.col("match_method").startswith("Omni-Verification") | F.col("match_method").contains("low confidence")
    tagged = F.concat("match_method", F.lit(f" {LOW} - Ambiguous title: "), "others")
    return out.withColumn("match_method", F.when(F.col("others").isNotNull() & ~trusted, tagged).otherwise(F.col("match_method"))).drop("others")


def collision_groups(files: DataFrame) -> DataFrame:
    """``base, members, distinct_hashes, is_identical`` of groups of "X.pdf" and "X (k).pdf".

    ``files`` has file_name and sha256. A group of equal bytes is identical; an unread file makes none.
    """
    base = F.regexp_extract("file_name", NUMBERED, 1)
    suffixed = files.withColumn("base", base).where("base <> ''")
    plain = files.where(F.lower("file_name").endswith(".pdf")).select("file_name", "sha256", F.regexp_replace("file_name", r"(?i)\.pdf$", "").alias("base"))
    lower = plain.select(F.lower("base").alias("_b")).distinct()
    kept = suffixed.join(lower, F.lower("base") == F.col("_b"), "left_semi").select("base", "file_name", "sha256")
    members = kept.union(plain.join(kept.select("base").distinct(), "base", "left_semi").select("base", "file_name", "sha256"))
    return members.groupBy("base").agg(
        F.count("*").alias("members"), F.count_distinct("sha256").alias("distinct_hashes"),
        ((F.count_distinct("sha256") == 1) & (F.count("sha256") == F.count("*"))).alias("is_identical"),
    )


def collision_queue(files: DataFrame) -> DataFrame:
    """``base, file_name, place`` of groups to review: the plain name first, then by name."""
    groups = collision_groups(files).where("not is_identical").select("base")
    name = F.coalesce(F.nullif(F.regexp_extract("file_name", NUMBERED, 1), F.lit("")), F.regexp_replace("file_name", r"(?i)\.pdf$", ""))
    order = Window.partitionBy("base").orderBy(F.col("file_name") != F.concat("base", F.lit(".pdf")), "file_name")
    return files.withColumn("base", name).join(groups, "base").select("base", "file_name", (F.row_number().over(order) - 1).alias("place"))


def plain_before_suffixed(files: DataFrame) -> DataFrame:
    """Add ``place``: files in order, those with a number whose plain sibling is there after all others.

    Rows move to ranges of the order; counts of the ranges before, a row each, turn places in a range into places of all."""
    base = F.regexp_extract("file_name", NUMBERED, 1)
    named = files.withColumn("_base", F.lower(F.when(base != "", F.concat(base, F.lit(".pdf")))))
    plain = files.select(F.lower("file_name").alias("_plain")).distinct()
    late = named.join(plain, F.col("_base") == F.col("_plain"), "left").withColumn("_late", F.col("_plain").isNotNull()).drop("_base", "_plain")
    span = files.agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.count("*").alias("_n"))  # one row
    step = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.greatest(F.lit(1), F.ceil(F.col("_n") / 100_000))))
    dealt = late.crossJoin(F.broadcast(span)).withColumn("_range", F.floor((F.col("pos") - F.col("_lo")) / step)).drop("_lo", "_hi", "_n")
    order = Window.partitionBy(F.lit(0)).orderBy("_late", "_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_late", "_range").agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(order), F.lit(0))).drop("_in")
    own = Window.partitionBy("_late", "_range").orderBy("pos")
    return dealt.join(counts, ["_late", "_range"]).withColumn("place", F.col("_before") + F.row_number().over(own) - 1).drop("_late", "_range", "_before")
