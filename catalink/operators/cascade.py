"""The cascade: cheapest evidence first, each layer on the files that no earlier one resolved.

Pass 1 needs nothing from other files. Its result is stored, as pass 2 may use only
entries that no file of the whole batch has claimed. A wrong link is worse than
none: scored layers need a score and a lead, and name-only links are tagged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.functions.text import clean_text, hamming, has_significant_words, is_blank_form, is_hub_book, name_tokens
from catalink.operators import catalog, constraints, phrases, scoring
from catalink.operators.select import accept, small, top2

Store = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    content: tuple[float, float] = (0.90, 0.20)
    blank: tuple[float, float] = (0.50, 0.40)
    unclaimed: float = 0.30
    phrase: tuple[float, float] = (0.65, 0.20)
    phrase_text: int = 100
    cover: tuple[int, int] = (10, 8)
    no_runner_up: int = 999
    first_printing_pages: int = 140


def _files(files: DataFrame) -> DataFrame:
    """``file_id`` (position), clean name and density of the features of files."""
    return files.withColumns({
        "file_id": F.col("pos"), "clean_name": clean_text("stem"),
        "bytes_per_page": F.when(F.col("page_count") > 0, F.col("size") / F.col("page_count")).otherwise(F.lit(0.0)),
    })


def _linked(rows: DataFrame, entries: DataFrame, method) -> DataFrame:
    """``file_id, target_title, match_method``."""
    names = entries.select(F.col("pos").alias("item_id"), "display_name")
    return rows.join(names, "item_id").select("file_id", F.col("display_name").alias("target_title"), method.alias("match_method"))


def _label(name: str):
    return F.format_string(name + " (score %.2f, next %.2f)", "score", "runner_up")


def _out(hubs: bool = True):
    """Forms, placeholders with siblings, and hub books."""
    flag = is_blank_form("clean_title") | F.col("has_specific_sibling")
    return flag | is_hub_book("clean_title") if hubs else flag


def excluded(pairs: DataFrame, files: DataFrame, entries: DataFrame, hubs: bool = True) -> DataFrame:
    """Pairs without forms, placeholders with siblings and hub books, but for files already named so."""
    marked = pairs.join(small(entries.select(F.col("pos").alias("item_id"), "clean_title", _out(hubs).alias("_out"))), "item_id").join(files.select("file_id", "clean_name"), "file_id")
    return marked.where(~F.col("_out") | (F.col("clean_title") == F.col("clean_name"))).select(*pairs.columns)


def best_content(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``file_id, item_id, score, runner_up`` of files that one entry's notes fit far better than all others."""
    e = _entries(entries.where("is_document"))
    return accept(top2(scoring.scores(files, e, weights, hidden=_out()), "file_id", "item_id", "score"), "score", *limits.content)


def best_blank(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same among forms only."""
    e = _entries(entries.where("is_document").where(is_blank_form("clean_title")))
    return accept(top2(scoring.scores(files, e, weights), "file_id", "item_id", "score"), "score", *limits.blank)


def best_unclaimed(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The best of the unclaimed entries that beats all the others; files need words."""
    e = _entries(entries.where("is_document").where(~_out()))
    return accept(top2(scoring.scores(files.where(has_significant_words("text")), e, weights), "file_id", "item_id", "score"), "score", limits.unclaimed, 0, strict=True)


def content(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _linked(best_content(files, entries, weights, limits), entries, _label("Content Match"))


def blank_forms(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _linked(best_blank(files, entries, weights, limits), entries, _label("Blank Form Match"))


def elimination(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _linked(best_unclaimed(files, entries, weights, limits), entries, _label("Process of Elimination"))


def best_covers(files: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``file_id, item_id, distance, runner_up``: the nearest cover by Hamming distance. Catalog images are few; every file meets each of them."""
    i = small(images.where("phash is not null").select(F.col("pos").alias("item_id"), "phash"))
    pairs = files.where("cover_hash is not null").join(i).select("file_id", "item_id", hamming("cover_hash", "phash").alias("distance"))
    return top2(pairs, "file_id", "item_id", "distance", limits.no_runner_up, smallest=True)


def covers(files: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    best = best_covers(files, images, limits)
    near = best.where((F.col("distance") <= limits.cover[0]) & (F.col("runner_up") - F.col("distance") >= limits.cover[1]))
    names = images.select(F.col("pos").alias("item_id"), "original_name")
    return near.join(names, "item_id").select("file_id", F.col("original_name").alias("target_title"), F.format_string("Cover Match (distance %d)", "distance").alias("match_method"))


def best_back_covers(files: DataFrame, entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    f = files.select("file_id", "clean_name", F.coalesce("ocr_back", F.lit("")).alias("text"))
    e = entries.where("is_document").select(F.col("pos").alias("item_id"), clean_text("notes").alias("clean_notes"))
    pairs = excluded(phrases.phrase_scores(f, e, limits.phrase_text), files, entries, hubs=False)
    return accept(top2(pairs, "file_id", "item_id", "score"), "score", *limits.phrase)


def back_covers(files: DataFrame, entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _linked(best_back_covers(files, entries, limits), entries, _label("Back Cover Match"))


def front_pages(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    text = clean_text(F.concat_ws(" ", "text", "ocr_front"))
    again = files.where(F.coalesce("ocr_front", F.lit("")) != "").withColumn("text", text)
    return content(again, entries, weights, limits).withColumn("match_method", F.regexp_replace("match_method", "^Content Match", "Front Page Match"))


def names(files: DataFrame, entries: DataFrame, images: DataFrame) -> list[Callable[[DataFrame], DataFrame]]:
    """The three layers of name-only evidence, all of low confidence."""
    low = F.lit(f" {constraints.LOW}")

    def tokens(left: DataFrame) -> DataFrame:
        n = left.select(F.col("file_id").alias("name_id"), "clean_name", "page_count")
        found = catalog.token_choice(n, entries).select(F.col("name_id").alias("file_id"), F.col("pos").alias("item_id"), "rule")
        return _linked(found, entries, F.concat(F.lit("Filename Tokens: "), F.col("rule"), low))

    def image(left: DataFrame) -> DataFrame:
        n = left.select(F.col("file_id").alias("name_id"), "clean_name")
        found = catalog.substring_choice(n, images.withColumnRenamed("clean_name", "image_name"), "image_name")
        return found.join(images.select("pos", "original_name"), "pos").select(F.col("name_id").alias("file_id"), F.col("original_name").alias("target_title"), F.concat(F.lit("Image Name"), low).alias("match_method"))

    def title(left: DataFrame) -> DataFrame:
        n = left.select(F.col("file_id").alias("name_id"), "clean_name")
        found = catalog.substring_choice(n, entries, "clean_title")
        return found.join(entries.select("pos", "title"), "pos").select(
            F.col("name_id").alias("file_id"), F.replace("title", F.lit(":"), F.lit(" -")).alias("target_title"), F.concat(F.lit("Catalog Name"), low).alias("match_method"))

    return [tokens, image, title]


def printings(files: DataFrame, entries: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Files named after a book of two printings: pages or text tell which, and the image of that one names it."""
    tokens = name_tokens("clean_name")
    named = files.where(F.array_contains(tokens, "deities") & F.array_contains(tokens, "demigods"))
    mentions = F.size(F.split("text", "cthulhu")) - 1
    first = (F.col("page_count") >= limits.first_printing_pages) | (mentions >= 4) | F.contains("text", F.lit("melnibon")) | F.array_contains(tokens, "cthulhu")
    named = named.select("file_id", F.coalesce(first, F.lit(False)).alias("is_first"))
    pool = entries.where(F.contains("clean_title", F.lit("deities")) & F.contains("clean_title", F.lit("demigods"))).withColumn("late", F.lower("title").contains("4th"))
    choice = pool.agg(
        F.min_by(F.struct("core_title", "display_name"), F.when(~F.col("late"), F.struct("year", "pos"))).alias("original"),
        F.min_by(F.struct("core_title", "display_name"), F.when(F.col("late"), F.struct("year", "pos"))).alias("revised"),
        F.min_by(F.struct("core_title", "display_name"), F.struct("year", "pos")).alias("oldest"),
        F.max_by(F.struct("core_title", "display_name"), F.struct("year", "pos")).alias("newest"),
        F.max("late").alias("any_late"), F.min("late").alias("all_late"),
    ).where("any_late is not null")
    one = F.when(F.col("is_first"), F.when(~F.col("all_late"), F.col("original")).otherwise(F.col("oldest"))).otherwise(F.when(F.col("any_late"), F.col("revised")).otherwise(F.col("newest")))
    chosen = named.crossJoin(F.broadcast(choice)).select("file_id", "is_first", one.alias("e")).select("file_id", "is_first", "e.*")  # choice is one row
    near = chosen.join(small(images.select("pos", "original_name", "core_name")), F.col("core_name").startswith(F.col("core_title")), "left")
    best = near.groupBy("file_id", "is_first", "display_name").agg(
        F.min_by("original_name", F.when(F.col("core_name") == F.col("core_title"), F.col("pos"))).alias("exact"),
        F.min_by("original_name", F.when(F.col("core_name") != F.col("core_title"), F.col("pos"))).alias("variant"),
    )
    target = F.when(F.col("is_first"), F.coalesce("exact", "variant", "display_name")).otherwise(F.coalesce("variant", "exact", "display_name"))
    label = F.when(F.col("is_first"), "Omni-Verification: first printing").otherwise("Omni-Verification: revised printing")
    return best.select("file_id", target.alias("target_title"), label.alias("match_method"))


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.where(F.coalesce("title", F.lit("")) != "").select("sha256", F.col("title").alias("target_title"), "matched_via")
    return files.join(known, "sha256").select("file_id", "target_title", F.concat(F.lit("Fingerprint Cache: "), F.coalesce("matched_via", F.lit(""))).alias("match_method"))


def through(files: DataFrame, layers: list[Callable[[DataFrame], DataFrame]], store: Store) -> DataFrame:
    """``file_id, target_title, match_method`` of the first layer that links each file."""
    found: list[DataFrame] = []
    left = files
    for layer in layers:
        hits = store(layer(left))
        found.append(hits)
        left = left.join(hits.select("file_id"), "file_id", "left_anti")
    return reduce(DataFrame.unionByName, found)


def _entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("item_id", F.col("pos"))


def link(files: DataFrame, entries: DataFrame, images: DataFrame, cache: DataFrame, store: Store, limits: Limits = Limits(), skipped: DataFrame | None = None) -> DataFrame:
    """Plans of a batch: ``pos, stem, target_title, match_method`` (null: unmatched; refused plans say why). Names of
    ``skipped`` files (stem), which an incremental run leaves alone, are claimed, and stay where they are.

    ``files``: pos, stem, sha256, size, page_count, text (clean), ocr_front, ocr_back, cover_hash. ``entries``: as made by
    ``catalog.derived``, with siblings and display names. ``images``: pos, original_name, clean_name, core_name, phash.
    """
    f = store(_files(files))
    weights = store(scoring.idf(entries))
    first = store(through(f, [
        lambda x: cached(x, cache), lambda x: printings(x, entries, images, limits),
        lambda x: content(x, entries, weights, limits), lambda x: blank_forms(x, entries, weights, limits),
    ], store))
    plan1 = f.select("file_id", "stem").join(first, "file_id", "left")
    left = f.join(first.select("file_id"), "file_id", "left_anti")
    claimed = first.select(F.col("target_title").alias("display_name"))
    claimed = claimed if skipped is None else claimed.union(skipped.select("stem"))
    free = store(entries.join(claimed.distinct(), "display_name", "left_anti"))
    second = store(through(left, [
        lambda x: elimination(x, free, weights, limits), lambda x: covers(x, images, limits), lambda x: back_covers(x, entries, limits),
        lambda x: front_pages(x, entries, weights, limits), *names(left, entries, images),
    ], store))
    plan2 = constraints.refuse_duplicates(left.select("file_id", "stem").join(second, "file_id", "left"))
    plan2 = constraints.refuse_stable_names(plan2, plan1, skipped).select("file_id", "target_title", "match_method")
    overlay = plan1.join(plan2.select("file_id", F.col("target_title").alias("t2"), F.col("match_method").alias("m2")), "file_id", "left")
    plans = overlay.select(F.col("file_id").alias("pos"), "stem", F.coalesce("target_title", "t2").alias("target_title"), F.coalesce("match_method", "m2").alias("match_method"))
    return constraints.tag_ambiguous(plans, catalog.ambiguous_titles(entries)).select("pos", "stem", "target_title", "match_method")


def best_guesses(files: DataFrame, entries: DataFrame, weights: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``file_id, item_id, score, source``: for review only, content at 0.30 or else phrases at 0.15."""
    e = _entries(entries.where("is_document"))
    pairs = scoring.scores(files, e, weights)
    by_content = top2(pairs, "file_id", "item_id", "score").where("score >= 0.30").select("file_id", "item_id", "score", F.lit("content").alias("source"))
    rest = files.join(by_content, "file_id", "left_anti").select("file_id", F.coalesce("ocr_back", F.lit("")).alias("text"))
    p = phrases.phrase_scores(rest, e.select("item_id", clean_text("notes").alias("clean_notes")), limits.phrase_text)
    by_phrase = top2(p, "file_id", "item_id", "score").where("score >= 0.15").select("file_id", "item_id", "score", F.lit("phrase").alias("source"))
    return by_content.unionByName(by_phrase)
