"""Catalog operators: derived columns, siblings, display names, ambiguous titles, names of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalink.functions.text import clean_text, name_tokens, significant_words, strip_any_code, strip_code
from catalink.operators.select import small


GRAM = 3  #: letters of the runs by which strings that contain one another meet


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``s, l``: all pairs of a string of ``inner`` (s) that lies in one of ``outer`` (l). The empty string lies in every one.

    A string has all runs of letters of those that lie in it, so the two meet at one run of the inner one, picked by hash.
    Strings shorter than a run are few, as different ones; they are looked for in each outer one.
    """
    inner, outer = inner.select("s").where("s IS NOT NULL").distinct(), outer.select("l").where("l IS NOT NULL").distinct()
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substr(c, i, F.lit(GRAM)))
    long = F.length("s") >= GRAM
    keyed = inner.where(long).select("s", F.array_min(F.transform(grams(F.col("s")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"].alias("g"))
    runs = outer.where(F.length("l") >= GRAM).select("l", F.explode(F.array_distinct(grams(F.col("l")))).alias("g"))
    met = runs.join(keyed, "g").where(F.contains("l", F.col("s"))).select("s", "l")
    return met.union(outer.join(small(inner.where(~long)), F.contains(F.col("l"), F.col("s"))).select("s", "l"))


def derived(entries: DataFrame) -> DataFrame:
    """Add what matching needs to ``pos, title, notes, year, application_path``; rows without a title go.

    A path that ends in .lnk is no document. Year is "9999" if it is missing.
    """
    base = F.element_at(F.split(F.coalesce("application_path", F.lit("")), r"[\\/]"), -1)
    clean = clean_text("title")
    return (
        entries.where(F.coalesce(F.trim("title"), F.lit("")) != "")
        .withColumns({
            "clean_title": clean, "core_title": strip_code(clean), "notes": F.coalesce("notes", F.lit("")),
            "year": F.when(F.coalesce("year", F.lit("")) == "", "9999").otherwise(F.col("year")),
            "application_clean": clean_text(F.regexp_replace(base, r"\.[^.]*$", "")), "is_document": ~F.lower(base).endswith(".lnk"),
        })
        .withColumn("words", significant_words(clean_text("notes")))
    )


def with_siblings(entries: DataFrame) -> DataFrame:
    """Flag ``has_specific_sibling``: a placeholder of which a coded entry's title is a longer form."""
    e = entries.withColumn("_base", strip_any_code("clean_title")).withColumn("_generic", F.col("title").startswith("TSRXXXX:"))
    coded = e.where(~F.col("_generic"))
    # every shorter form that ends before a space: an equi-join instead of comparing all pairs
    parts = F.split("_base", " ")
    forms = coded.withColumn("_p", parts).where(F.size("_p") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.array_join(F.slice("_p", F.lit(1), i), " "))).alias("_form")).distinct()
    found = e.join(forms, (F.col("_base") == F.col("_form")) & F.col("_generic") & (F.col("_base") != ""), "left")
    return found.withColumn("has_specific_sibling", F.col("_form").isNotNull()).drop("_base", "_generic", "_form")


def with_display_name(entries: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``display_name``, found once an entry: the image of its application's name, the one of its core title (of
    several, the first with the same first word), the first whose name has the core title, or the title itself."""
    first = lambda what: F.min_by("original_name", F.col("img_pos")).alias(what)
    # names repeat, so they are made different before anything is sorted or compared
    img = images.groupBy("original_name", "clean_name", "core_name").agg(F.min("pos").alias("img_pos"))
    by_app = img.where("clean_name <> ''").groupBy("clean_name").agg(first("_app")).withColumnRenamed("clean_name", "application_clean")
    lead = lambda c: F.element_at(F.split(c, " "), 1)
    by_core = img.groupBy("core_name").agg(first("_core")).withColumnRenamed("core_name", "core_title")
    by_code = img.withColumn("_lead", lead("clean_name")).groupBy("core_name", "_lead").agg(first("_code")).withColumnRenamed("core_name", "core_title")
    titles = entries.select("title", "clean_title", "core_title").distinct()
    found = containing(titles.where("core_title <> ''").select(F.col("core_title").alias("s")), img.select(F.col("clean_name").alias("l")))
    named = img.groupBy("clean_name").agg(F.min(F.struct("img_pos", "original_name")).alias("_img"))
    inside = found.join(named, F.col("l") == F.col("clean_name")).groupBy(F.col("s").alias("core_title")).agg(F.min("_img")["original_name"].alias("_inside"))
    of_title = titles.withColumn("_lead", lead("clean_title")).join(by_code, ["core_title", "_lead"], "left").join(by_core, "core_title", "left").join(inside, "core_title", "left")
    of_title = of_title.select("title", "clean_title", "core_title", F.coalesce(F.when(F.col("_core").isNotNull(), F.coalesce("_code", "_core")), F.col("_inside")).alias("_image"))
    out = entries.join(small(by_app), "application_clean", "left").join(small(of_title), ["title", "clean_title", "core_title"], "left")
    name = F.coalesce("_app", "_image", F.replace("title", F.lit(":"), F.lit(" -")))
    return out.withColumn("display_name", name).select(*entries.columns, "display_name")


def ambiguous_titles(entries: DataFrame) -> DataFrame:
    """``display_name, n_names, others``: names that differ for one core title, with the others in order.

    A name of two core titles keeps the note of the later one in catalog order.
    """
    # names that repeat are made one by hash: sets would be sorted, with every row
    different = entries.where("is_document").groupBy("core_title", "display_name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    groups = different.groupBy("core_title").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("display_name")).alias("names"), F.min("first").alias("first"))
    groups = groups.where((F.col("n") >= 2) & (F.size("names") >= 2)).select("first", "names")
    last = groups.select("first", F.explode("names").alias("display_name")).groupBy("display_name").agg(F.max("first").alias("first"))
    one = last.join(groups, "first")
    return one.select("display_name", F.size("names").alias("n_names"), F.array_join(F.array_except("names", F.array("display_name")), "; ").alias("others"))


def token_matches(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``name_id, pos``: entries whose clean title has the name's first two tokens in it."""
    n = names.withColumn("_t", name_tokens("clean_name")).where(F.size("_t") >= 2).select("name_id", F.get("_t", F.lit(0)).alias("_a"), F.get("_t", F.lit(1)).alias("_b"))
    titles = entries.select(F.col("clean_title").alias("l"))
    tokens = n.select(F.col("_a").alias("s")).union(n.select("_b"))
    found = containing(tokens, titles)
    wanted = n.select("_a", "_b").distinct()
    # titles that contain the first token, and of those the ones that contain the second
    both = wanted.join(found, F.col("_a") == F.col("s")).where(F.contains("l", F.col("_b"))).select("_a", "_b", "l")
    return n.join(both, ["_a", "_b"]).join(entries.select("pos", "clean_title"), F.col("l") == F.col("clean_title")).select("name_id", "pos")


def token_choice(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``name_id, pos, rule``: of several token matches the one of the name itself, then one whose notes have
    the page count, then the latest year, last in catalog order."""
    e = entries.select("pos", "clean_title", "notes", "year")
    pairs = token_matches(names, entries).join(e, "pos").join(names.select("name_id", "clean_name", "page_count"), "name_id")
    found = pairs.groupBy("name_id").agg(
        F.count("*").alias("n"), F.min("pos").alias("only"),
        F.min(F.when(F.col("clean_title") == F.col("clean_name"), F.col("pos"))).alias("self"),
        F.min(F.when(F.contains(F.col("notes"), F.col("page_count").cast("string")), F.col("pos"))).alias("paged"),
        F.max_by("pos", F.struct("year", "pos")).alias("latest"),
    )
    rule = F.when(F.col("n") == 1, "unique").when(F.col("self").isNotNull(), "self").when(F.col("paged").isNotNull(), "pages").otherwise("latest")
    pos = F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("self", "paged", "latest"))
    return found.select("name_id", pos.alias("pos"), rule.alias("rule"))


def substring_choice(names: DataFrame, items: DataFrame, item_name: str) -> DataFrame:
    """``name_id, pos``: the first item whose name contains the name or lies in it. An empty item name lies in all."""
    n = names.where(F.length("clean_name") >= 4).select("name_id", "clean_name")
    first = items.groupBy(F.col(item_name).alias("item")).agg(F.min("pos").alias("pos"))
    around = either(n, first.select("item"))
    best = around.join(first, "item").groupBy("clean_name").agg(F.min("pos").alias("pos"))
    return n.join(best, "clean_name").select("name_id", "pos")


def either(names: DataFrame, items: DataFrame) -> DataFrame:
    """``clean_name, item``: different pairs of which one contains the other."""
    n, i = names.select("clean_name"), items.select("item")
    inside = containing(n.select(F.col("clean_name").alias("s")), i.select(F.col("item").alias("l"))).select(F.col("s").alias("clean_name"), F.col("l").alias("item"))
    outside = containing(i.select(F.col("item").alias("s")), n.select(F.col("clean_name").alias("l"))).select(F.col("l").alias("clean_name"), F.col("s").alias("item"))
    return inside.union(outside).distinct()


def software_choice(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``name_id, pos``: the one entry of the very name, else the unique longest title in or around the name."""
    n = names.where(F.length("clean_name") >= 4).select("name_id", "clean_name")
    e = entries.where("not is_document").select("pos", "clean_title", "core_title", "application_clean")
    keys = e.select("pos", F.explode(F.array_distinct(F.array("clean_title", "core_title", "application_clean"))).alias("clean_name"))
    exact = n.join(keys, "clean_name").groupBy("name_id").agg(F.count("*").alias("k"), F.min("pos").alias("pos")).where("k = 1").select("name_id", "pos")
    rest = n.join(exact, "name_id", "left_anti")
    titles = e.where("clean_title <> ''").groupBy("clean_title").agg(F.count("*").alias("k"), F.min("pos").alias("pos"))
    pairs = either(rest, titles.select(F.col("clean_title").alias("item"))).join(titles, F.col("item") == F.col("clean_title"))
    best = rest.join(pairs.select("clean_name", "k", "pos", F.length("item").alias("len")), "clean_name").groupBy("name_id", "len").agg(F.sum("k").alias("k"), F.min("pos").alias("pos"))
    longest = best.groupBy("name_id").agg(F.max("len").alias("len"), F.max_by("k", "len").alias("k"), F.max_by("pos", "len").alias("pos"))
    return exact.union(longest.where("k = 1").select("name_id", "pos"))


def first_claims(choices: DataFrame, target: str, order: str) -> DataFrame:
    """Of several rows that want one target, the first."""
    return choices.withColumn("_r", F.row_number().over(Window.partitionBy(target).orderBy(order))).where("_r = 1").drop("_r")
