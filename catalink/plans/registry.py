"""Queries over the operators, by name, with the SQL that gives the same rows.

Driver tables stand in for files and catalog: documents are files, benchmark passages
are entries, parts and pages give names. Columns that they lack follow from a formula that both sides use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalink.functions import text as T
from catalink.operators import actions, cascade, catalog, constraints, phrases, review, scoring, state
from catalink.operators.select import accept, nearest2, small, top2
from catalink.plans import sql
from catalink.plans.run import storing
from catalink.sources import page_images


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: 2000 characters a page, 30 bytes a character on even pages counts and 90 on odd ones.

    A file has the name of the entry whose number is its own modulo 40."""
    pages = F.ceil(F.col("n_chars") / 2000).cast("int")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), T.clean_text("text").alias("text"), pages.alias("page_count"))
    names = small(_catalog(spark, sf).select(F.col("item_id").alias("_n"), F.col("clean_title").alias("clean_name")))
    d = d.join(names, F.col("file_id") % 40 == F.col("_n"), "left").drop("_n")
    return d.select(
        "file_id", "text", T.significant_words("text").alias("words"), "page_count",
        F.when(F.col("page_count") % 2 == 0, 30_000.0).otherwise(130_000.0).alias("bytes_per_page"), F.coalesce("clean_name", F.lit("")).alias("clean_name"),
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as entries: the first six words are the title, and the notes name a page count."""
    clean = table(spark, sf, "benchmark").select("item_id", "text", T.clean_text("text").alias("clean_notes"))
    pages = F.format_string("%02d", F.col("item_id") % 3 + 10)
    return clean.select(
        "item_id", "clean_notes", T.significant_words("clean_notes").alias("words"),
        F.concat("text", F.lit(" "), pages, F.lit(" pages"), F.when(F.col("item_id") % 2 == 0, " in color").otherwise("")).alias("notes"),
        F.array_join(F.slice(F.split("clean_notes", " "), 1, 6), " ").alias("core_title"),
    )


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Those entries with all that the cascade needs: numbers make some of them forms, hub books, placeholders with siblings, or software."""
    n = F.col("item_id")
    suffix = F.when(n % 5 == 1, " record sheets").when(n % 11 == 3, " monster manual").otherwise("")
    e = entries(spark, sf).withColumn("title", F.concat(F.lit("TSR"), n + 2000, F.lit(": "), "core_title", suffix))
    clean = e.withColumn("clean_title", T.clean_text("title")).drop("core_title")
    return clean.withColumns({
        "pos": n, "core_title": T.strip_code("clean_title"), "display_name": F.replace("title", F.lit(":"), F.lit(" -")),
        "is_document": n % 13 != 4, "has_specific_sibling": n % 7 == 2,
    })


def clean_text(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), T.clean_text("text").alias("clean"))
    p = table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), T.clean_text("html").alias("clean"))
    return d.union(p).select("origin", "id", F.md5(F.col("clean").cast("binary")).alias("digest"), F.length("clean").cast("long").alias("n_chars"))


def strip_codes(spark, sf):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("TSR"), F.col("p_partkey"), F.lit(": "))).when(F.col("p_partkey") % 3 == 1, F.lit("TSRXXXX: ")).otherwise(F.lit("")), F.col("p_name"))
    clean = T.clean_text(name)
    return table(spark, sf, "part").select("p_partkey", clean.alias("clean_title"), T.strip_code(clean).alias("core_title"), T.strip_any_code(clean).alias("bare_title"))


def text_flags(spark, sf):
    """Flags and names of titles made from parts."""
    n = F.col("p_partkey")
    kind = F.when(n % 4 == 0, " Record Sheets").when(n % 4 == 1, ": Monster-Manual").when(n % 4 == 2, ' "Map"? ').otherwise("/Hex Pad")
    title = F.concat("p_name", kind)
    clean = T.clean_text(title)
    method = F.when(n % 3 == 0, "Catalog Name (low confidence)").when(n % 3 == 1, "Filename Tokens (12 pages, low confidence)").otherwise("Content Match")
    parts = T.split_name(F.concat(F.when(n % 5 == 0, ".").otherwise(""), "p_name", F.when(n % 2 == 0, ".tar.gz").otherwise("")))
    return table(spark, sf, "part").select(
        "p_partkey", T.is_blank_form(clean).alias("is_blank"), T.is_hub_book(clean).alias("is_hub"), T.safe_file_name(title).alias("file_name"),
        T.without_low_confidence(method).alias("method"), parts["stem"].alias("stem"), parts["ext"].alias("ext"),
    )


def token_idf(spark, sf):
    return scoring.idf(entries(spark, sf)).select("word", F.round("idf", 6).alias("idf"))


def overlap_scores(spark, sf):
    e = entries(spark, sf)
    return scoring.overlap(files(spark, sf), e, scoring.idf(e)).select("file_id", "item_id", F.round("overlap", 6).alias("overlap"))


def content_match(spark, sf):
    """The cascade's content layer: bonuses, exclusions, and files that have an excluded entry's name."""
    e = _catalog(spark, sf)
    return _scored(cascade.best_content(files(spark, sf), e, scoring.idf(e)))


def _scored(best):
    return best.select("file_id", "item_id", F.round("score", 6).alias("score"), F.round("runner_up", 6).alias("runner_up"))


def bonus_candidates(spark, sf):
    e = entries(spark, sf)
    return scoring.scores(files(spark, sf), e, scoring.idf(e)).select("file_id", "item_id", F.round("score", 6).alias("score"))


def verbatim_title(spark, sf):
    return scoring.verbatim_titles(files(spark, sf), entries(spark, sf))


def unclaimed_match(spark, sf):
    """Entries that content matches have claimed are gone; files that they linked are, too."""
    store = storing(spark)
    f, e = store(files(spark, sf).drop("words")), store(_catalog(spark, sf))
    weights = store(scoring.idf(e))
    claimed = store(cascade.best_content(f, e, weights).select("file_id", "item_id"))
    free = e.join(claimed.join(e, "item_id").select("display_name").distinct(), "display_name", "left_anti")
    return _scored(cascade.best_unclaimed(f.join(claimed, "file_id", "left_anti"), free, weights)).drop("runner_up")


def blank_pool_match(spark, sf):
    """The cascade's layer of forms."""
    e = _catalog(spark, sf)
    return _scored(cascade.best_blank(files(spark, sf), e, scoring.idf(e)))


def cascade_labels(spark, sf):
    """Content matches as plans: the target's display name, and the method without its figures."""
    e = _catalog(spark, sf)
    plans = cascade.content(files(spark, sf), e, scoring.idf(e))
    return plans.select("file_id", "target_title", F.regexp_replace("match_method", r"[0-9.]+", "#").alias("method"))


def hamming_match(spark, sf):
    """Signs of an embedding are a hash of 64 bits; vectors of a number divisible by 100 look for the nearest of all others.

    A declared fixture: at most 20 bits, 3 less than the next one. The queries are a stated set against all rows."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
    v = table(spark, sf, "embeddings").select("vec_id", F.array(bits).alias("h"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("file_id"), F.col("h").alias("a"))
    best = nearest2(asked, v.select(F.col("vec_id").alias("item_id"), F.col("h").alias("b")), 999)
    near = (F.col("distance") <= 20) & (F.col("runner_up") - F.col("distance") >= 3)
    return best.select("file_id", "item_id", F.col("distance").cast("long"), F.col("runner_up").cast("long"), near.alias("accepted"))


def phrase_match(spark, sf):
    pairs = phrases.phrase_scores(files(spark, sf), entries(spark, sf))
    best = accept(top2(pairs, "file_id", "item_id", "score"), "score", 0.65, 0.20)
    return best.select("file_id", "item_id", F.round("score", 6).alias("score"), F.round("runner_up", 6).alias("runner_up"))


def shingle_candidates(spark, sf):
    return phrases.shingle_candidates(files(spark, sf), entries(spark, sf))


def _sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def fingerprint_join(spark, sf):
    """The cascade's cache layer; labelled documents fill the cache, every seventh without a title."""
    d = _sha(spark, sf)
    known = d.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id").groupBy("sha256").agg(F.min("doc_id").alias("m"))
    cache = known.select("sha256", F.when(F.col("m") % 7 != 0, F.concat(F.lit("title "), "m")).alias("title"), F.lit("m").alias("matched_via"))
    return cascade.cached(d.withColumn("file_id", F.col("doc_id")), cache)


def duplicate_groups(spark, sf):
    """Documents of a source are numbered copies of one name in groups of four."""
    d = _sha(spark, sf)
    base = F.concat("source", F.lit(" "), F.floor(F.col("doc_id") / 80))
    k = (F.floor(F.col("doc_id") / 20) % 4 + 1).cast("int")
    named = d.select(F.concat(base, F.when(k > 1, F.concat(F.lit(" ("), k, F.lit(")"))).otherwise(F.lit("")), F.lit(".pdf")).alias("file_name"), "sha256")
    return constraints.collision_groups(named)


def duplicate_targets(spark, sf):
    """Plans are the unclaimed matches; targets wanted twice are refused."""
    plans = unclaimed_match(spark, sf).select("file_id", F.col("item_id").alias("target_title"))
    return constraints.duplicate_targets(plans).select("file_id", "target_title", "is_duplicate")


def refused_plans(spark, sf):
    """Plans of parts for pass 2: targets wanted twice, and names of files that stay, are refused with a label."""
    n = F.col("file_id")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("f"), "p_partkey").alias("stem"))
    first = p.select("file_id", "stem", F.when(n % 3 == 0, F.concat(F.lit("t"), n)).alias("target_title"))
    target = F.when(n % 7 == 0, F.concat(F.lit("both "), F.floor(n / 14))).when(n % 5 == 0, F.concat(F.lit("f"), n + 1, F.lit("?"))).when(n % 11 == 0, F.col("stem")).otherwise(F.concat(F.lit("own "), n))
    second = p.where("file_id % 3 <> 0").select("file_id", "stem", target.alias("target_title"), F.lit("m").alias("match_method"))
    plans = constraints.refuse_stable_names(constraints.refuse_duplicates(second), first)
    return plans.select("file_id", "target_title", "match_method")


def _spread(df, key):
    """Rows dealt out by a key: a small file may hold many rows, all in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _parts(spark, sf):
    p = _spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    code = F.when(F.col("p_partkey") % 7 == 0, F.lit("TSRXXXX: ")).otherwise(F.concat(F.lit("TSR"), F.col("p_partkey") % 5 + 2000, F.lit(": ")))
    size = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    return catalog.derived(p.select(
        F.col("p_partkey").alias("pos"), F.concat(code, F.col("p_name"), size).alias("title"), F.concat("p_type", F.lit(" "), F.col("p_size"), F.lit(" pages")).alias("notes"),
        (F.col("p_size") + 1970).cast("string").alias("year"),
        F.concat(F.lit("C:\\x\\"), F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit(" art.lnk"))).otherwise(F.concat(F.lit("f"), F.col("p_partkey"), F.lit(".pdf")))).alias("application_path"),
    ))


def _images(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("TSR"), F.col("p_size") % 5 + 2000, F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("original_name"))
    s = s.groupBy("original_name").agg(F.min("pos").alias("pos"))  # the first of each name is what the queries take
    clean = T.clean_text("original_name")
    return s.select("pos", "original_name", clean.alias("clean_name"), T.strip_code(clean).alias("core_name"))


def sibling_flags(spark, sf):
    return catalog.with_siblings(_parts(spark, sf)).select("pos", "has_specific_sibling")


def display_name(spark, sf):
    return catalog.with_display_name(_parts(spark, sf), _images(spark, sf)).select("pos", "display_name")


def ambiguous_titles(spark, sf):
    named = _parts(spark, sf).withColumn("display_name", F.concat("title", F.lit(" #"), F.col("year")))
    return catalog.ambiguous_titles(named).select("display_name", F.col("n_names").cast("long").alias("n_names"), F.md5(F.col("others").cast("binary")).alias("others_digest"))


def _names(spark, sf):
    p = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("name_id"), F.max("p_size").alias("page_count"))
    return p.select("name_id", T.clean_text("p_name").alias("clean_name"), "page_count")


def legacy_token(spark, sf):
    return catalog.token_choice(_names(spark, sf), _parts(spark, sf))


def substring_names(spark, sf):
    return catalog.substring_choice(_names(spark, sf), _images(spark, sf).withColumnRenamed("clean_name", "image_name"), "image_name")


def nonpdf_longest(spark, sf):
    return catalog.software_choice(_names(spark, sf), _parts(spark, sf))


def nonpdf_claims(spark, sf):
    """Names as files, every sixth named rightly, with ten titles for the entries; one of the titles' names exists."""
    title = F.concat(F.lit("Item: "), F.col("pos") % 10)
    rows = _names(spark, sf).select("name_id").join(nonpdf_longest(spark, sf), "name_id", "left").select(F.col("name_id").alias("pos"), title.alias("title"), F.lit(".iso").alias("ext"))
    right = (F.col("pos") % 6 == 0) & F.col("title").isNotNull()
    rows = rows.withColumn("old", F.when(right, F.concat(F.replace("title", F.lit(":")), "ext")).otherwise(F.concat(F.lit("f"), "pos", "ext")))
    rows = storing(spark)(rows)  # read several times
    return actions.claimed(rows, rows.select(F.col("old").alias("file_name")).union(spark.createDataFrame([("ITEM 3.iso",)], "file_name string")))


def claimed_setops(spark, sf):
    """Targets of content matches and item numbers of even documents are claimed; the rest is not."""
    claimed = content_match(spark, sf).select("item_id").union(table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"))).distinct()
    e = table(spark, sf, "benchmark").select("item_id")
    return e.join(claimed, "item_id", "left_semi").withColumn("claimed", F.lit(True)).union(e.join(claimed, "item_id", "left_anti").withColumn("claimed", F.lit(False)))


def incremental_partition(spark, sf):
    """The index comes from documents as they were: every fifth has another size now, every seventh no title."""
    d = _sha(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    name = F.concat(F.lit("f"), F.col("doc_id"))
    f = d.select(name.alias("file_name"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    index = d.where("doc_id % 3 <> 0").select(name.alias("file_name"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"), F.col("doc_id").alias("mtime"), "sha256")
    cache = d.groupBy("sha256").agg(F.min("doc_id").alias("m")).select("sha256", F.when(F.col("m") % 7 != 0, F.concat(F.lit("title "), F.col("m"))).alias("title"))
    return state.incremental_partition(f, index, cache).select("file_name", "title", "skip")


def cache_merge(spark, sf):
    e = table(spark, sf, "events")
    cols = [F.concat(F.lit("u"), F.col("user_id")).alias("sha256"), F.concat("event_type", F.lit(" "), F.col("event_id")).alias("title"), F.col("event_type").alias("matched_via"), F.col("event_id").alias("pos")]
    old = state.latest(e.where("event_id % 4 = 0"), "user_id", "event_id").select(*cols[:3])
    human = F.col("event_id") % 97 == 2
    return state.merge_cache(old, e.where((F.col("event_id") % 4 != 0) & ~human).select(*cols), e.where(human).select(*cols))


def index_merge(spark, sf):
    e = table(spark, sf, "events")
    name = F.concat(F.lit("u"), F.col("user_id"))
    index = state.latest(e.where("event_id % 2 = 0"), "user_id", "event_id").select(name.alias("file_name"), F.col("event_id").alias("size"), F.col("event_id").alias("mtime"), F.col("event_type").alias("sha256"))
    last = state.latest(e.where("event_id % 2 = 1"), "user_id", "event_id")
    results = last.select(name.alias("file_name"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("n"), F.col("user_id"))).alias("new_name"), (F.col("event_id") % 5 == 0).alias("low_confidence"), F.col("event_id").alias("size"), F.col("event_id").alias("mtime"), F.col("event_type").alias("sha256"))
    return state.merge_index(index, results)


def newest_k(spark, sf):
    return state.newest(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 20)


def title_search(spark, sf):
    """Titles that contain "red" in any case, and whether a part of even number has claimed them."""
    p = table(spark, sf, "part")
    titles, claimed = p.select("p_name").distinct(), p.where("p_partkey % 50 = 0").select("p_name").distinct().withColumn("c", F.lit(True))
    hits = titles.where(F.contains(F.lower("p_name"), F.lower(F.lit("RED")))).join(claimed, "p_name", "left")
    return hits.select(F.concat("p_name", F.when(F.col("c"), " (already assigned)").otherwise("")).alias("label"))


def _plans(spark, sf):
    """Parts as files that want their part's name: every ninth stays, and of each name the first has it already if its number is even."""
    n, first = F.col("p_partkey"), F.min("p_partkey").over(Window.partitionBy("p_name"))
    p = table(spark, sf, "part").withColumn("first", first)
    old = F.when((n == F.col("first")) & (n % 2 == 0), F.concat("p_name", F.lit(".pdf"))).otherwise(F.concat(F.lit("f"), n, F.lit(".pdf")))
    return p.select(n.alias("pos"), old.alias("old"), F.when((n % 9 != 0) | (n == F.col("first")), F.col("p_name")).alias("title"))


def suffix_numbering(spark, sf):
    return actions.numbered(_plans(spark, sf))


def undo_plan(spark, sf):
    """Every third of the new names is gone by now."""
    done = suffix_numbering(spark, sf)
    return actions.undone(done, done.where("pos % 3 <> 0").select(F.col("new").alias("file_name")))


def review_decisions(spark, sf):
    """Parts are a queue; numbers decide, and a stop comes at 3001."""
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    queue = p.select(n.alias("pos"), F.concat(F.lit("f"), n).alias("stem"), F.col("p_name").alias("suggested"))
    how = F.when(n == 3001, "stop").when(n % 5 == 0, "no").when(n % 7 == 0, "keep").when(n % 11 == 0, F.lit(None)).otherwise("yes")
    chosen = F.when(n % 13 == 0, F.concat(F.lit("own "), n % 3)).when(n % 17 == 0, F.lit("known"))
    titles = p.select(F.col("p_name").alias("title")).union(spark.createDataFrame([("known",)], "title string"))
    return review.decided(queue, p.select(n.alias("pos"), how.alias("decision"), chosen.alias("chosen_title")), titles)


def run_counters(spark, sf):
    """Results of parts: numbers tell their method and target."""
    n = F.col("p_partkey")
    method = F.when(n % 3 == 0, "Fingerprint Cache: x").when(n % 4 == 0, "Catalog Name (low confidence)").otherwise("Content Match")
    rows = table(spark, sf, "part").select(F.col("p_name").alias("stem"), F.when(n % 2 == 0, F.col("p_name")).when(n % 5 != 0, F.lit("other")).alias("target_title"), method.alias("match_method"))
    return review.counters(rows)


def already_correct(spark, sf):
    """Names of parts against those of parts of even number."""
    p = table(spark, sf, "part")
    return review.already_correct(p.select("p_partkey", F.col("p_name").alias("stem")), p.where("p_partkey % 40 = 0").select(F.col("p_name").alias("title"))).select("p_partkey", "is_correct")


def file_order(spark, sf):
    """Parts in order of number, the second copies of four after all others."""
    n = F.col("p_partkey")
    name = F.concat(F.lit("f"), F.floor(n / 4), F.when(n % 4 == 1, " (2)").otherwise(F.when(n % 4 == 0, "").otherwise(F.concat(F.lit(" "), n))), F.lit(".pdf"))
    return constraints.plain_before_suffixed(table(spark, sf, "part").select(n.alias("pos"), name.alias("file_name"))).select("pos", F.col("place").cast("long").alias("place"))


def _page_images(spark, sf):
    """Items of orders as images on pages of the orders; sides follow from numbers, and some can't be decoded."""
    side = lambda c: F.when(F.col("l_linenumber") != 7, c % 3000)
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 4).alias("page"), F.col("l_linenumber").alias("place"),
        side(F.col("l_partkey") * 7 % 5 * 800 + F.col("l_suppkey")).alias("width"), side(F.col("l_partkey") % 3 * 1100).alias("height"))
    return rows, table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 9 + 1).alias("page_count"))


def page_image_choice(spark, sf):
    """The largest image of each page."""
    return page_images.largest(_page_images(spark, sf)[0])


def readable_images(spark, sf):
    """Images that are read on the first two and the last two pages, and their size then."""
    images, files_ = _page_images(spark, sf)
    return page_images.scaled(page_images.readable(images, files_, front=2))


def cascade_link(spark, sf):
    """The whole cascade on documents named after parts, with passages as entries."""
    from catalink.plans.run import link_tables

    return link_tables(spark, sf)


QUERIES = (
    clean_text, strip_codes, token_idf, overlap_scores, content_match, bonus_candidates, verbatim_title, unclaimed_match, blank_pool_match, hamming_match,
    phrase_match, shingle_candidates, fingerprint_join, duplicate_groups, duplicate_targets, refused_plans, cascade_labels, text_flags, sibling_flags, display_name, ambiguous_titles, legacy_token,
    substring_names, nonpdf_longest, nonpdf_claims, claimed_setops, incremental_partition, cache_merge, index_merge, newest_k, title_search, suffix_numbering, undo_plan, review_decisions, run_counters, already_correct, file_order, page_image_choice, readable_images, cascade_link,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()
