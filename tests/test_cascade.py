import random

import pytest
from pyspark.sql import functions as F

from catalink.functions.text import clean_text
from catalink.operators import cascade, review
from catalink.plans.run import run

FILES = "pos long, stem string, sha256 string, size long, page_count int, text string, ocr_front string, ocr_back string, cover_hash array<bigint>"
IMAGES = "pos long, original_name string, clean_name string, core_name string, phash array<bigint>"
CACHE = "sha256 string, title string, matched_via string"


def words(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, f"TSR{i}: Title Number{'abcdefgh'[i]}", words(i), "1990", "") for i in range(6)] + [(6, "TSR7: Deities and Demigods", words(6), "1980", ""), (7, "TSR8: Deities and Demigods 4th", words(6), "1981", "")]
    return spark.createDataFrame(rows, "pos long, title string, notes string, year string, application_path string")


def link(spark, entries, files, images=(), cache=()):
    rows = [(f.get("pos", i), f["stem"], f.get("sha", f"s{i}"), 1000, f.get("pages", 10), f.get("text", ""), f.get("front"), f.get("back"), f.get("hash")) for i, f in enumerate(files)]
    out = run(spark.createDataFrame(rows, FILES), entries, spark.createDataFrame(list(images), IMAGES), spark.createDataFrame(list(cache), CACHE))
    return {r["stem"]: (r["target_title"], r["match_method"]) for r in out.collect()}


def test_layers_in_order(spark, entries):
    half = " ".join(words(3).split()[:18])
    got = link(
        spark, entries,
        [
            dict(stem="known", sha="h", text=words(0)), dict(stem="by content", text=words(1)), dict(stem="by elimination", text=half),
            dict(stem="by cover", hash=[0, 0, 0, 1]), dict(stem="by back", back=words(2)), dict(stem="by front", front=words(4)),
            dict(stem="title numberf", text=""), dict(stem="nothing at all"),
        ],
        images=[(0, "Cover One", "cover one", "cover one", [0, 0, 0, 0]), (1, "Cover Two", "cover two", "cover two", [-1, -1, -1, -1])],
        cache=[("h", "Cached Title", "Human-Confirmed")],
    )
    assert got["known"] == ("Cached Title", "Fingerprint Cache: Human-Confirmed")
    assert got["by content"][0] == "TSR1 - Title Numberb" and got["by content"][1].startswith("Content Match")
    assert got["by elimination"][0] == "TSR3 - Title Numberd" and got["by elimination"][1].startswith("Process of Elimination")
    assert got["by cover"] == ("Cover One", "Cover Match (distance 1)")
    assert got["by back"][0] == "TSR2 - Title Numberc" and got["by back"][1].startswith("Back Cover")
    assert got["by front"][0] == "TSR4 - Title Numbere" and got["by front"][1].startswith("Front Page")
    assert got["title numberf"] == ("TSR5 - Title Numberf", "Filename Tokens: unique (low confidence)")
    assert got["nothing at all"] == (None, None)


def test_two_files_of_one_target_are_both_refused_in_pass_2(spark, entries):
    half = " ".join(words(3).split()[:18])
    got = link(spark, entries, [dict(stem="one x", text=half), dict(stem="two y", text=half)])
    assert {k: v[0] for k, v in got.items()} == {"one x": None, "two y": None}
    assert all(v[1].startswith("Skipped -> 2 files in this batch all matched 'TSR3 - Title Numberd'") for v in got.values())


def test_printings(spark, entries):
    images = [(0, "Deities", "deities", "deities and demigods", None), (1, "Deities (4th)", "deities 4th", "deities and demigods 4th", None)]
    got = link(spark, entries, [dict(stem="deities demigods a", pages=146), dict(stem="deities demigods b", pages=128)], images)
    assert got["deities demigods a"] == ("Deities", "Omni-Verification: first printing")
    assert got["deities demigods b"][0] == "Deities (4th)"


def test_order_of_input_does_not_matter(spark, entries):
    files = [dict(pos=i, stem=f"file {i}", text=words(i % 6), sha=str(i)) for i in range(8)]
    assert link(spark, entries, files) == link(spark, entries.repartition(3, "title"), files[::-1])


def test_a_run_and_the_next_one(spark, entries):
    """Files, then the same again with one new: the known ones are skipped, and their names stay claimed."""
    from catalink.plans.run import batch

    def features(*rows):
        full = [(i, f"{stem}.pdf", stem, f"s{stem}", 1000, 7, 10, text, None, None, None) for i, (stem, text) in enumerate(rows)]
        return spark.createDataFrame(full, "pos long, file_name string, stem string, sha256 string, size long, mtime long, page_count int, text string, ocr_front string, ocr_back string, cover_hash array<bigint>")

    none = spark.createDataFrame([], IMAGES)
    index = spark.createDataFrame([], "file_name string, size long, mtime long, sha256 string")
    first = batch(features(("a", words(1)), ("b", words(1)), ("c", "")), entries, none, spark.createDataFrame([], CACHE), index)
    title = "TSR1 - Title Numberb"
    assert [(r["old"], r["new"]) for r in first.renames.orderBy("pos").collect()] == [("a.pdf", f"{title}.pdf"), ("b.pdf", f"{title} (2).pdf")]
    assert {r["sha256"]: r["title"] for r in first.cache.collect()} == {"sa": title, "sb": title}
    assert sorted(r["file_name"] for r in first.index.collect()) == [f"{title} (2).pdf", f"{title}.pdf"] and first.unmatched.first()["stem"] == "c"
    assert first.counters.first()["matched"] == 2 and first.low_confidence.count() == 0
    known = features((title, ""), ("d", words(1))).withColumn("sha256", F.when(F.col("pos") == 0, "sa").otherwise(F.col("sha256")))
    second = batch(known, entries, none, first.cache, first.index)
    got = {r["stem"]: (r["target_title"], r["match_method"], r["new"]) for r in second.plans.collect()}
    assert got[title] == (title, "Fingerprint Cache: unchanged", f"{title}.pdf") and got["d"][0] == title and got["d"][2] == f"{title} (2).pdf"
    half = " ".join(words(1).split()[:18])
    third = batch(known.where("pos = 0").union(features(("e", half)).withColumn("pos", F.lit(5).cast("long"))), entries, none, first.cache, first.index)
    assert {r["stem"]: r["target_title"] for r in third.plans.collect()} == {title: title, "e": None}
    kept = batch(known.where("pos = 0"), entries, none, first.cache, first.index, mode="full")
    row = kept.plans.first()  # scanned, but its hash is known
    assert row["target_title"] == title and row["match_method"] != "Fingerprint Cache: unchanged" and {r["sha256"] for r in kept.cache.collect()} == {"sa", "sb"}
    with pytest.raises(ValueError):
        batch(known, entries, none, first.cache, first.index, rebuild_cache=True)
    again = batch(known.where("pos = 0"), entries, none, first.cache, first.index, mode="full", rebuild_cache=True)
    row = again.plans.first()  # scanned anew, it has nothing but its name
    assert row["target_title"] == title and "low confidence" in row["match_method"] and again.cache.count() == 0


def test_review_decisions(spark):
    queue = spark.createDataFrame([(i, f"f{i}", "T" if i < 3 else f"T{i}") for i in range(7)], "pos long, stem string, suggested string")
    rows = [(0, "yes", None), (1, "yes", None), (2, "yes", "Mine"), (3, "no", None), (4, "keep", None), (5, "switch_to_auto", None)]
    got = review.decided(queue, spark.createDataFrame(rows, "pos long, decision string, chosen_title string"), spark.createDataFrame([("T",)], "title string"))
    assert {r["pos"]: (r["outcome"], r["title"], r["matched_via"]) for r in got.collect()} == {
        0: ("linked", "T", "Human-Confirmed"), 1: ("claimed", None, None), 2: ("linked", "Mine", "Human-Entered"), 3: ("refused", None, None),
        4: ("kept", "f4", "Human-Confirmed"), 5: ("auto", None, None), 6: ("auto", None, None),
    }


def test_guesses_fall_back_to_phrases(spark, entries):
    from catalink.operators import catalog, scoring

    e = catalog.with_siblings(catalog.derived(entries))
    f = spark.createDataFrame([(0, "x", "s", 1, 1, words(1), None, None, None), (1, "y", "t", 1, 1, "", None, words(2), None)], FILES)
    got = {r["file_id"]: (r["item_id"], r["source"]) for r in cascade.best_guesses(cascade._files(f), e, scoring.idf(e)).collect()}
    assert got == {0: (1, "content"), 1: (2, "phrase")}


def test_stream_of_arrivals(spark, entries, tmp_path):
    from catalink.operators import catalog, scoring
    from catalink.plans.run import storing
    from catalink.streaming.arrivals import link_batches

    store = storing(spark)
    none = spark.createDataFrame([], IMAGES)
    e = store(catalog.with_display_name(catalog.with_siblings(catalog.derived(entries)), none))
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, "x", "s", 1, 1, words(1), None, None, None)], FILES).write.parquet(source)
    got = []
    query = link_batches(spark.readStream.schema(FILES).parquet(source), e, store(scoring.idf(e)), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert [r["target_title"] for r in got] == ["TSR1 - Title Numberb"]


def test_clean_text_alphabet(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=30), min_size=200, max_size=400))
    def check(texts):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean_text("t").alias("c"), F.length("t")).collect():
            assert r["c"] == " ".join(r["c"].split(" ")).strip(" ") and "  " not in r["c"]

    check()
