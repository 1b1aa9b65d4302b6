import pytest
from pyspark.sql import functions as F

from catalink.functions.text import clean_text
from catalink.operators import actions, catalog, constraints, scoring, state
from catalink.operators.select import accept, top2


def test_top2_ties_and_single_candidates(spark):
    rows = spark.createDataFrame([(1, 5, 0.9), (1, 3, 0.9), (2, 7, 0.4)], "f long, i long, s double")
    got = {r["f"]: (r["i"], r["s"], r["runner_up"]) for r in top2(rows, "f", "i", "s").collect()}
    assert got == {1: (3, 0.9, 0.9), 2: (7, 0.4, 0.0)}
    assert [r["f"] for r in accept(top2(rows, "f", "i", "s"), "s", 0.3, 0, strict=True).collect()] == [2]
    near = top2(rows.withColumn("s", F.col("s") * 10), "f", "i", "s", 999, smallest=True)
    assert {r["f"]: r["runner_up"] for r in near.collect()}[2] == 999


def test_overlap_needs_twenty_words(spark):
    words = [f"word{i:02d}" for i in range(25)]
    entries = spark.createDataFrame([(1, words), (2, words[:19])], "item_id long, words array<string>")
    files = spark.createDataFrame([(9, words)], "file_id long, words array<string>")
    got = scoring.overlap(files, entries, scoring.idf(entries)).collect()
    assert [(r["item_id"], r["overlap"]) for r in got] == [(1, 1.0)]


def test_bonuses_without_shared_words_stay_candidates(spark):
    entries = spark.createDataFrame([(1, ["unrelated"] * 1, "64 pages", "battlesystem fantasy combat")], "item_id long, words array<string>, notes string, core_title string")
    files = spark.createDataFrame([(7, ["other"], "x battlesystem fantasy combat y", 64, 0.0)], "file_id long, words array<string>, text string, page_count int, bytes_per_page double")
    assert [r["score"] for r in scoring.scores(files, entries, scoring.idf(entries)).collect()] == [0.5]


def entry(spark, *rows):
    return catalog.derived(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, title string, notes string, year string, application_path string"))


def test_derived_catalog(spark):
    got = entry(spark, ("TSR1: A Book", None, None, "C:\\x\\a-b.lnk"), ("", "n", "1980", None), ("B", "n", "", None)).orderBy("pos").collect()
    assert [(r["title"], r["year"], r["is_document"], r["application_clean"], r["notes"]) for r in got] == [("TSR1: A Book", "9999", False, "a b", ""), ("B", "9999", True, "", "n")]


def test_placeholder_siblings(spark):
    e = entry(spark, ("TSRXXXX: Fast Play", "", "", ""), ("TSR11: Fast Play Wrath", "", "", ""), ("TSRXXXX: Fast", "", "", ""), ("TSR12: Faster", "", "", ""), ("TSRXXXX: Lone", "", "", ""))
    got = {r["pos"]: r["has_specific_sibling"] for r in catalog.with_siblings(e).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False}


def test_display_names(spark):
    e = entry(spark, ("TSR1: Hand Book", "", "", "C:/p/Special Name.pdf"), ("TSR1: Hand Book", "", "", ""), ("TSR9: Nothing", "", "", ""), ("TSR7: Deep", "", "", ""))
    images = spark.createDataFrame([(0, "TSR2 Hand Book"), (1, "TSR1 Hand Book"), (2, "Special Name"), (3, "The Deep Sea")], "pos long, original_name string")
    clean = clean_text("original_name")
    images = images.select("pos", "original_name", clean.alias("clean_name"), F.regexp_replace(clean, r"^tsr\d+ *", "").alias("core_name"))
    got = {r["pos"]: r["display_name"] for r in catalog.with_display_name(e, images).collect()}
    assert got == {0: "Special Name", 1: "TSR1 Hand Book", 2: "TSR9 - Nothing", 3: "The Deep Sea"}


def test_ambiguous_titles_list_the_others(spark):
    e = entry(spark, ("TSR1: Same", "", "", ""), ("TSR2: Same", "", "", ""), ("TSR3: Other", "", "", "")).withColumn("display_name", F.col("title"))
    assert {r["display_name"]: r["others"] for r in catalog.ambiguous_titles(e).collect()} == {"TSR1: Same": "TSR2: Same", "TSR2: Same": "TSR1: Same"}


def test_software_exact_core_title_beats_longer_substring(spark):
    e = entry(spark, ("TSR2167: Core Rules CD ROM", "", "", "a.lnk"), ("TSR9: Core Rules CD ROM 2", "", "", "b.lnk"))
    names = spark.createDataFrame([(1, "core rules cd rom"), (2, "abc")], "name_id long, clean_name string")
    assert [(r["name_id"], r["pos"]) for r in catalog.software_choice(names, e).collect()] == [(1, 0)]


def test_empty_item_name_lies_in_every_name(spark):
    items = spark.createDataFrame([(4, ""), (9, "long name")], "pos long, n string")
    names = spark.createDataFrame([(1, "anything"), (2, "abc")], "name_id long, clean_name string")
    assert [(r["name_id"], r["pos"]) for r in catalog.substring_choice(names, items, "n").collect()] == [(1, 4)]


def test_duplicate_targets_are_all_refused(spark):
    plans = spark.createDataFrame([(1, "a", "T"), (2, "b", "T"), (3, "c", "U"), (4, "d", None)], "file_id long, stem string, target_title string")
    assert {r["file_id"]: r["target_title"] for r in constraints.refuse_duplicates(plans).collect()} == {1: None, 2: None, 3: "U", 4: None}


def test_target_that_is_a_moving_files_name_is_refused(spark):
    first = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "c")], "file_id long, stem string, target_title string")
    second = spark.createDataFrame([(1, "a", "b"), (2, "b", "z")], "file_id long, stem string, target_title string")
    assert {r["file_id"]: r["target_title"] for r in constraints.refuse_stable_names(second, first).collect()} == {1: None, 2: "z"}


def test_collisions(spark):
    f = spark.createDataFrame([("X.pdf", "1"), ("X (2).pdf", "1"), ("Y.pdf", "1"), ("Y (10).pdf", "2"), ("Y (2).pdf", "1"), ("Z (2).pdf", "3")], "file_name string, sha256 string")
    assert {r["base"]: r["is_identical"] for r in constraints.collision_groups(f).collect()} == {"X": True, "Y": False}
    assert [r["file_name"] for r in constraints.collision_queue(f).orderBy("place").collect()] == ["Y.pdf", "Y (10).pdf", "Y (2).pdf"]


def test_cache_merge_priorities(spark):
    c = "sha256 string, title string, matched_via string"
    cache = spark.createDataFrame([("a", "old", "x"), ("b", "old", "x")], c)
    auto = spark.createDataFrame([("a", "auto", "m", 1), ("c", "auto", "m", 2), ("d", "low", "m (low confidence)", 3), ("e", None, "m", 4)], c + ", pos long")
    human = spark.createDataFrame([("b", "human", "Human-Confirmed", 1)], c + ", pos long")
    assert {r["sha256"]: r["title"] for r in state.merge_cache(cache, auto, human).collect()} == {"a": "old", "b": "human", "c": "auto"}


def test_numbering_takes_the_next_free_name():
    got = actions.free_names([("1.pdf", "A"), ("2.pdf", "A"), ("3.pdf", "A (2)"), ("4.pdf", None)], ["1.pdf", "2.pdf", "3.pdf", "4.pdf", "b.pdf"])
    assert [n for _, n in got] == ["A.pdf", "A (2).pdf", "A (2) (2).pdf", None]
    assert len({n for _, n in got if n}) == 3


def test_a_file_that_is_right_keeps_its_name(spark):
    plans = [("a.pdf", "X"), ("X.pdf", "X"), ("b.pdf", "Y: 1"), ("c.pdf", None), ("d.pdf", "c"), ("e.pdf", "x"), ("f.pdf", "X (2)"), ("g.pdf", "X")]
    want = ["X (2).pdf", "X.pdf", "Y 1.pdf", None, "c (2).pdf", "x (3).pdf", "X (2) (2).pdf", "X (4).pdf"]
    assert [n for _, n in actions.free_names(plans, [old for old, _ in plans])] == want
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(plans)], "pos long, old string, title string")
    assert [r["new"] for r in actions.numbered(df).orderBy("pos").collect()] == want


def test_a_table_is_numbered_like_a_list(spark):
    import random

    rng = random.Random(3)
    names = ["A", "a", "A (2)", "A (3)", "B", "B (2) (2)", "B (2)", None, "C?"]
    plans = [(f"{rng.choice(['A', 'B (2)', 'C', 'z'])} {i}.pdf" if rng.random() < 0.8 else f"A ({i + 2}).pdf", rng.choice(names)) for i in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(plans)], "pos long, old string, title string").repartition(7)
    got = [(r["old"], r["new"]) for r in actions.numbered(df).orderBy("pos").collect()]
    assert got == actions.free_names(plans, [old for old, _ in plans])
    kept = [(new or old).lower() for old, new in got]
    assert len(set(kept)) == len(kept)


def test_names_that_stay_are_compared_as_file_names(spark):
    first = spark.createDataFrame([(1, "Who Goes There", None), (2, "b", None)], "file_id long, stem string, target_title string")
    second = spark.createDataFrame([(2, "b", "Who Goes There?", "m")], "file_id long, stem string, target_title string, match_method string")
    row = constraints.refuse_stable_names(second, first).first()
    assert row["target_title"] is None and row["match_method"].startswith("Skipped -> matches the current name")
    skipped = spark.createDataFrame([("c",)], "stem string")
    other = spark.createDataFrame([(2, "b", "c", "m")], second.schema)
    assert constraints.refuse_stable_names(other, first.where("file_id = 9"), skipped).first()["target_title"] is None


def test_an_interrupt_puts_files_back(tmp_path, monkeypatch):
    import os

    for n in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / n).write_text(n)
    real, calls = os.rename, []

    def rename(old, new):
        calls.append(new)
        if len(calls) == 5:
            raise KeyboardInterrupt
        real(old, new)

    monkeypatch.setattr(os, "rename", rename)
    done = actions.apply_plan(str(tmp_path), [("a.pdf", "x.pdf"), ("b.pdf", "y.pdf"), ("c.pdf", "z.pdf")])
    assert done.cancelled and done.renamed == [("a.pdf", "x.pdf")] and sorted(p.name for p in tmp_path.iterdir()) == ["b.pdf", "c.pdf", "x.pdf"]
    monkeypatch.undo()
    back, gone = actions.undo_last_run(str(tmp_path), [*done.renamed, ("q.pdf", "gone.pdf"), ("b.pdf", "b.pdf")])
    assert gone == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "b.pdf", "c.pdf"] and back.renamed == [("x.pdf", "a.pdf")]


def test_apply_and_undo_restore_names(tmp_path):
    for n in ("a.pdf", "b.pdf"):
        (tmp_path / n).write_text(n)
    done = actions.apply_plan(str(tmp_path), [("a.pdf", "b.pdf"), ("b.pdf", "a.pdf")])
    assert len(done.renamed) == 2 and (tmp_path / "b.pdf").read_text() == "a.pdf"
    back, lost = actions.undo_plan(done.renamed, [p.name for p in tmp_path.iterdir()])
    actions.apply_plan(str(tmp_path), back)
    assert lost == 0 and (tmp_path / "a.pdf").read_text() == "a.pdf"
    assert actions.undo_plan([("x", "gone.pdf")], ["a.pdf"]) == ([], 1)


@pytest.mark.parametrize("case", [("f", 5, 1, True), ("f", 6, 1, False), ("f", 5, 2, False), ("g", 5, 1, False)])
def test_incremental_partition(spark, case):
    name, size, mtime, skip = case
    index = spark.createDataFrame([("f", 5, 1, "h")], "file_name string, size long, mtime long, sha256 string")
    cache = spark.createDataFrame([("h", "T", "x")], "sha256 string, title string, matched_via string")
    files = spark.createDataFrame([(name, size, mtime)], "file_name string, size long, mtime long")
    assert state.incremental_partition(files, index, cache).first()["skip"] is skip


def test_claims_of_other_files(spark):
    rows = [(0, "x.iso", ".iso", "A: b"), (1, "y.iso", ".iso", "A: b"), (2, "C.iso", ".iso", "C"), (3, "z.iso", ".iso", "D"), (4, "w.iso", ".iso", "a b"), (5, "v.iso", ".iso", None), (6, "u.bin", ".bin", "E"), (7, "t.iso", ".iso", "X")]
    plans = spark.createDataFrame(rows, "pos long, old string, ext string, title string")
    existing = spark.createDataFrame([(r[1],) for r in rows] + [("d.ISO",)], "file_name string")
    got = {r["pos"]: (r["new"], r["outcome"]) for r in actions.claimed(plans, existing).collect()}
    assert got == {
        0: ("A b.iso", "renamed"), 1: (None, "claimed"), 2: (None, "kept"), 3: (None, "taken"), 4: (None, "taken"), 5: (None, "unmatched"), 6: ("E.bin", "renamed"), 7: (None, "taken"),
    }
    assert actions.claimed(plans.limit(0), existing).count() == 0


def test_names_are_made_different_before_they_are_compared_or_sorted(spark):
    import re

    e = entry(spark, ("TSR1: Same", "", "", "C:/p/x.pdf"), ("TSR1: Same", "", "", ""), ("TSR2: Same", "", "", ""), ("TSR2: Same", "", "", ""), ("TSR3: Deep Sea", "", "", ""))
    images = spark.createDataFrame([(i, n, n.lower(), n.lower()) for i, n in [(5, "Same"), (3, "Same"), (4, "The Deep Sea"), (9, "")]], "pos long, original_name string, clean_name string, core_name string")
    named = catalog.with_display_name(e, images)
    assert re.search(r"Aggregate \[original_name#\d+, clean_name#\d+, core_name#\d+\]", named._jdf.queryExecution().optimizedPlan().toString())
    assert {r["pos"]: r["display_name"] for r in named.collect()} == {0: "Same", 1: "Same", 2: "Same", 3: "Same", 4: "The Deep Sea"}
    ambiguous = catalog.ambiguous_titles(e.withColumn("display_name", F.col("title")))
    assert re.search(r"Aggregate \[core_title#\d+, display_name#\d+\]", ambiguous._jdf.queryExecution().optimizedPlan().toString())
    assert {r["display_name"]: (r["n_names"], r["others"]) for r in ambiguous.collect()} == {"TSR1: Same": (2, "TSR2: Same"), "TSR2: Same": (2, "TSR1: Same")}
