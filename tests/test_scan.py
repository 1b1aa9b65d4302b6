"""Passes over files with an index of entries give what joins of any size give, without a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from catalink.functions.text import SPACES, clean_text, has_verbatim_title, significant_words
from catalink.operators import phrases, scan, scoring, select

LETTERS = "abñé"


def vocabulary(rng, n=60):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.choice([2, 4, 5, 6]))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    words = vocabulary(rng)
    some = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
    entries = []
    for i in range(30):
        notes = some(5, 60)
        title = None if i == 3 else "" if i == 4 else " ".join(notes.split()[: rng.randint(1, 7)])
        entries.append((i * 3, notes, title, None if i == 5 else f"{notes} {rng.choice([10, 12, 128])} pages 10page {rng.choice(['', 'in Colour'])}", f"name {i % 7}", rng.choice([True, False, None])))
    files = []
    for i in range(120):
        text = None if i == 9 else "" if i == 10 else some(1, 200)
        if i % 4 == 0 and text:
            text = f"x{entries[i % 30][2] or ''}y {text}"
        files.append((i, text, rng.choice([None, 0, 10, 12, 128]), rng.choice([None, 0.0, 30_000.0, 130_000.0]), rng.choice(["name 1", "name 5", "", None])))
    e = spark.createDataFrame(entries, "item_id long, clean_notes string, core_title string, notes string, clean_title string, out boolean").withColumn("words", significant_words("clean_notes"))
    f = spark.createDataFrame(files, "file_id long, text string, page_count int, bytes_per_page double, clean_name string").withColumn("words", significant_words("text"))
    return f.repartition(3), e, scoring.idf(e)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("hidden", [None, "out"])
def test_scores_of_a_pass_equal_those_of_joins(tables, monkeypatch, hidden):
    f, e, weights = tables
    flag = None if hidden is None else F.col(hidden)
    whole = rows(scoring.scores(f, e, weights, hidden=flag))
    monkeypatch.setattr(scan, "CELLS", 50)
    monkeypatch.setattr(scan, "BYTES", 400)
    parted = rows(scoring.scores(f, e, weights, hidden=flag))
    monkeypatch.setattr(select, "BROADCAST_ROWS", 2)
    joined = rows(scoring.scores(f, e, weights, hidden=flag))
    assert len(whole) > 200 and whole == parted and whole == joined


def test_overlaps_and_titles_of_a_pass_equal_those_of_joins(tables, monkeypatch):
    f, e, weights = tables
    overlaps, titles = rows(scoring.overlap(f, e, weights)), rows(scoring.verbatim_titles(f, e))
    pairs = f.select("file_id", "text").crossJoin(e.select("item_id", "core_title")).where(has_verbatim_title("core_title", "text"))
    assert titles == rows(pairs.select("file_id", "item_id")) and len(titles) > 5
    monkeypatch.setattr(select, "BROADCAST_ROWS", 2)
    assert overlaps == rows(scoring.overlap(f, e, weights)) and titles == rows(scoring.verbatim_titles(f, e))


def test_no_file_is_shuffled_or_read_twice_for_scores(tables):
    f, e, weights = tables
    plan = scoring.scores(f.coalesce(1), e, weights, hidden=F.col("out"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1


def test_nothing_to_score(tables):
    f, e, weights = tables
    none = e.where("item_id < 0")
    assert rows(scoring.scores(f, none, scoring.idf(none))) == [] and rows(scoring.overlap(f, none, weights)) == []
    assert rows(scoring.scores(f.where("file_id < 0"), e, weights)) == [] and rows(scoring.verbatim_titles(f, none)) == []


def test_cleaning_treats_every_code_point_as_its_classes_say(spark):
    texts = ["".join(f"{chr(c)}q{chr(c)}{chr(c)} " for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 256)]
    t = F.replace(F.replace(F.replace("t", F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(F.replace(F.lower(t), F.lit(" n "), F.lit(" and ")), rf"[^\p{{L}}\p{{N}}{SPACES}]", "")
    plain = F.trim(F.regexp_replace(t, rf"[{SPACES}]+", " "))
    df = spark.createDataFrame([(t,) for t in [*texts, "  a \t\n b　　c n d  ", "", " "]], "t string")
    assert df.where(~clean_text("t").eqNullSafe(plain)).count() == 0


def test_runs_and_phrases_of_a_pass_equal_those_of_joins(tables, monkeypatch):
    f, e, _ = tables
    quoted = e.select((F.col("item_id") + 1000).alias("file_id"), F.concat(F.lit("x  y "), F.substring("clean_notes", 1, 150), F.lit(" z")).alias("text"))
    f = f.select("file_id", "text").union(quoted).union(quoted.select(F.lit(-1).cast("long"), F.lit("only three words"))).distinct()
    plan = phrases.phrase_scores(f, e, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    shared, scored = rows(phrases.shingle_candidates(f, e)), rows(phrases.phrase_scores(f, e, 20))
    assert len(shared) >= 30 and any(0 < s < 1 for _, _, s in scored)
    assert rows(phrases.shingle_candidates(f, e.where("item_id < 0"))) == []
    monkeypatch.setattr(select, "BROADCAST_ROWS", 2)
    assert shared == rows(phrases.shingle_candidates(f, e)) and scored == rows(phrases.phrase_scores(f, e, 20))


def test_nearest_hashes_equal_those_of_joins(spark, monkeypatch):
    rng = random.Random(5)
    near = [rng.getrandbits(64) for _ in range(6)]
    hashes = [[((near[rng.randrange(6)] ^ (1 << rng.randrange(64))) & (2**64 - 1)) - 2**63, rng.randrange(3) - 1] for _ in range(150)]
    v = spark.createDataFrame(list(enumerate(hashes)), "item_id long, b array<bigint>").repartition(5)
    asked = v.where("item_id % 7 = 0").select(F.col("item_id").alias("file_id"), F.col("b").alias("a"))
    found = select.nearest2(asked, v, 999)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = rows(found)
    monkeypatch.setattr(scan, "CELLS", 100)
    assert got == rows(select.nearest2(asked, v, 999))
    alone = v.where("item_id = 7")
    assert rows(select.nearest2(asked, alone, 999).where("file_id = 7")) == [] and rows(select.nearest2(asked.where("file_id = 7"), v.where("item_id IN (7, 8)"), 999))[0][3] == 999
    monkeypatch.setattr(select, "BROADCAST_ROWS", 2)
    assert len(got) == 22 and got == rows(select.nearest2(asked, v, 999))
