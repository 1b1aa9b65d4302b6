from pyspark.sql import functions as F

from catalink.functions import text as T


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items())).select(column.alias("x")).first()["x"]


def test_clean_text_normalises(spark):
    cases = {"AD&D_Core-Rules": "ad and d core rules", "rock 'n' roll": "rock n roll", "a n n b": "a and n b", "  Ä\u00a0b\t c!": "ä b c", "": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.clean_text("t").alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_clean_text_is_not_idempotent(spark):
    df = spark.createDataFrame([("a n n b",)], "t string")
    assert df.select(T.clean_text(T.clean_text("t")).alias("c")).first()["c"] == "a and and b"


def test_codes(spark):
    assert one(spark, T.strip_code("t"), t="tsr2010 players handbook") == "players handbook"
    assert one(spark, T.strip_code("t"), t="tsrxxxx fast play") == "tsrxxxx fast play"
    assert one(spark, T.strip_any_code("t"), t="tsrxxxx fast play") == "fast play"


def test_page_bonus_has_no_left_boundary(spark):
    assert one(spark, T.page_bonus("p", "n"), p=128, n="1128 page") == 0.3
    assert one(spark, T.page_bonus("p", "n"), p=64, n="a 64page book") == 0.3
    assert one(spark, T.page_bonus("p", "n"), p=64, n="64  page") == 0.0
    assert one(spark, T.page_bonus("p", "n"), p=0, n="00 page") == 0.0


def test_density_bonus(spark):
    assert one(spark, T.density_bonus("b", "n"), b=130000.0, n="full Color") == 0.1
    assert one(spark, T.density_bonus("b", "n"), b=30000.0, n="black and white") == 0.05
    assert one(spark, T.density_bonus("b", "n"), b=0.0, n="plain") == 0.0


def test_verbatim_title_needs_three_words(spark):
    assert one(spark, T.has_verbatim_title("t", "x"), t="battlesystem fantasy combat", x="the battlesystem fantasy combat supplement")
    assert not one(spark, T.has_verbatim_title("t", "x"), t="oriental adventures", x="oriental adventures here")
    assert not one(spark, T.has_verbatim_title("t", "x"), t="advanced dungeons and dragons", x="advanced dungeons and dragons")


def test_names_and_labels(spark):
    assert one(spark, T.safe_file_name("t"), t=' What: a "Day"? ') == "What a Day.pdf"
    assert one(spark, T.without_low_confidence("t"), t="Match (12 pages, low confidence)") == "Match (12 pages)"
    assert one(spark, T.without_low_confidence("t"), t="Match (low confidence)") == "Match"


def test_hamming(spark):
    df = spark.createDataFrame([([1, -1], [3, 0])], "a array<bigint>, b array<bigint>")
    assert df.select(T.hamming("a", "b").alias("d")).first()["d"] == 65


def test_significant_words_are_distinct(spark):
    df = spark.createDataFrame([("dragon dragon the rules sword abc",)], "t string")
    assert df.select(T.significant_words("t").alias("w")).first()["w"] == ["dragon", "sword"]
    assert df.select(F.size(T.name_tokens("t")).alias("n")).first()["n"] == 4
