import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from catalink.llm import language, quality


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=12))
def test_automaton_accepts_exactly_the_substrings(text, word):
    table = language.automaton(np.array([ord(c) - 95 for c in text], np.uint8), 8)
    state = 0
    for c in word:
        state = table[state, ord(c) - 95]
        if not state:
            break
    assert (bool(state) or not word) == (word in text)


def parse(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def greedy(numbers, sample):
    """Phrases of a text given by numbers, against a sample given likewise."""
    as_text = lambda x: "".join(map(chr, x))
    return parse(as_text(numbers), as_text(sample))


def test_phrases_are_those_of_greedy_parsing():
    rng = np.random.default_rng(8)
    samples = (("x", "abcabdabe fgh"), ("y", "hgf eba dcb"), ("z", "hello world hello"), ("w", "a" * 40))
    texts = ["abcab dabehgf", "aaaa", "fgh", "z abz", "", "ñhello" * 20, "a" * 700, "xa" * 300]
    texts += ["".join(rng.choice(list("abcdefghxyz éñ"), rng.integers(1, 900))) for _ in range(60)]
    for lane in (1, 7, 64, 1024):
        model = language.Languages(samples, language.Parsing(lane=lane))
        numbers = [model.numbers(t) for t in texts]
        got = model.phrases(numbers)
        for i, (_, sample) in enumerate(samples):
            own = model.numbers(sample)
            assert [greedy(t, own) for t in numbers] == got[i].tolist(), lane


def test_letters_are_what_python_calls_letters(spark):
    model = language.Languages((("x", "some words"),), language.Parsing())
    texts = ["²½", "Ⅷ", "12 34", "😀。", "_", "ª", "日"]
    assert [g[0] for g in model.judge(texts)] == ["und"] * 5 + ["x"] * 2


def test_und_and_edges(odd, none):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identified(odd).collect()]
    assert len(got) == 10 and {p for d, p, _ in got if d in (2, 3, 7)} == {"und"} and all(0 <= s <= 1 for *_, s in got)
    assert {s for d, _, s in got if d == 2} == {0.0}
    assert language.identified(none).count() == 0
    assert {r["lang_pred"] for r in language.identified(odd.withColumn("lang", odd["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und", ""}
    kept = language.in_known_language(odd)
    assert kept.columns == odd.columns and 2 not in [r["doc_id"] for r in kept.collect()]


def test_letters_of_all_scripts_are_told_apart():
    for letters in (5, 62, 63, 500, 1891, 1892, 5000, 20_000):
        codes, lengths = language._codes(letters, 62)
        seen = {tuple(c[:n]) for c, n in zip(codes.tolist(), lengths)}
        assert len(seen) == letters + 2 and codes.max() < 64
        assert not any(c[:k] in seen for c in seen for k in range(1, len(c)))
    rng = np.random.default_rng(2)
    words = lambda lo, n: " ".join("".join(chr(lo + x) for x in rng.integers(0, n, 5)) for _ in range(300))
    latin = [(f"l{i}", words(0x61, 26) + words(0xE0, 20)) for i in range(3)]
    alphabets = [(0x3B1, 17), (0x5D0, 27), (0x430, 32), (0xE01, 46), (0x3042, 80), (0x3042 + 0x60, 80), (0x4E00, 1500), (0x5E00, 1500)]
    model = language.Languages((*latin, *((f"s{i}", words(*a)) for i, a in enumerate(alphabets))), language.Parsing())
    got = model.judge([words(*a) for a in alphabets])
    assert [g[0] for g in got] == [f"s{i}" for i in range(len(alphabets))]


def test_samples_are_drawn_evenly():
    assert language.even(["a" * 10, "b" * 2, "c" * 9], 12) == ["a" * 5, "bb", "c" * 5]
    assert language.even(["a", "bb"], 99) == ["a", "bb"] and language.even([], 9) == []


def test_all_languages_are_learnt(spark):
    rng = np.random.default_rng(3)
    names = [f"{i:02}" for i in range(70)]
    own = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for n in names}
    rows = [(70 * k + i, " ".join(rng.choice(own[n], 12)), n) for k in range(3) for i, n in enumerate(names)]
    got = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.Parsing(letters=400)).collect()
    want = {r[0]: r[2] for r in rows}
    assert len({r["lang_pred"] for r in got}) == 70 and all(r["lang_pred"] == want[r["doc_id"]] for r in got)


FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."


def test_strange_texts_go_and_clean_ones_stay(spark):
    rng = np.random.default_rng(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(40)) for _ in range(30)]
    strange = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([FINNISH, POLISH, *noise])], docs.schema)
    kept = {r["doc_id"] for r in language.in_known_language(docs.union(strange)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identified(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got["lang"] == got["lang_pred"]).mean() > 0.95


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.93

    def walk(row):
        total = model.base
        for f, lim, leaf in zip(model.feature, model.limit, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > lim[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


def test_a_tree_splits_where_a_plain_search_does():
    """One level, few different values: every split of every column is tried by its loss."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 20, (400, 3)).astype(float)
    y = (x[:, 1] > 12).astype(float)
    y[rng.random(400) < 0.2] = 0
    how = quality.Boosting(trees=1, depth=1)
    model = quality.fit(x, y, how)
    g, h = 1 / (1 + np.exp(-model.base)) - y, np.full(400, y.mean() * (1 - y.mean()))
    gain = {(f, v): sum(g[m].sum() ** 2 / (h[m].sum() + how.ridge) for m in (x[:, f] <= v, x[:, f] > v)) for f in range(3) for v in np.unique(x[:, f])[:-1]}
    f, v = max(gain, key=gain.get)
    assert model.feature[0, 0] == f and v <= model.limit[0, 0] < v + 1
    left = x[:, f] <= v
    assert np.allclose(model.leaf[0], [-g[m].sum() / (h[m].sum() + how.ridge) * how.rate for m in (left, ~left)])


def test_statistics_have_one_length(odd):
    assert {len(quality.statistics(t)) for t in (None, "", "a", "a b", "x\ny z\n", "é " * 1000)} == {len(quality.STATISTICS)}


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.scored(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.scored(odd, labels.where("false")).collect()} == {0.5}
    assert quality.scored(none, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.scored(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0.3) == (got["quality"] == 1)).mean() > 0.9
