import numpy as np

import corpus_pipeline
from catalink.llm import nearcopies, neardup


def edited(seed=5, base=40, each=3, words=300, edits=(3, 9)):
    """Groups of texts, the copies with a few words changed: pairs from about 0.7 to 0.95."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(base):
        text = rng.integers(0, 5000, words)
        out.append(text)
        for _ in range(each - 1):
            copy = text.copy()
            copy[rng.choice(words, rng.integers(*edits), replace=False)] = rng.integers(5000, 9000, 1)
            out.append(copy)
    return [" ".join(f"w{x}" for x in t) for t in out]


def alike(texts):
    sets = [set(nearcopies.shingles(nearcopies.words_of(t)).tolist()) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def roots(n, pairs):
    at = list(range(n))
    for i, j in pairs:
        x, y = at[i], at[j]
        at = [min(x, y) if r in (x, y) else r for r in at]
    return at


def test_near_copies_beyond_three_bits_are_found(spark):
    texts = edited()
    pairs = alike(texts)
    far = [p for p in pairs if (neardup.simhash(texts[p[0]], 5) ^ neardup.simhash(texts[p[1]], 5)).bit_count() > 3]
    assert len(far) > 20 and len(pairs) < 3 * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, df, "").collect())
    assert kept == sorted(set(roots(len(texts), pairs)))


def test_large_bands_keep_the_links(spark):
    texts = edited(seed=6, base=2, each=30, edits=(1, 4))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    some = nearcopies.one_of_each(df, nearcopies.Likeness(group=4)).count()
    assert some == len(set(roots(len(texts), alike(texts))))


def drifting(n=120, words=120, seed=7):
    """A chain: each text is alike to its neighbours, and less and less to those farther off."""
    rng = np.random.default_rng(seed)
    text, out = rng.integers(0, 5000, words), []
    for i in range(n):
        text = text.copy()
        text[(3 * i) % (words - 3) : (3 * i) % (words - 3) + 3] = 10_000 + i
        out.append(" ".join(f"w{x}" for x in text))
    return out


def test_chains_that_hubs_do_not_join_are_found(spark):
    """Bands of more rows than ``group``, one hub, and blocks of few rows: rows are compared across components."""
    texts = drifting() + edited(seed=8, base=3, each=25, edits=(1, 9))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(set(roots(len(texts), alike(texts))))
    for how in (nearcopies.Likeness(group=1, hubs=1, block=9), nearcopies.Likeness(group=2, hubs=1)):
        assert sorted(r["doc_id"] for r in nearcopies.one_of_each(df, how).collect()) == want


def test_rows_are_compared_across_components():
    texts = drifting(n=40) + edited(seed=8, base=3, each=10, edits=(1, 9))
    sets = [np.unique(nearcopies.shingles(nearcopies.words_of(t))) for t in texts]
    factors = nearcopies._factors(nearcopies.Likeness())
    low = np.array([(nearcopies.least_hashes(h, factors) >> np.uint64(40)).astype("<u2") for h in sets])
    want, comp = roots(len(texts), alike(texts)), np.random.default_rng(2).permutation(len(texts)) % 50
    joined = [(i, j) for i in range(len(comp)) for j in range(i) if comp[i] == comp[j]]
    for how in (nearcopies.Likeness(), nearcopies.Likeness(kept=100)):
        pairs = nearcopies.across(low, [h[: how.kept] for h in sets], comp.copy(), how)
        sure = [p for p in pairs if tuple(sorted(p, reverse=True)) in set(alike(texts))]
        assert len(sure) == len(pairs) or how.kept == 100
        assert roots(len(texts), joined + sure) == roots(len(texts), joined + alike(texts))
    assert len(set(want)) > 3


def test_odd_rows_of_near_copies(odd, none):
    assert nearcopies.one_of_each(none).count() == 0
    got = nearcopies.one_of_each(odd)
    assert got.columns == odd.columns and {r["doc_id"] for r in got.collect()} == {1, 2, None, 4, 5}
    named = odd.selectExpr("*", "'mine' AS id_null", "'own' AS ID", "8 AS keep_id")
    kept = nearcopies.one_of_each(named)
    assert kept.columns == named.columns and {(r["id_null"], r["ID"], r["keep_id"]) for r in kept.collect()} == {("mine", "own", 8)}


def test_a_row_of_each_component_stays_whatever_its_id(spark, odd):
    assert sorted(str(r["doc_id"]) for r in nearcopies.one_of_each(odd).collect()) == sorted(["1", "2", "None", "4", "5", "5"])
    rows = [(None, f"text number {i} of no id") for i in range(20)] * 2 + [(7, "one of id seven"), (7, "and another")]
    got = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 22 and {tuple(r) for r in got} == set(rows)
