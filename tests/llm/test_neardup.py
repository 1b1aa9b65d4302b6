import numpy as np
import pytest

from catalink.llm import golay, neardup
from catalink.llm.components import components


def brute(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def classes(labels):
    by = {}
    for i, x in enumerate(labels):
        by.setdefault(x, []).append(i)
    return sorted(map(tuple, by.values()))


def clustered(seed=3, centres=60, each=12):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(each):
            v = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                v ^= 1 << int(b)
            out.append(v)
    return np.unique(np.array(out, np.uint64))


def test_the_code_is_perfect():
    counts = np.bincount(golay.decode(np.arange(1 << 23, dtype=np.uint32)))
    assert len(counts) == 4096 and (counts == 2048).all()


def test_keys_are_one_or_six():
    row, _, own = golay.around(np.arange(5000, dtype=np.uint32) * 1597, 23)
    assert set(np.bincount(row)) == {1, 6} and own.sum() == 5000


def test_keys_lose_no_link():
    fps = clustered()
    key, role, fp = golay.keys(fps)
    order = np.argsort(key, kind="stable")
    a, b = neardup.links_in(key[order], role[order], fp[order], 3)
    at = {int(x): i for i, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b):
        parent[find(at[int(x)])] = find(at[int(y)])
    assert classes([find(i) for i in range(len(fps))]) == classes(brute(fps))


@pytest.mark.parametrize("limit", [20_000, 5])
def test_components_against_brute_force(spark, limit):
    """With a limit of 5 rows a group, most groups are split into blocks."""
    fps = clustered(seed=limit)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = neardup.neighbour_links(df, neardup.Neighbours(group=limit)).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[find(at[r["a"]])] = find(at[r["b"]])
    assert classes([find(i) for i in range(len(fps))]) == classes(brute(fps))


def test_long_chain(spark):
    links = spark.createDataFrame([(i * 7919 % 10007, (i + 1) * 7919 % 10007) for i in range(300)], "a long, b long")
    assert components(links).select("root").distinct().count() == 1


def test_simhash_of_few_words():
    import xxhash

    assert neardup.simhash(None) == neardup.simhash(" \n") == 0
    assert neardup.simhash("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert neardup.simhash("É x") == xxhash.xxh64_intdigest("É x".encode(), 42)


def test_blocks_of_hashes_are_added(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = neardup.simhash(text)
    monkeypatch.setattr(neardup, "_SHINGLES", 7)
    assert neardup.simhash(text) == whole


def test_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[2] == by[3] == by[7] == {2} and by[1] == {1} and by[None] == {None}
    assert neardup.near_duplicates(none).count() == 0


def plain_simhash(text, words=3, seed=42):
    """By the definition, a bit and a shingle at a time."""
    import re

    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_query_against_brute_force(spark):
    """``op2_neardup`` over a whole small table: fingerprints by definition, components by comparing all pairs."""
    rng = np.random.default_rng(9)
    words = ["The", "quick", "brown", "Fox", "ÉTÉ", "日本", "x\x1cy", "a", "b", "over", "\u00a0"]
    base = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(40)]
    texts = [*base, *base[:20], *(t + " tail" for t in base[20:]), *(t.upper().lower() for t in base), None, "", " \n\t"]
    rows = [(i, t) for i, t in zip(rng.permutation(len(texts)).tolist(), texts)]
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: plain_simhash(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == want
    ids = sorted(want)
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                if (want[i] ^ want[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: c for i, (_, c) in got.items()} == root
