import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from catalink.llm import licences, mixing, packing, sharding
from catalink.llm.tokenizing import Encoder, vocabulary


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_equal_the_librarys(name, spaces):
    """Against a fresh tokenizer, one text at a time and all at once; added tokens stand anywhere."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    enc, plain = Encoder(vocabulary(name), spaces, 500), Tokenizer.from_file(vocabulary(name))
    rng = random.Random(4)
    parts = ["a", "B", " ", "\n", "é", "ß", "'s", "'", "!", "12", "\t", "  ", "İ", "Σς", "\x1c", "e\u0301", "_", "日本", "word", "\u3000", "\x85", "Hello,", " and", "two\nlines", " x."]
    parts += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", " ", "\n", "x" * 5000, "of words " * 900]
    for e in parts[-3:]:
        texts += [f"a {e} b", e, e + e, f"x{e}", f"{e}\n\nNext text", f"one\n{e} \n two's  {e}.", f"<|{e}|>", f"{e}\u0338 é"]
    ids, ends = enc.encode_all(pa.array(texts), 7)
    for t, lo, hi in zip(texts, [0, *ends], ends):
        want = plain.encode(t or "", add_special_tokens=False).ids
        assert enc.encode(t).tolist() == want, repr(t)
        assert ids[lo:hi].tolist() == [*want, 7], repr(t)
    assert ends[-1] == len(ids) and enc.encode_all(pa.array([], pa.string()), 7)[0].tolist() == []


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    from catalink.llm.shared import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (5, None, 90, 3, 3, 3, 0, 40)])], ["t"])
    for start, many in ((0, 8), (2, 6)):
        got = [p.column(0).to_pylist() for p in slices(batch.slice(start, many), 0, 3, 10)]
        assert [x for p in got for x in p] == batch.slice(start, many).column(0).to_pylist()
        assert all(len(p) <= 3 and (len(p) == 1 or sum(len(x or "") for x in p) <= 10) for p in got)
    assert list(slices(batch.slice(0, 0), "t")) == []


def test_differencing_spreads_evenly():
    sizes = np.random.default_rng(1).integers(1, 1025, 600)
    window, sums = packing.difference(sizes, 80)
    assert sorted(np.bincount(window, weights=sizes, minlength=80)) == sorted(sums) and sums.max() - sums.min() < 100


def test_windows_rise_until_none_is_over():
    sizes = np.array([3000] * 7)
    window = packing.windows(sizes, 4096)
    assert len(set(window)) == 7 and packing.windows(np.array([5]), 4096).tolist() == [0]


def test_packing_of_odd_texts(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in odd.collect():
        want[r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1] += 1
    got, sequences = Counter(), defaultdict(list)
    for r in packing.pack(odd).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_tokens"] == 1:
            assert r["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little"))
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(none).count() == 0


def test_padding_is_little(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(df).groupBy("sequence_id").sum("length").toPandas()
    assert rows["sum(length)"].sum() / (4096 * len(rows)) > 0.97


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare the excess until no target is above its ceiling."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] >= cap * sizes[s]]
        if not over:
            return {**full, **{s: level * w[s] for s in open_}}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def check_mix(df):
    rows = mixing.mix_sources(df).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        n = len((r["text"] or "").encode().split())
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n
        sizes[r["source"]] += n
        taken[r["source"]] += r["taken"]
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert want[s] - taken[s] < 3, (s, want[s], taken[s])


def test_mix_of_odd_rows(odd, none):
    check_mix(odd)
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(odd).columns[: len(odd.columns) - 3][:4] == ["doc_id", "text", "lang", "source"]


def test_mix_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_mix(df)
    a, b = (sorted(map(tuple, mixing.mix_sources(d, slim=True).collect())) for d in (df, df.repartition(5)))
    assert a == b
    assert mixing.mixed_documents(df).columns == df.columns


def test_mixed_rows_keep_their_columns(odd):
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shuffled_shards(odd).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and {len(s) for s in by.values()} <= {1, 2}
    assert sharding.shuffled_shards(none).count() == 0


def test_shards_are_equal_and_in_random_order(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS INT)) AS text")
    rows = sharding.shuffled_shards(df, sharding.Shuffle(bucket_bytes=20_000)).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sorted(order) == list(range(5000)) and abs(np.corrcoef(order, range(5000))[0, 1]) < 0.06
    again = sharding.shuffled_shards(df, sharding.Shuffle(bucket_bytes=20_000)).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == {r["doc_id"]: (r["shard"], r["slot"]) for r in again}


def test_query_of_shards_against_brute_force(spark, tmp_path):
    """All columns of ``op10_sharding``: its digests, the law, the slots."""
    rows = [(i, t) for i, t in enumerate(["", None, "é日本 x", "a" * 70_000, *["same"] * 300, *(f"text {i}" for i in range(900))])] + [(None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op10_sharding(spark, str(tmp_path)).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and {len(s) for s in slots.values()} <= {len(rows) // 8, len(rows) // 8 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_rows_spread_over_buckets(spark):
    """A third of the rows are one row in everything; its copies still stand all over the permutation."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, NULL, id) AS doc_id", "if(id % 3 = 0, 'again', concat('t', id)) AS text", "map('a', 1) AS m", "array(1, 2) AS key")
    plan = sharding.Shuffle(bucket_bytes=2_000)
    rows = sorted(sharding.shuffled_shards(df, plan).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(tuple(r) for r in df.select("doc_id", "text").collect())
    copies = [i for i, r in enumerate(rows) if r["doc_id"] is None]
    assert all(80 < sum(lo <= i < lo + 300 for i in copies) < 120 for lo in range(0, 3000, 300)) and rows[0]["m"] == {"a": 1}
    again = sharding.shuffled_shards(df, plan).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_columns_of_any_name_keep_their_values(spark):
    names = "mx_row mx_size mx_key mx_range mx_times mx_taken row bucket h0 h1 k n pos rows place start b to weight marks sh_bucket".split()
    df = spark.createDataFrame([(i, f"some words {i}", "abc"[i % 3], *(f"own {n}" for n in names)) for i in range(30)], ["doc_id", "text", "source", *names])
    for out in (sharding.shuffled_shards(df), mixing.mix_sources(df), mixing.mixed_documents(df)):
        kept = out.collect()
        assert set(df.columns) <= set(out.columns) and len(kept) >= 30 and all(r[n] == f"own {n}" for r in kept for n in names)


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_licences_against_brute_force(spark, odd, none):
    notice = licences.TEMPLATES["mit"][1]
    texts = [
        "Released under the MIT License.", "released, under the MIT licence", notice, notice.replace("any person", "some persons"), "prose\n\nAll rights reserved.\nmore\n\n" + "\n".join(notice.split(", ")),
        "Licensed under CC BY-SA 4.0", "_license_ of nothing", "", None, "All rights reserved. " * 50,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        parts = (t or "").replace("\r", "").split("\n\n") if t else []
        units = [("line", i, x) for i, x in enumerate((t or "").split("\n"))] + [("paragraph", i, x) for i, x in enumerate(parts) if "\n" in x] + ([("text", 0, t)] if len(parts) > 1 else [])
        for kind, i, x in units:
            best = min((-dice(set(licences._pairs(x)), set(p)), n) for n, p in licences.templates())
            if best[0] <= -0.8:
                want.add((d, kind, i, best[1], round(-best[0], 6)))
    assert {tuple(r) for r in licences.licence_matches(df).collect()} == want and len(want) >= 6
    assert licences.licence_matches(odd).count() == 0 and licences.licence_matches(none).count() == 0


def test_licences_of_own_templates(spark):
    """A text of several paragraphs among them; no pairs, no template."""
    own = {"house": ["Nur für den Dienstgebrauch.", "First the terms of the house.\n\nThen what they allow, to whom and when.\n\nNothing else."]}
    texts = ["nur FÜR den Dienstgebrauch", own["house"][1], own["house"][1].replace("Nothing", "Little"), "Released under the MIT License.", None]
    got = licences.licence_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts=own).collect()
    assert {(r["doc_id"], r["unit"], r["licence"]) for r in got} == {(0, "line", "house"), (1, "text", "house"), (2, "text", "house")}
    for bad in ({}, {"x": ["word"]}):
        with pytest.raises(ValueError):
            licences.licence_matches(spark.createDataFrame([], "doc_id long, text string"), texts=bad)
