import hashlib

from catalink.llm import fingerprint as fp


def brute(rows):
    """(doc_id, text) -> results, by the contract."""
    rows = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.canonical(t) == fp.canonical(e), fp.canonical(t) == fp.canonical(after)))
    return sorted(map(str, out))


def test_canonical_form():
    assert fp.canonical("  Ａ b\nß ") == b"a b ss" == fp.canonical("A B SS")
    assert fp.canonical(None) == fp.canonical("") == b""
    assert fp.canonical("é") == fp.canonical("é")


def test_against_brute_force(odd):
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"] == 1, r["near_next"] == 1) for r in fp.fingerprints(odd).collect()]
    assert sorted(map(str, got)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_equal_forms_share_a_fingerprint(odd):
    by = {}
    for r in fp.fingerprints(odd).collect():
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[2] == by[3] == by[7] and len(by[5]) == 2 and len(by[1]) == 1


def test_clashing_digests_are_told_apart_by_bytes(odd):
    weak = lambda data: fp.xxh128(data)[:1]
    forms = {}
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], set()).add(fp.canonical(r["text"]))
    for r in fp.fingerprints(odd, weak).collect():
        forms.setdefault(r["fingerprint"], set()).update(texts[r["doc_id"]] if len(texts[r["doc_id"]]) == 1 else ())
    assert all(len(f) <= 1 for f in forms.values())


def test_one_document_is_its_own_next(spark):
    r = fp.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


def test_empty(none):
    assert fp.fingerprints(none).count() == 0
