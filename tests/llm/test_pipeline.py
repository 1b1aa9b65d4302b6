import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalink.llm import language, mixing, nearcopies, packing, quality
from catalink.llm.shared import stored
from tests.llm.test_language_quality import greedy
from tests.llm.test_nearcopies import alike, roots
from tests.llm.test_packing_mixing_sharding import targets

SF = "/root/testdata/sf0.001"


def good(rows, spark):
    """Trees walked a row and a node at a time."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    known = [r for r in labels if r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    as_row = lambda t: np.array(quality.statistics(t), np.float32).astype(float)
    model = quality.fit(np.array([as_row(text[r["doc_id"]]) for r in known]), np.array([float(r["quality"]) for r in known]))

    def score(x):
        total = model.base
        for f, lim, leaf in zip(model.feature, model.limit, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[f[node]] > lim[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    return [r for r in rows if score(as_row(r["text"])) >= 0.3]


def known(rows, spark):
    """Texts parsed phrase by phrase."""
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    how = language.Parsing()
    texts = language.excerpts(docs, how)
    limit, model = language.limits(texts, 0.7, how), language.Languages(language.joined(texts), how)
    samples = [model.numbers(t) for _, t in language.joined(texts)]
    out = []
    for r in rows:
        n = model.numbers(r["text"] or "")
        phrases = [greedy(n, s) for s in samples]
        best = min(range(len(samples)), key=lambda i: phrases[i] * model.cost[i])
        if n.any() and phrases[best] <= max(limit[model.names[best]], 0) * len(n) + language.ROOM:
            out.append(r)
    return out


def each(rows, spark):
    """All pairs of five-word sets."""
    at = roots(len(rows), alike([r["text"] for r in rows]))
    wordless = {i for i, r in enumerate(rows) if not nearcopies.words_of(r["text"])}
    least = {}
    for i, r in enumerate(rows):
        k = -1 if i in wordless else at[i]
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] in set(least.values())]


def mix(rows, spark):
    """Rows of a source in order of their keys, taken word by word."""
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    out = []
    for source, target in targets({s: sum(size[r["doc_id"]] for r in own) for s, own in by.items()}).items():
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        own = sorted(by[source], key=lambda r: md5(f"mix:{r['doc_id']}") + md5(r["text"] or ""))
        whole, rest = divmod(int(target), max(1, sum(size[r["doc_id"]] for r in own)))
        for r in own:
            n = size[r["doc_id"]]
            taken = whole * n + max(0, min(n, rest))
            rest -= n
            out += [r] * (round(taken / n) if n else 1)
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.collect()
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (good, known, each, mix)):
        docs = stored(stage(spark, docs, SF), "test")
        before, left = len(left), plain(left, spark)
        assert docs.columns == columns and sorted(docs.collect()) == sorted(left), name
        assert name.startswith(("language", "mixing")) or len(left) < before, name
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in left}
    times, covered, sequences = Counter(r["doc_id"] for r in left), defaultdict(lambda: np.zeros(0, int)), defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        own = ids[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(own) == r["doc_tokens"]
        if not len(covered[r["doc_id"]]):
            covered[r["doc_id"]] = np.zeros(len(own), int)
        covered[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered.keys() == times.keys() and all((c == times[d]).all() for d, c in covered.items())
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [0, *ends[:-1]] == [o for o, _ in sorted(parts)] and ends[-1] <= 4096
    assert len(sequences) <= 1.05 * sum(len(ids[d]) * n for d, n in times.items()) / 4096 + 2


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_of_odd_rows(spark, request, which):
    """Nulls, ties, repeated rows, clashing names, and no row at all go through every stage."""
    docs = request.getfixturevalue(which)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        n = out.count()
        assert n == 0 if which == "none" else n > 0, name
        assert i == 4 or out.columns == docs.columns, name


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in corpus_pipeline.run(spark, SF).columns
