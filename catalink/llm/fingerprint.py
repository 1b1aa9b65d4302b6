"""Canonical exact digests of documents.

A text's canonical form is NFKC, case-folded, NFKC again, with white space folded to
single spaces; its digest is 128 bits of xxh3. Digests that occur once are settled.
Texts of the others are compared byte by byte: equal bytes collapse map-side before
the shuffle, so a group of copies sends one row a task, and if different canonical
texts ever share a digest, all but the first get a suffix.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalink.llm.shared import documents, stored, width

#: Rows of a few numbers, up to which a counted table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def canonical(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode()


def xxh128(data: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(data)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def edited(text: str, after: str) -> str:
    """The last third of ``text``, rounded down, replaced by as many code points from the start of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


_DIGEST = "doc_id long, raw string, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, next_id long, next_raw string, next_fingerprint string"


def _row(doc_id, text: str, next_id, after: str, hasher) -> tuple:
    changed = edited(text, after)
    return (
        doc_id, xxh128(text.encode()), len(text), hasher(canonical(text)), hashlib.sha256(changed.encode()).hexdigest(), hasher(canonical(changed)),
        next_id, xxh128(after.encode()), hasher(canonical(after)),
    )


def edited_digests(docs: DataFrame, hasher: Callable[[bytes], str] = xxh128) -> DataFrame:
    """Digests of each text and of its edited text, made with the next document in descending doc_id order.

    Texts move once, to ranges of doc_id. A range's last row still lacks its next document, the
    first row of the next range that has rows, and its first row is sent along with it: two
    rows a partition, matched afterwards. Equal ids stand in order of text; null ids come last.
    """
    spark = docs.sparkSession
    names = [x.split()[0] for x in _DIGEST.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        part, previous, first = TaskContext.get().partitionId(), None, None
        schema = pa.schema([(n, pa.int64() if n in ("doc_id", "n_chars", "next_id") else pa.string()) for n in names] + [("part", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                out, piece = [], batch.slice(lo, 1000)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1)):
                    text = text.as_py() or ""
                    if previous is None:
                        first = (doc_id, text)
                    else:
                        out.append((*_row(*previous, doc_id, text, hasher), part, None, None))
                    previous = (doc_id, text)
                if out:
                    yield batch_of(out)
        if previous is not None:
            none = (None,) * (len(names) - 1)
            yield batch_of([(first[0], *none, part, "first", first[1]), (previous[0], *none, part, "last", previous[1])])

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(width(spark), order[0]).sortWithinPartitions(*order)
    found = stored(rows.mapInArrow(run, f"{_DIGEST}, part long, role string, text string"), "digests")
    done = found.where("role is null").select(*names)
    ends = found.where("role is not null").select("part", "role", "doc_id", "text")
    # one row a partition of the shuffle
    parts = ends.where("role = 'first'").select("part")
    following = parts.select("part", F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("then")).withColumn("then", F.coalesce("then", F.min("part").over(Window.partitionBy(F.lit(0)))))
    last, head = ends.where("role = 'last'"), ends.where("role = 'first'").select(F.col("part").alias("then"), F.col("doc_id").alias("next_id"), F.col("text").alias("after"))
    pairs = last.join(following, "part").join(head, "then").select("doc_id", "text", "next_id", "after")

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                row = _row(r["doc_id"], r["text"], r["next_id"], r["after"], hasher)
                yield pa.RecordBatch.from_pylist([dict(zip(names, row))], pa.schema([(n, pa.int64() if n in ("doc_id", "n_chars", "next_id") else pa.string()) for n in names]))

    return stored(done.union(pairs.mapInArrow(finish, _DIGEST)), "digests")


def collisions(texts: DataFrame, hasher: Callable[[bytes], str] = xxh128) -> DataFrame:
    """``texts`` (text) -> ``fingerprint, form, ordinal`` of canonical texts that share a fingerprint with another one.

    ``form`` is the compressed canonical text; ordinals go from 0 in byte order of the forms. Each is made
    once a task and grouped by its bytes; only groups of a fingerprint with several remain.
    """
    each = canonical_forms(texts, [], hasher).groupBy("fingerprint", "form").agg(F.count("*").alias("n"))
    each = stored(each.drop("n"), "forms")
    several = each.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    ordinal = F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")) - 1
    return each.join(_few(several), "fingerprint").withColumn("ordinal", ordinal)


def canonical_forms(texts: DataFrame, keep: list[str], hasher: Callable[[bytes], str] = xxh128) -> DataFrame:
    """``keep`` columns, ``fingerprint`` and ``form`` (compressed canonical text) of each row's text."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.names.index("text")
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                forms = [canonical(t.as_py()) for t in piece.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(i) for i in range(len(keep))), pa.array(map(hasher, forms), pa.string()), pa.array(map(pack.compress, forms), pa.binary())],
                    [*keep, "fingerprint", "form"],
                )

    of = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    return texts.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{k} {of[k]}" for k in keep), "fingerprint string", "form binary"]))


def verified(digests: DataFrame, docs: DataFrame, hasher: Callable[[bytes], str] = xxh128) -> DataFrame:
    """``digests`` of ``edited_digests`` with both fingerprints settled by byte comparison.

    Only texts whose digest occurs more than once are read again: documents by their id, edited texts by the two ids
    they are made from.
    """
    kinds = ("fingerprint", "edited_fingerprint")
    every = digests.select(F.col(kinds[0]).alias("h")).union(digests.select(F.col(kinds[1]).alias("h")))
    shared = stored(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    shared = _few(shared)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = digests.join(shared, digests[kinds[0]] == F.col("h"), "left_semi").select("doc_id").distinct()
    made = stored(digests.join(shared, digests[kinds[1]] == F.col("h"), "left_semi").select("doc_id", "raw", "next_id", "next_raw").distinct(), "edited")

    def reread() -> DataFrame:
        ids = made.select("doc_id").union(made.select(F.col("next_id").alias("doc_id"))).distinct()
        part = stored(_with_raw(_matching(texts, _few(ids))).dropDuplicates(["doc_id", "raw"]), "reread")
        after = part.select(F.col("doc_id").alias("n_id"), F.col("raw").alias("n_raw"), F.col("text").alias("after"))
        joined = made.join(part.withColumnRenamed("doc_id", "d_id").withColumnRenamed("raw", "d_raw"), F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("raw") == F.col("d_raw")))
        joined = joined.join(after, F.col("next_id").eqNullSafe(F.col("n_id")) & (F.col("next_raw") == F.col("n_raw")))
        cut = F.floor(F.char_length("text") / 3).cast("int")
        changed = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("substring(after, 1, cast(floor(char_length(text) / 3) as int))"))
        return joined.select("doc_id", "raw", "next_id", "next_raw", F.when(cut > 0, changed).otherwise(F.col("text")).alias("text"))

    again = _matching(texts, _few(own))
    remade = reread()
    clashes = collisions(again.select("text").union(remade.select("text")), hasher)
    # of the texts read again, digests may also be unshared ones; those have one form each
    clashes = stored(clashes.where("ordinal > 0"), "clashes")
    if clashes.isEmpty():
        return digests
    clashes = clashes.select(F.col("fingerprint"), F.col("form"), "ordinal")
    mine = canonical_forms(_with_raw(again), ["doc_id", "raw"], hasher).join(clashes, ["fingerprint", "form"]).select(F.col("doc_id").alias("a"), F.col("raw").alias("b"), F.col("ordinal").alias("own_ordinal")).distinct()
    theirs = canonical_forms(remade, ["doc_id", "raw", "next_id", "next_raw"], hasher).join(clashes, ["fingerprint", "form"]).select(*[F.col(c).alias(f"e_{c}") for c in ("doc_id", "raw", "next_id", "next_raw")], F.col("ordinal").alias("edited_ordinal")).distinct()
    nexts = mine.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("own_ordinal").alias("next_ordinal"))
    same = lambda *p: reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in p])
    out = (
        digests.join(mine, same(("doc_id", "a"), ("raw", "b")), "left").join(nexts, same(("next_id", "c"), ("next_raw", "d")), "left")
        .join(theirs, same(*((c, f"e_{c}") for c in ("doc_id", "raw", "next_id", "next_raw"))), "left")
    )
    suffix = lambda h, n: F.concat(F.col(h), F.when(F.col(n).isNotNull(), F.concat(F.lit("-"), F.col(n).cast("string"))).otherwise(F.lit("")))
    return out.withColumns({
        "fingerprint": suffix("fingerprint", "own_ordinal"), "edited_fingerprint": suffix("edited_fingerprint", "edited_ordinal"),
        "next_fingerprint": suffix("next_fingerprint", "next_ordinal"),
    }).select(*digests.columns)


def _matching(texts: DataFrame, ids: DataFrame) -> DataFrame:
    ids = ids.withColumnRenamed("doc_id", "wanted")
    return texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")


def _with_raw(texts: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``raw``, the digest of the text as it is."""

    def run(batches):
        for batch in batches:
            raw = [xxh128((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.string())], ["doc_id", "text", "raw"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, raw string")


def fingerprints(docs: DataFrame, hasher: Callable[[bytes], str] = xxh128) -> DataFrame:
    """Every document's fingerprint beside that of its edited text, and their likenesses.

    ``docs`` needs doc_id and text; other columns are ignored. Likeness of exact digests is 1
    if they are equal, else 0. Null text is empty; a document alone is its own next one;
    rows equal in id and text have equal results up to their next document; an empty table gives no row.
    """
    rows = verified(edited_digests(docs, hasher), docs, hasher)
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """``fingerprint, first_id, n``: the groups of documents that are equal up to form, case and white space."""
    return fingerprints(docs).groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
