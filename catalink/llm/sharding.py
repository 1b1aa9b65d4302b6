"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one counts: bytes and rows, then rows by bucket, where a seeded hash of the whole row deals
the rows uniformly into buckets sized by an executor's memory. Pass two moves each row once,
to its bucket, permutes the bucket by Fisher-Yates (Spark's ``shuffle`` of an
array) and writes it. Running counts of the buckets turn places within a bucket
into places in the whole permutation, which is cut into shards of equal counts.
Rows that are equal in everything would meet in one bucket: many of them collapse to one row
and a number before they move, and are dealt out again by that number.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.llm.shared import documents, scratch, stored, width

#: Rows of a few numbers, up to which a counted table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Shuffle:
    shards: int = 8
    seed: int = 20
    bucket_bytes: int | None = None  #: of rows, about, that one bucket holds in memory; by ``memory_share`` if none
    memory_share: float = 1 / 16  #: of what an executor's heap has for each task
    copies: int = 64  #: rows equal in everything beyond which they are dealt out by number


def _size():
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def bucket_bytes(spark: SparkSession, how: Shuffle) -> int:
    """What a bucket may hold: a share of an executor's heap for each of its cores, 32 MB to 1 GB."""
    if how.bucket_bytes:
        return how.bucket_bytes
    conf, local = spark.sparkContext.getConf(), spark.sparkContext.master.startswith("local[")
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower()).groups()
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "4"))
    heap = int(number) << {"": 20, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    return min(1 << 30, max(32 << 20, int(heap * how.memory_share / cores)))


def _weight(schema: T.StructType) -> str:
    """Bytes of a row, about: those of strings and binaries, of nested values as JSON, and 8 of any other."""
    name = lambda f: f"`{f.name.replace('`', '``')}`"
    flat = (T.StringType, T.BinaryType)
    nested = (T.ArrayType, T.MapType, T.StructType)
    sizes = [f"octet_length({name(f)})" if isinstance(f.dataType, flat) else f"octet_length(to_json(struct({name(f)})))" for f in schema if isinstance(f.dataType, (*flat, *nested))]
    return " + ".join([f"cast({8 * (1 + len(schema) - len(sizes))} as bigint)", *(f"coalesce({x}, 0)" for x in sizes)])


def shuffled_shards(docs: DataFrame, how: Shuffle = Shuffle(), path: str | None = None) -> DataFrame:
    """Write ``docs`` as Parquet in random order, partitioned by shard, and read it back.

    ``docs`` needs doc_id and text; other columns are carried, whatever their names, and columns named
    shard, slot or size are replaced. Law: counts of the shards differ by one at most,
    slots are gapless from 0. The bucket depends on the seed and the whole row (but for columns of maps), so copies
    of a text spread; more than ``copies`` rows that are equal in everything spread by their number. Null text has size 1, long
    texts count for what they are; an empty table gives empty shards. The permutation depends on the seed, on the size
    of buckets and on the number of shuffle partitions.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot", "size")]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name in kept and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    two = [F.xxhash64(F.lit(how.seed + i), *hashed).alias(f"h{i}") for i in range(2)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept), _size().alias("size")).alias("row"), *two)
    marks = stored(docs.select(*two, F.expr(_weight(docs.schema)).alias("weight")), "marks")
    count, total = marks.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    buckets = max(width(spark), math.ceil(total / bucket_bytes(spark, how)))
    crowds = stored(marks.groupBy("h0", "h1").agg(F.count("*").alias("n")).where(F.col("n") > how.copies), "crowds")
    dealt_out = F.pmod(F.xxhash64(F.lit(how.seed), "h0", "h1", "k"), F.lit(buckets)).cast("int").alias("bucket")
    alone = F.pmod("h0", F.lit(buckets)).cast("int").alias("bucket")
    numbered = lambda df: df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    crowded = crowds.count()
    some = F.broadcast(crowds) if crowded <= BROADCAST_ROWS else crowds
    if crowded:
        lone, lone_marks = rows.join(some, ["h0", "h1"], "left_anti"), marks.join(some, ["h0", "h1"], "left_anti")
        one = rows.join(some, ["h0", "h1"]).groupBy("h0", "h1").agg(F.first("row").alias("row"), F.first("n").alias("n"))  # combined map-side
        placed = lone.select("row", "h0", "h1", F.lit(0).cast("long").alias("k"), alone).union(numbered(one).select("row", "h0", "h1", "k", dealt_out))
        counted = lone_marks.select(alone).union(numbered(crowds).select(dealt_out))
    else:
        placed, counted = rows.select("row", "h0", "h1", F.lit(0).cast("long").alias("k"), alone), marks.select(alone)
    in_order = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row a bucket: 12 bytes for each 32 MB of rows, or more
    starts = counted.groupBy("bucket").agg(F.count("*").alias("n")).select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if buckets <= BROADCAST_ROWS else starts
    # each bucket is a partition; sorted, so that a task that runs again permutes the same list
    dealt = (
        placed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "h0", "h1", "k")
        .groupBy("bucket").agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", F.lit(how.seed))).alias("pos", "row"))
    )
    place = F.col("start") + F.col("pos")
    shard = F.expr(f"(({how.shards}L * (place + 1) - 1) div {max(1, count)}L)").cast("int")
    slot = F.col("place") - F.floor(F.col("to").cast("long") * F.lit(count) / how.shards).cast("long")
    out = dealt.join(starts, F.col("bucket") == F.col("b")).select("row", place.alias("place")).select("row", "place", shard.alias("to"))
    out = out.select(*(F.col(f"row.`{c}`") for c in [*kept, "size"]), slot.alias("slot"), F.col("to").alias("shard"))
    path = path or scratch(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Digest columns of the shards as written and read back."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return shuffled_shards(documents(spark, sf_dir)).select(
        "doc_id", _size().alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
