"""What the training-data operators have in common: scratch tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is missing on a local master (tests) a temporary
    folder is used; on a cluster a missing setting is an error, since executors
    do not share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="catalink-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/catalink-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def held(key, make):
    """What ``make`` gives for a key, kept in a worker between tasks until another key is asked for: one model or tokenizer at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in any case."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = f"{name}_"
        known.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: int | str, rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``rows`` rows, and of about ``size`` bytes in a column; a longer value stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right"))
        hi = min(lo + rows, max(lo + 1, full))
        yield batch.slice(lo, hi - lo)
        lo = hi
    pa.default_memory_pool().release_unused()  # else a worker holds what its largest batch took


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id="doc_id"):
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
