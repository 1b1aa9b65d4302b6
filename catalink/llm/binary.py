"""Token ids in files, coded by a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by all files. A file holds
blocks that decode independently; a block's symbols are dealt over lanes whose
states share one stream of words. Each block's entry in the directory is a
checkpoint (its place, its states, its first id) with checksums, so blocks can be
decoded in parallel, here in lockstep by numpy, or each by itself (``read_range``).

File: MAGIC, header, documents, directory, then blocks; integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalink.llm.shared import documents, scratch, slices, stored, width
from catalink.llm.tokenizing import CACHED, encoder, vocabulary

MAGIC = b"CLRANS01"
_HEADER = struct.Struct("<IIIQQI")  # table's crc32, lanes, ids a block, documents, ids, blocks
_BLOCK = struct.Struct("<QIIIQ")  # first id, ids, crc32 of ids, crc32 of stored bytes, words


@dataclass(frozen=True)
class Coding:
    tokenizer: str = "byte_bpe_50k.json"
    end: int = 0
    bits: int = 18  #: frequencies sum to 2**bits
    lanes: int = 128
    block: int = 1 << 16  #: ids
    together: int = 32  #: blocks that are coded in lockstep
    file_blocks: int = 256
    cached: int = CACHED  #: entries of each of the tokenizer's caches


class Table:
    """Frequencies of the ids, scaled to sum to 2**bits; each id seen keeps one at least."""

    def __init__(self, counts: np.ndarray, bits: int):
        total, size = int(counts.sum()), 1 << bits
        self.bits = bits
        freq = np.zeros(len(counts), np.int64)
        if total:
            seen = counts > 0
            freq[seen] = np.maximum(1, np.floor(counts[seen] * (size / total)).astype(np.int64))
            order = np.argsort(-freq, kind="stable")
            freq[order[0]] += max(0, size - int(freq.sum()))
            for i in order:  # rare ids were raised: the most frequent ones give it back
                over = int(freq.sum()) - size
                if over <= 0:
                    break
                freq[i] -= min(over, int(freq[i]) // 2)
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.dtype = np.dtype("<u2" if len(freq) <= 1 << 16 else "<u4")
        self.symbol = np.repeat(np.arange(len(freq), dtype=self.dtype), freq)
        self.common = int(np.argmax(freq))
        self.crc = zlib.crc32(freq.astype("<u4"))


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """``ids`` (blocks, steps, lanes) -> (states, words) of each block.

    Lanes run backwards through their symbols; words come out in the order in which decoding takes them.
    """
    blocks, steps, lanes = ids.shape
    x = np.full((blocks, lanes), 1 << 31, np.uint64)
    bits, low = np.uint64(table.bits), np.uint64(0xFFFFFFFF)
    room, half = np.uint64(63 - table.bits), np.uint64(32)
    out = np.zeros((steps, blocks, lanes), np.uint32)
    gave = np.zeros((steps, blocks, lanes), bool)
    for t in range(steps - 1, -1, -1):
        s = ids[:, t]
        f = table.freq[s]
        full = x >= f << room
        out[t], gave[t] = x & low, full
        x = np.where(full, x >> half, x)
        q = x // f
        x = (q << bits) + (x - q * f) + table.first[s]
    return [(x[b].copy(), out[:, b][gave[:, b]]) for b in range(blocks)]


def decode_blocks(states: np.ndarray, words: list[np.ndarray], steps: int, table: Table) -> np.ndarray:
    """The inverse of ``encode_blocks``."""
    x = states.astype(np.uint64)
    blocks, lanes = x.shape
    stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
    bits, mask, floor, half = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(1 << 31), np.uint64(32)
    out = np.empty((blocks, steps, lanes), table.dtype)
    for t in range(steps):
        slot = x & mask
        s = table.symbol[slot]
        out[:, t] = s
        x = table.freq[s] * (x >> bits) + slot - table.first[s]
        low = x < floor
        took = np.cumsum(low, axis=1)
        place = np.where(low, at[:, None] + took - 1, len(stream) - 1)
        x = np.where(low, (x << half) | stream[place], x)
        at += took[:, -1]
    if (x != floor).any():
        raise ValueError("a block's states do not end as they began")
    return out


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table, how: Coding) -> bytes:
    """One file of the documents' ids, which stand one after the other in ``ids``."""
    n, size, lanes = len(ids), how.block, how.lanes
    full = n // size
    coded: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, full, how.together):
        hi = min(full, lo + how.together)
        coded += encode_blocks(ids[lo * size : hi * size].reshape(hi - lo, -1, lanes), table)
    if n % size:
        rest = ids[full * size :]
        padded = np.full(-(-len(rest) // lanes) * lanes, table.common, table.dtype)
        padded[: len(rest)] = rest
        coded += encode_blocks(padded.reshape(1, -1, lanes), table)
    directory, bodies = [], []
    for b, (states, words) in enumerate(coded):
        own = ids[b * size : (b + 1) * size]
        body = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        directory.append(_BLOCK.pack(b * size, len(own), zlib.crc32(own.astype("<u4")), zlib.crc32(body), len(words)))
        bodies.append(body)
    known = np.array([d is not None for d in doc_ids], bool)
    docs = zlib.compress(b"".join((np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes())), 6)
    head = _HEADER.pack(table.crc, lanes, size, len(doc_ids), n, len(coded)) + struct.pack("<Q", len(docs))
    head = MAGIC + head + docs + b"".join(directory)
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(bodies)


@dataclass
class _Head:
    lanes: int
    size: int  #: ids of a block
    ids: int
    entries: list[tuple]  #: of the directory
    documents: bytes  #: compressed
    count: int  #: of documents
    body: int  #: where the first block begins


def _head(read: Callable[[int, int], bytes], table: Table) -> _Head:
    """What a file says of itself; ``read`` gives the bytes at a place."""
    fixed = 8 + _HEADER.size + 8
    start = read(0, fixed)
    if len(start) < fixed or start[:8] != MAGIC:
        raise ValueError("not a file of this format")
    crc, lanes, size, n_docs, n, blocks = _HEADER.unpack_from(start, 8)
    (packed,) = struct.unpack_from("<Q", start, 8 + _HEADER.size)
    rest = read(fixed, packed + blocks * _BLOCK.size + 4)
    if zlib.crc32(rest[:-4], zlib.crc32(start)) != int.from_bytes(rest[-4:], "little"):
        raise ValueError("the header is damaged")
    if crc != table.crc:
        raise ValueError("written with another frequency table")
    entries = [_BLOCK.unpack_from(rest, packed + b * _BLOCK.size) for b in range(blocks)]
    return _Head(lanes, size, n, entries, rest[:packed], n_docs, fixed + len(rest))


def _decoded(entries: list[tuple], data: bytes, lanes: int, table: Table, how: Coding) -> np.ndarray:
    """The ids of blocks that follow each other, whose bytes are ``data``; every checksum is verified."""
    out, bodies, place = np.empty(sum(e[1] for e in entries), table.dtype), [], 0
    for _, _, _, stored_crc, words in entries:
        body = data[place : place + 8 * lanes + 4 * words]
        if zlib.crc32(body) != stored_crc:
            raise ValueError("a block is damaged")
        bodies.append(body)
        place += len(body)
    lo = at = 0
    while lo < len(entries):
        hi = lo + 1
        while hi < len(entries) and hi - lo < how.together and entries[hi][1] == entries[lo][1]:
            hi += 1
        states = np.stack([np.frombuffer(b, "<u8", lanes) for b in bodies[lo:hi]])
        words = [np.frombuffer(b, "<u4", offset=8 * lanes) for b in bodies[lo:hi]]
        got = decode_blocks(states, words, -(-entries[lo][1] // lanes), table).reshape(hi - lo, -1)
        for (_, count, ids_crc, _, _), row in zip(entries[lo:hi], got):
            out[at : at + count] = row[:count]
            if zlib.crc32(row[:count].astype("<u4")) != ids_crc:
                raise ValueError("a block's ids are damaged")
            at += count
        lo = hi
    return out


def read_file(data: bytes, table: Table, how: Coding) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids); every checksum is verified."""
    head = _head(lambda at, n: data[at : at + n], table)
    plain, flags = zlib.decompress(head.documents), -(-head.count // 8)
    known = np.unpackbits(np.frombuffer(plain, np.uint8, flags), count=head.count).astype(bool)
    ids_of = np.frombuffer(plain, "<i8", head.count, flags).tolist()
    lengths = np.frombuffer(plain, "<u8", head.count, flags + 8 * head.count).astype(np.int64)
    ids = _decoded(head.entries, data[head.body :], head.lanes, table, how)
    return [d if k else None for d, k in zip(ids_of, known)], lengths, ids


def read_range(read: Callable[[int, int], bytes], start: int, n: int, table: Table, how: Coding = Coding()) -> np.ndarray:
    """``n`` ids of a file from its id ``start`` on, fewer at its end; only the blocks that hold them are read and decoded."""
    head = _head(read, table)
    start, stop = max(0, start), min(head.ids, start + n)
    if start >= stop:
        return np.empty(0, table.dtype)
    first, last = start // head.size, -(-stop // head.size)
    sizes = [8 * head.lanes + 4 * e[4] for e in head.entries[:last]]
    data = read(head.body + sum(sizes[:first]), sum(sizes[first:]))
    got = _decoded(head.entries[first:last], data, head.lanes, table, how)
    return got[start - first * head.size : stop - first * head.size]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def tokenized(docs: DataFrame, how: Coding = Coding()) -> DataFrame:
    """``doc_id, ids, counts``: each document's ids and the end id, compressed; and a row a task of how often it gave each id."""
    path = vocabulary(how.tokenizer)

    def run(batches):
        import zstandard

        enc, pack = encoder(path, True, how.cached), zstandard.ZstdCompressor(level=3)
        counts = np.zeros(max(enc.size, how.end + 1), np.int64)
        for batch in batches:
            for part in slices(batch, 1, 3000, 4 << 20):
                ids, ends = enc.encode_all(part.column(1), how.end)
                counts += np.bincount(ids, minlength=len(counts))
                packed = [pack.compress(ids[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())], ["doc_id", "ids", "counts"])
        told = pack.compress(counts.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([told], pa.binary())], ["doc_id", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, counts binary")


def _unpacked(column, kind: str):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return (np.frombuffer(unpack.decompress(x.as_py()), kind) for x in column)


def frequencies(tokens: DataFrame, bits: int, size: int) -> Table:
    """Counts over all ids, of the tasks' rows of ``tokenized``; at most one row for each id reaches the driver."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for c in _unpacked(batch.column(0), "<i8"):
                counts += c
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table(counts, bits)


_FILE = "uri string, part long, number long, documents long, tokens long"


def write_ids(docs: DataFrame, how: Coding = Coding(), path: str | None = None) -> tuple[DataFrame, Table]:
    """Write files in ascending doc_id order; returns their list (uri, part, number, documents, tokens) and the table.

    A task writes files of names that only this attempt uses, and the list, a table that Spark commits, names those of the
    attempts that ended well: a task that runs again leaves no wrong file in the list.
    Null ids come first, equal ids in order of their ids' bytes; null and empty texts are the end id alone, long ones are
    whole. Other columns are ignored; an empty table gives no file.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "ids")
    enc = encoder(vocabulary(how.tokenizer), True, how.cached)
    kind, size = enc.dtype.str, max(enc.size, how.end + 1)
    tokens = stored(tokenized(docs, how), "tokens")
    table = frequencies(tokens, how.bits, size)
    shared = spark.sparkContext.broadcast(table)  # the vocabulary's ids and 2**bits slots

    def run(batches):
        task = TaskContext.get()
        part, number = task.partitionId(), 0
        limit = how.block * how.file_blocks
        names: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal names, arrays, held, number
            uri = f"{path}/part-{part:06d}-{task.taskAttemptId():08d}-{number:04d}.rans"
            data = write_file(names, [len(a) for a in arrays], np.concatenate(arrays), shared.value, how)
            files, at = _open(uri)
            files.create_dir(at.rpartition("/")[0], recursive=True)
            with files.open_output_stream(at) as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist([{"uri": uri, "part": part, "number": number, "documents": len(names), "tokens": held}])
            names, arrays, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for doc_id, a in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1), kind)):
                names.append(doc_id)
                arrays.append(a)
                held += len(a)
                if held >= limit:
                    yield flush()
        if names:
            yield flush()

    ids = tokens.where("ids IS NOT NULL").select("doc_id", "ids")
    rows = ids.repartitionByRange(width(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(run, _FILE)
    return stored(rows, "files"), table


def read_ids(files: DataFrame, table: Table, how: Coding = Coding(), digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, decoded from the files. ``ids``: binary, 32 bits each;
    with ``digest`` their crc32 instead, ``ids_crc32``."""
    spark = files.sparkSession
    # ids before each file: of earlier partitions of the writing job, a row each, and of its own partition's files
    parts = files.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before_part"))
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.join(parts, "part").select("uri", (F.col("before_part") + F.coalesce(F.sum("tokens").over(own), F.lit(0))).alias("base"))
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = _open(uri)
                with fs.open_input_stream(at) as f:
                    names, lengths, ids = read_file(f.read(), shared.value, how)
                ends = np.cumsum(lengths)
                wide = memoryview(ids.astype("<u4")).cast("B")
                last = "ids_crc32" if digest else "ids"
                for lo in range(0, len(names), 500):
                    hi = min(len(names), lo + 500)
                    own = [wide[4 * (e - n) : 4 * e] for e, n in zip(ends[lo:hi].tolist(), lengths[lo:hi].tolist())]
                    own = pa.array(map(zlib.crc32, own), pa.int64()) if digest else pa.array(map(bytes, own), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[lo:hi], pa.int64()), pa.array(first + ends[lo:hi] - lengths[lo:hi]), pa.array(lengths[lo:hi]), own], ["doc_id", "start", "n_tokens", last])

    spread = listed.repartition(max(1, min(files.count(), 4 * width(spark))))
    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def op6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, table = write_ids(documents(spark, sf_dir))
    return read_ids(files, table, digest=True)
