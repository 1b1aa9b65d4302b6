"""Media columns: AVI files of motion JPEG, in a binary column.

Frames are intra-coded by the lossless JPEG process (8 bits, one component, each
sample predicted from its left neighbour, the first of a row from above), so bytes go in as samples
and come out unchanged. A file has the usual headers, its frames as chunks of the ``movi``
list, and an ``idx1`` index, which reading follows. All frames of a batch of files are coded,
and decoded, in lockstep by numpy. Frames of the baseline process, which other writers use, are decoded one by one to
their first component, the brightness. A file that can't be decoded gives a row that says why. Shots begin where the histogram differs
from the last frame's by more than its recent differences let expect.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.llm.shared import documents, slices

SIDE = 24  #: of the frames that are written
SAMPLES = SIDE * SIDE
FRAMES_A_SECOND = 25
#: Lengths of the codes for differences of 0 to 8 bits.
CODE_LENGTHS = (4, 4, 3, 3, 3, 4, 4, 3, 4)
#: Frames that are coded or decoded in lockstep.
TOGETHER = 8192


@dataclass(frozen=True)
class Shots:
    bins: int = 16
    window: int = 8  #: differences before, whose mean and deviation set the threshold
    deviations: float = 3.0
    least: float = 0.08  #: share of the samples that must change bin


def _codes(lengths) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT payload, and (code, length) by category, of canonical codes."""
    by_length = sorted(range(len(lengths)), key=lambda c: (lengths[c], c))
    code, last, out = 0, lengths[by_length[0]], {}
    for c in by_length:
        code <<= lengths[c] - last
        last = lengths[c]
        out[c] = (code, last)
        code += 1
    counts = bytes(sum(n == k for n in lengths) for k in range(1, 17))
    return b"\x00" + counts + bytes(by_length), out


def _segment(marker: int, payload: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(payload) + 2) + payload


_DHT, _CODE = _codes(CODE_LENGTHS)
_HEAD = (
    b"\xff\xd8" + _segment(0xC4, _DHT) + _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)
_END = b"\xff\xd9"


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each difference from -255 to 255, at difference + 255."""
    code, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        bits = abs(d).bit_length()
        head, n = _CODE[bits]
        code[d + 255] = head << bits | (d if d >= 0 else d + (1 << bits) - 1)
        length[d + 255] = n + bits
    return code, length


_VALUE, _LENGTH = _difference_codes()


def jpeg_frames(samples: np.ndarray) -> list[bytes]:
    """``samples`` (frames, SIDE, SIDE) of uint8 -> lossless JPEG images."""
    n = len(samples)
    s = samples.astype(np.int16)
    d = np.empty_like(s)
    d[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    d[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    d[:, 0, 0] = s[:, 0, 0] - 128
    at = d.reshape(n, -1) + 255
    length = _LENGTH[at]
    ends = length.cumsum(1)
    bits = ends[:, -1]
    words = -(-bits // 32) + 1
    first = np.cumsum(words) - words  # each frame begins at a word of its own
    pos = first[:, None] * 32 + ends - length
    value = _VALUE[at] << (64 - (pos & 31) - length).astype(np.uint64)
    word = (pos >> 5).ravel()
    total = int(words.sum()) + 1
    # no two codes share a bit, so sums are unions; they stay exact below 2**53
    packed = np.bincount(word, (value >> np.uint64(32)).ravel().astype(np.float64), total)
    packed += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).ravel().astype(np.float64), total)
    data = np.frombuffer(packed.astype(np.uint64).astype(">u4").tobytes(), np.uint8).copy()
    size = -(-bits // 8)
    data[first * 4 + size - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)  # filled up with ones
    data = data.tobytes()
    return [_HEAD + data[a : a + k].replace(b"\xff", b"\xff\x00") + _END for a, k in zip((first * 4).tolist(), size.tolist())]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of the images. Its sizes have 32 bits: a file ends at 4 GB."""
    n, largest = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, largest * FRAMES_A_SECOND, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body = [_chunk(b"00dc", f) for f in frames]
    sizes = np.array([len(b) for b in body], np.int64)
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2], index[:, 3] = 4 + np.cumsum(sizes) - sizes, [len(f) for f in frames]
    rest = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", rest)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """(images that the index calls intra frames, frames a second)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = float(FRAMES_A_SECOND), None, b""
    end = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])

    def walk(at: int, end: int) -> None:
        nonlocal rate, movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    walk(at + 12, at + 8 + size)
            elif name == b"avih":
                rate = 1_000_000 / max(1, struct.unpack_from("<I", data, at + 8)[0])
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)

    walk(12, end)
    if movi is None or len(index) % 16:
        raise ValueError("the file has no frames or no index")
    frames = []
    for name, flags, offset, size in struct.iter_unpack("<4sIII", index):
        at = movi + offset
        if name[2:] in (b"dc", b"db") and flags & 0x10:
            if data[at : at + 4] != name or at + 8 + size > len(data):
                raise ValueError("the index leads nowhere")
            frames.append(data[at + 8 : at + 8 + size])
    return frames, rate


def _parse(frame: bytes) -> tuple[int, int, int, tuple[np.ndarray, np.ndarray]]:
    """(length of the headers, height, width, tables by 16 bits of code: length and difference)."""
    at, counts, symbols, shape = 2, b"", b"", None
    while True:
        mark, marker, size = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + size]
        if mark != 0xFF:
            raise ValueError("damaged headers")
        if marker == 0xC4:
            counts, symbols = body[1:17], body[17:]
        elif marker == 0xC3:
            bits, height, width, components = struct.unpack_from(">BHHB", body)
            if bits != 8 or components != 1:
                raise ValueError("frames must have one component of 8 bits")
            shape = height, width
        elif marker == 0xDA:
            if body[3] != 1 or body[5]:
                raise ValueError("frames must be predicted from the left")
            break
        elif 0xC0 <= marker <= 0xCF or marker == 0xDD:
            raise ValueError(f"frames of the JPEG process {marker:#x} are not read")
        at += 2 + size
    if shape is None or not counts:
        raise ValueError("headers are missing")
    length, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int16)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            bits = symbols[k]
            if n + bits > 16:
                raise ValueError("codes and their bits may take 16 bits together")
            for extra in range(1 << bits):
                low = (code << bits | extra) << (16 - n - bits)
                high = low + (1 << (16 - n - bits))
                length[low:high] = n + bits
                value[low:high] = extra if not bits or extra >> (bits - 1) else extra - (1 << bits) + 1
            code += 1
            k += 1
        code <<= 1
    return at + 2 + size, *shape, (length, value)


def _zigzag(side: int = 8) -> np.ndarray:
    """Where each coefficient of a block stands, in the order in which they are coded: diagonals, up and down in turn."""
    cells = [(r, c) for r in range(side) for c in range(side)]
    cells.sort(key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * side + c for r, c in cells])


_ORDER = _zigzag()
_COSINE = np.array([[(0.5 if k else 0.5**1.5) * math.cos((2 * x + 1) * k * math.pi / 16) for x in range(8)] for k in range(8)])


class _Bits:
    """Bits of a scan, without stuffing."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff") + b"\0\0\0\0"
        self.words = [int.from_bytes(data[i : i + 8].ljust(8, b"\0"), "big") for i in range(0, len(data), 4)]
        self.at, self.end = 0, 8 * len(data)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("a frame ends too early")
        word = self.words[self.at >> 5]
        self.at += n
        return word >> (64 - n - ((self.at - n) & 31)) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((n, code))) is not None:
                return found
        raise ValueError("a code that no table has")

    def number(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def baseline(frame: bytes) -> np.ndarray:
    """Samples (height, width) of the first component of a baseline (or extended, 8 bits) image: Huffman codes, dequantisation, inverse DCT."""
    at, steps, codes, every, parts, shape = 2, {}, {}, 0, [], None
    while True:
        mark, marker, size = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + size]
        if mark != 0xFF:
            raise ValueError("damaged headers")
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                steps[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                code, k, table = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(counts[length - 1]):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                codes[body[0] >> 4, body[0] & 15] = table
                body = body[17 + n :]
        elif marker == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            bits, height, width, many = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples must have 8 bits")
            shape = height, width
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(many)]
        elif marker == 0xDA:
            scans = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            at += 2 + size
            break
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError(f"frames of the JPEG process {marker:#x} are not read")
        at += 2 + size
    if shape is None or not all(p["id"] in scans for p in parts):
        raise ValueError("headers are missing")
    tall, broad = max(p["v"] for p in parts), max(p["h"] for p in parts)
    if len(parts) == 1:  # blocks of a lone component aren't interleaved
        parts[0]["h"] = parts[0]["v"] = tall = broad = 1
    rows, columns = -(-shape[0] // (8 * tall)), -(-shape[1] // (8 * broad))
    first = parts[0]
    blocks = np.zeros((rows * first["v"], columns * first["h"], 64))
    end = frame.rindex(_END)
    scan = re.split(rb"\xff[\xd0-\xd7]", frame[at:end]) if every else [frame[at:end]]
    for unit in range(rows * columns):
        if unit % (every or rows * columns) == 0:
            if unit // (every or rows * columns) >= len(scan):
                raise ValueError("a frame ends too early")
            bits, last = _Bits(scan[unit // (every or rows * columns)]), [0] * len(parts)
        for i, p in enumerate(parts):
            which = scans[p["id"]]
            dc, ac = codes[0, which >> 4], codes[1, which & 15]
            for place in range(p["h"] * p["v"]):
                last[i] += bits.number(bits.symbol(dc))
                block, k = np.zeros(64) if i == 0 else None, 1
                while k < 64:
                    symbol = bits.symbol(ac)
                    zeros, n = symbol >> 4, symbol & 15
                    if not n and zeros != 15:
                        break
                    k += zeros
                    value = bits.number(n)
                    if k > 63:
                        raise ValueError("a block is too long")
                    if block is not None:
                        block[k] = value
                    k += 1
                if block is not None:
                    block[0] = last[0]
                    y, x = unit // columns * p["v"] + place // p["h"], unit % columns * p["h"] + place % p["h"]
                    blocks[y, x] = block
    plain = np.zeros_like(blocks)
    plain[..., _ORDER] = blocks * steps[first["q"]]
    plain = plain.reshape(*blocks.shape[:2], 8, 8)
    samples = np.einsum("ux,abuv,vy->axby", _COSINE, plain, _COSINE).reshape(blocks.shape[0] * 8, -1) + 128
    # the first component has the full size but for odd samplings
    up = np.repeat(np.repeat(samples, tall // first["v"], 0), broad // first["h"], 1)
    return np.clip(np.rint(up[: shape[0], : shape[1]]), 0, 255).astype(np.uint8)


def _is_lossless(frame: bytes) -> bool:
    at = 2
    while at + 4 <= len(frame):
        mark, marker, size = struct.unpack_from(">BBH", frame, at)
        if mark != 0xFF or marker == 0xDA:
            break
        if marker in (0xC0, 0xC1):
            return False
        at += 2 + size
    return True


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples (height, width) of each image; lossless images of equal headers are decoded in lockstep."""
    out: list[np.ndarray] = [None] * len(frames)  # type: ignore[list-item]
    known: dict[bytes, tuple] = {}
    kinds: dict[bytes, list[int]] = {}
    for i, f in enumerate(frames):
        head = _HEAD if f.startswith(_HEAD) else None
        if head is None:
            if not _is_lossless(f):
                out[i] = baseline(f)
                continue
            n = _parse(f)[0]
            head = f[:n]
        if head not in known:
            known[head] = _parse(f)
        kinds.setdefault(head, []).append(i)
    for head, places in kinds.items():
        n_head, height, width, tables = known[head]
        for lo in range(0, len(places), TOGETHER):
            part = places[lo : lo + TOGETHER]
            for i, s in zip(part, _lockstep([frames[i][n_head : frames[i].rindex(_END)] for i in part], height, width, *tables)):
                out[i] = s
    return out


def _lockstep(coded: list[bytes], height: int, width: int, length: np.ndarray, value: np.ndarray) -> np.ndarray:
    plain = [c.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff\xff" for c in coded]
    sizes = np.array([len(p) for p in plain], np.int64)
    b = np.frombuffer(b"".join(plain) + b"\0\0\0", np.uint8).astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    ends = np.cumsum(sizes) * 8
    pos = ends - sizes * 8
    d = np.empty((height * width, len(coded)), np.int16)
    for t in range(height * width):
        at = np.minimum(pos >> 3, len(window) - 1)
        code = window[at] >> (16 - (pos & 7)).astype(np.uint32) & 0xFFFF
        step = length[code]
        d[t] = value[code]
        pos += step
    if (pos > ends - 32).any():
        raise ValueError("a frame ends too early")
    d = d.T.reshape(-1, height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = d[:, :, 0].cumsum(1)
    return (d.cumsum(2) & 255).astype(np.uint8)


def cuts(samples: np.ndarray, how: Shots = Shots()) -> list[int]:
    """The first frame of each shot of ``samples`` (frames, ...)."""
    n = len(samples)
    flat = samples.reshape(n, -1)
    at = np.arange(n)[:, None] * how.bins + (flat.astype(np.int64) * how.bins >> 8)
    hist = np.bincount(at.ravel(), minlength=n * how.bins).reshape(n, how.bins)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * flat.shape[1])
    sums = np.concatenate([[0.0], np.cumsum(diff)])
    squares = np.concatenate([[0.0], np.cumsum(diff**2)])
    i = np.arange(len(diff))
    lo = np.maximum(0, i - how.window)
    many = np.maximum(1, i - lo)
    mean = (sums[i] - sums[lo]) / many
    spread = np.sqrt(np.maximum(0, (squares[i] - squares[lo]) / many - mean**2))
    limit = np.maximum(how.least, mean + how.deviations * spread)
    return [0, *(np.flatnonzero(diff > limit) + 1).tolist()]


def encoded(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as UTF-8, filled up with 255 to whole frames, as an AVI file.

    Null and empty texts are one frame; long ones are whole, up to the 4 GB of a file. Other columns are ignored."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                plain = [(t.as_py() or "").encode() for t in part.column(1)]
                counts = [max(1, -(-len(p) // SAMPLES)) for p in plain]
                joined = np.frombuffer(b"".join(p.ljust(n * SAMPLES, b"\xff") for p, n in zip(plain, counts)), np.uint8).reshape(-1, SIDE, SIDE)
                frames = [f for a in range(0, len(joined), TOGETHER) for f in jpeg_frames(joined[a : a + TOGETHER])]
                ends = np.cumsum(counts).tolist()
                media = [avi(frames[e - n : e]) for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, plain), pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _decoded(column) -> list[tuple[np.ndarray, float] | str | None]:
    """(samples, frames a second) of each file, or why it can't be decoded; None for null."""

    def each(files: list[bytes]) -> list:
        read = [read_avi(f) for f in files]
        samples, at, out = decode_frames([f for x in read for f in x[0]]), 0, []
        for images, rate in read:
            if not images:
                raise ValueError("the file has no intra frames")
            out.append((np.stack(samples[at : at + len(images)]), rate))
            at += len(images)
        return out

    def alone(data: bytes):
        try:
            return each([data])[0]
        except (ValueError, KeyError, IndexError, struct.error, OverflowError) as e:
            return str(e) or type(e).__name__

    known = [m.as_py() for m in column if m.is_valid]
    try:
        found = iter(each(known))
    except (ValueError, KeyError, IndexError, struct.error, OverflowError):
        found = map(alone, known)
    return [next(found) if m.is_valid else None for m in column]


def clips(media: DataFrame, how: Shots = Shots()) -> DataFrame:
    """``doc_id, clip, first_frame, frames, start_s, end_s, level, error``: timed rows, one a shot.

    ``media`` has doc_id and a binary column media; other columns are ignored. Null media give no rows. A file that is no AVI, is damaged, or has
    frames of other processes gives one row, of null but for doc_id and ``error``. Clips count from 0; ``level`` is the mean sample.
    Equal rows give equal rows each; an empty table gives none.
    """

    def run(batches):
        names = ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "level", "error"]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.string()]
        for batch in batches:
            for part in slices(batch, 1, 200):
                rows = []
                for doc_id, found in zip(part.column(0).to_pylist(), _decoded(part.column(1))):
                    if isinstance(found, str):
                        rows.append((doc_id, None, None, None, None, None, None, found))
                    elif found:
                        rows += [(doc_id, k, a, b - a, a / found[1], b / found[1], level, None) for k, a, b, level in _clips(found[0], how)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, clip long, first_frame long, frames long, start_s double, end_s double, level double, error string")


def _clips(samples: np.ndarray, how: Shots):
    starts = cuts(samples, how)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(samples)])):
        yield k, a, b, float(samples[a:b].mean())


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_back(media: DataFrame, how: Shots = Shots()) -> DataFrame:
    """Digests of the stored files of ``encoded`` and of the bytes that decoding them gives.

    ``feature`` lists the clips as start-end@level, in seconds. Null text is stored as an empty one: one frame of 255. Equal
    texts give equal files; rows repeat as they do in the input, other columns are ignored. What can't be decoded has an ``error`` and
    no payload; an empty table gives no row.
    """

    def run(batches):
        fields = [x.split() for x in _READ.split(", ")]
        kinds = [pa.int64() if k == "long" else pa.string() for _, k in fields]
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for doc_id, n, kept, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), _decoded(part.column(2))):
                    kept = kept.as_py()
                    held = (None, None) if kept is None else (len(kept), hashlib.sha256(kept).hexdigest())
                    if not isinstance(found, tuple):
                        rows.append((doc_id, n, None, None, None, *held, None, found or "no media"))
                        continue
                    samples, rate = found
                    payload = samples.tobytes()
                    feature = ",".join(f"{a / rate:g}-{b / rate:g}@{level:.3f}" for _, a, b, level in _clips(samples, how))
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *held, feature, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [n for n, _ in fields])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(encoded(documents(spark, sf_dir)))
