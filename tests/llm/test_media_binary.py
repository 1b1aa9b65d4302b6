import hashlib
import zlib

import numpy as np
import pytest

from catalink.llm import binary, media


def test_lossless_frames():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (40, 24, 24)).astype(np.uint8)
    x[0], x[1], x[2, ::2] = 255, 0, 255
    assert all((a == b).all() for a, b in zip(x, media.decode_frames(media.jpeg_frames(x))))


def test_avi_index_is_followed_and_checked():
    frames = media.jpeg_frames(np.arange(3 * 576, dtype=np.uint32).astype(np.uint8).reshape(3, 24, 24))
    data = media.avi(frames)
    assert media.read_avi(data) == (frames, 25.0)
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF" + data[4:8] + b"WAVE" + data[12:])
    at = data.index(b"idx1") + 16
    with pytest.raises(ValueError):
        media.read_avi(data[:at] + b"\xff\xff\xff\x7f" + data[at + 4 :])
    with pytest.raises(ValueError):
        media.decode_frames([frames[0][:80] + b"\xff\xd9"])


def test_shots():
    x = np.zeros((30, 24, 24), np.uint8)
    x[10:] = 200
    x[20:] = 90
    assert media.cuts(x) == [0, 10, 20] and media.cuts(x[:1]) == [0]


def test_read_back_of_odd_texts(odd, none):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.read_back(media.encoded(odd)).collect()}
    for r in odd.collect():
        data = (r["text"] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        row = got[r["doc_id"], hashlib.sha256(payload).hexdigest()]
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-32:]))
    assert media.read_back(media.encoded(none)).count() == 0


def test_clips_are_timed_and_null_media_skipped(spark, odd):
    rows = media.clips(media.encoded(odd.where("doc_id = 4")).select("doc_id", "media")).orderBy("clip").collect()
    assert rows[0]["start_s"] == 0 and all(a["end_s"] == b["start_s"] for a, b in zip(rows, rows[1:]))
    assert media.clips(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def written_elsewhere(spark, pixels, grey):
    """A baseline JPEG by Java's own writer, and the pixels that its reader gives back."""
    jvm = spark._jvm
    h, w = pixels.shape[:2]
    kind = jvm.java.awt.image.BufferedImage
    image = kind(w, h, kind.TYPE_BYTE_GRAY if grey else kind.TYPE_INT_RGB)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(pixels[y, x]),) * 3 if grey else map(int, pixels[y, x])
            if grey:
                image.getRaster().setSample(x, y, 0, r)
            else:
                image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if grey:
        return data, np.array([[back.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
    rgb = np.array([[[back.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)])
    return data, rgb @ [0.299, 0.587, 0.114]


@pytest.mark.parametrize("grey", [True, False])
def test_baseline_frames_of_another_writer(spark, grey):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:21, 0:37]
    smooth = np.stack([120 + 60 * np.sin(x / 7), 100 + 3.0 * y, 60 + 2 * x], -1) + rng.normal(0, 3, (21, 37, 3))
    pixels = np.clip(smooth[..., 0] if grey else smooth, 0, 255).astype(int)
    data, want = written_elsewhere(spark, pixels, grey)
    got = media.baseline(data)
    assert got.shape == (21, 37) and np.abs(got.astype(float) - want).max() <= (1 if grey else 3)
    film = media.avi([data] * 3)
    rows = media.clips(spark.createDataFrame([(1, film)], "doc_id long, media binary")).collect()
    assert [(r["first_frame"], r["frames"], r["error"]) for r in rows] == [(0, 3, None)] and abs(rows[0]["level"] - got.mean()) < 1e-9


def test_what_cannot_be_decoded_is_a_row(spark):
    good = media.avi(media.jpeg_frames(np.full((3, 24, 24), 7, np.uint8)))
    junk = [b"junk", b"", good[:300], good[:-40], b"RIFF\x04\0\0\0AVI ", good.replace(b"\xff\xc3", b"\xff\xc2"), media.avi([b"\xff\xd8nothing"])]
    df = spark.createDataFrame([(0, good, 5), *((i + 1, j, 1) for i, j in enumerate(junk)), (99, None, 0)], "doc_id long, media binary, n_bytes long")
    rows = {r["doc_id"]: r for r in media.clips(df).collect()}
    assert rows.keys() == set(range(8)) and rows[0]["error"] is None and rows[0]["level"] == 7
    assert all(rows[i]["error"] and rows[i]["clip"] is None for i in range(1, 8))
    back = {r["doc_id"]: r for r in media.read_back(df).collect()}
    assert len(back) == 9 and back[0]["feature"] == "0-0.12@7.000" and back[0]["payload_bytes"] == 3 * 576
    assert all(back[i]["error"] and back[i]["payload_sha256"] is None for i in (*range(1, 8), 99))
    assert back[1]["media_sha256"] == hashlib.sha256(b"junk").hexdigest()


def test_features_are_the_shots_of_the_samples(spark):
    text = "a" * 5760 + "\u7fff" * 1920 + "zZ" * 1440
    row = media.read_back(media.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    data = np.frombuffer(text.encode().ljust(-(-len(text.encode()) // 576) * 576, b"\xff"), np.uint8).reshape(-1, 24, 24)
    starts = media.cuts(data)
    ends = [*starts[1:], len(data)]
    assert row["feature"] == ",".join(f"{a / 25:g}-{b / 25:g}@{data[a:b].mean():.3f}" for a, b in zip(starts, ends)) and len(starts) == 3


def coded(ids, how):
    table = binary.Table(np.bincount(ids, minlength=1 << 16), how.bits)
    return table, binary.write_file([1, None], [1, len(ids) - 1], ids, table, how)


@pytest.mark.parametrize("n", [2, 127, 128, 5000, 70_000])
def test_rans_round_trip(n):
    how = binary.Coding(block=1 << 14)
    ids = (np.random.default_rng(n).zipf(1.4, n) % 50_257).astype(np.uint16)
    table, data = coded(ids, how)
    names, lengths, got = binary.read_file(data, table, how)
    assert names == [1, None] and lengths.tolist() == [1, n - 1] and (got == ids).all()
    assert int(table.freq.sum()) == 1 << how.bits


def test_damage_is_noticed():
    how = binary.Coding(block=1 << 10)
    table, data = coded((np.arange(5000) % 300).astype(np.uint16), how)
    for at in (20, len(data) // 2, len(data) - 3):
        with pytest.raises(ValueError):
            binary.read_file(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], table, how)
    with pytest.raises(ValueError):
        binary.read_file(data, binary.Table(np.bincount([1, 2, 3], minlength=1 << 16), how.bits), how)


def test_ranges_read_their_blocks_only():
    how = binary.Coding(block=1 << 10, lanes=32)
    ids = (np.random.default_rng(3).zipf(1.4, 9000) % 50_257).astype(np.uint16)
    table, data = coded(ids, how)
    taken = []

    def read(at, n, source=data):
        taken.append(n)
        return source[at : at + n]

    for start, n in ((0, 9000), (0, 1), (1023, 2), (5000, 1), (8999, 50), (9000, 5), (2048, 1024), (-3, 5)):
        assert binary.read_range(read, start, n, table, how).tolist() == ids[max(0, start) : max(0, start + n)].tolist()
    taken.clear()
    binary.read_range(read, 5000, 1, table, how)
    assert sum(taken) < len(data) / 2
    broken = data[:-3] + bytes([data[-3] ^ 1]) + data[-2:]
    assert binary.read_range(lambda at, n: broken[at : at + n], 0, 2000, table, how).tolist() == ids[:2000].tolist()
    with pytest.raises(ValueError):
        binary.read_range(lambda at, n: broken[at : at + n], 8000, 900, table, how)


def test_vocabularies_beyond_16_bits():
    how = binary.Coding(block=1 << 10)
    ids = np.array([0, 70_000, 99_999, 70_000] * 900, np.uint32)
    table = binary.Table(np.bincount(ids, minlength=100_000), how.bits)
    assert binary.read_file(binary.write_file([1], [3600], ids, table, how), table, how)[2].tolist() == ids.tolist()


def test_size_is_near_the_entropy():
    how = binary.Coding()
    ids = (np.random.default_rng(5).zipf(1.3, 400_000) % 50_257).astype(np.uint16)
    _, data = coded(ids, how)
    p = np.bincount(ids) / len(ids)
    p = p[p > 0]
    assert len(data) * 8 / len(ids) < -(p * np.log2(p)).sum() * 1.06


def test_files_of_odd_texts(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(binary.vocabulary("byte_bpe_50k.json"))
    files, table = binary.write_ids(odd)
    got = binary.read_ids(files, table).orderBy("start").collect()
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    want = sorted((str(r["doc_id"]), np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]
    digests = binary.read_ids(files, table, digest=True).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in digests] == [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got]
    files, table = binary.write_ids(none)
    assert binary.read_ids(files, table).count() == 0
