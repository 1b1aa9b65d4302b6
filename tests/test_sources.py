import numpy as np

from catalink.functions.text import hamming
from catalink.sources import catalog_xml, files, page_images, state_files


def test_catalog_keeps_document_order(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text("<Catalog><Game><Title>B</Title><Notes/></Game><Game><Title>A</Title><ReleaseYear>1980</ReleaseYear></Game></Catalog>")
    got = catalog_xml.read_catalog(spark, str(path)).orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["year"]) for r in got] == [(0, "B", None), (1, "A", "1980")]


def test_missing_catalog_is_empty(spark, tmp_path):
    assert catalog_xml.read_catalog(spark, str(tmp_path / "none.xml")).count() == 0


def test_listing_and_hash(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"x")
    (tmp_path / "a c.png").write_bytes(b"y")
    (tmp_path / "Thumbs.db").write_bytes(b"z")
    docs = files.documents_in(spark, str(tmp_path))
    assert [(r["file_name"], r["stem"]) for r in docs.collect()] == [("b.PDF", "b")]
    assert [r["clean_name"] for r in files.images_in(spark, str(tmp_path)).collect()] == ["a c"]
    assert [r["file_name"] for r in files.others_in(spark, str(tmp_path)).collect()] == ["a c.png"]
    import hashlib

    assert files.hashed(spark, docs).first()["sha256"] == hashlib.sha256(b"x").hexdigest()


def test_pages_to_read():
    assert files.pages_to_read(5) == [0, 1, 2, 3, 4] and len(files.pages_to_read(100)) == 30


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert state_files.load(spark, path, state_files.CACHE).count() == 0
    for title in ("one", "two"):
        state_files.save(spark.createDataFrame([("h", title, "x")], state_files.CACHE), path)
    assert state_files.load(spark, path, state_files.CACHE).first()["title"] == "two"


def test_most_confident_text_stops_at_80(spark):
    rows = [("p", 90, 0, "a", 70.0), ("p", 110, 0, "b", 85.0), ("p", 130, 0, "c", 99.0), ("p", 90, 1, "x", -1.0)]
    df = spark.createDataFrame(rows, "page string, threshold int, place int, word string, conf double")
    assert files.confident_text(df).first()["text"] == "b"


def test_reset_keeps_a_copy(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert state_files.reset(spark, path, state_files.CACHE) is None
    state_files.save(spark.createDataFrame([("h", "one", "x")], state_files.CACHE), path)
    backup = state_files.reset(spark, path, state_files.CACHE)
    assert state_files.load(spark, path, state_files.CACHE).count() == 0
    assert spark.read.schema(state_files.CACHE).json(backup).first()["title"] == "one"


def test_renames_are_validated(spark, tmp_path):
    path = str(tmp_path / "renames")
    rows = [("/d", "a", "b"), (None, "a", "b"), ("", "c", "d"), ("/d", None, "x"), ("/d", "y", None)]
    state_files.save(spark.createDataFrame(rows, state_files.RENAMES), path)
    assert [tuple(r) for r in state_files.load_renames(spark, path).collect()] == [("/d", "a", "b")]
    assert state_files.load_renames(spark, str(tmp_path / "none")).count() == 0


IMAGE = "path string, page int, place int, width int, height int"


def test_largest_image_and_cover(spark):
    rows = [("a", 0, 0, 10, 30), ("a", 0, 1, 30, 10), ("a", 0, 2, None, None), ("a", 1, 0, 0, 50), ("b", 0, 0, 70_000, 70_000), ("b", 0, 1, 1, 1), ("b", 3, 4, 5, 6)]
    images = spark.createDataFrame(rows, IMAGE)
    assert {(r["path"], r["page"]): r["place"] for r in page_images.largest(images).collect()} == {("a", 0): 0, ("b", 0): 0, ("b", 3): 4}
    assert {r["path"]: r["width"] for r in page_images.covers(images).collect()} == {"a": 10, "b": 70_000}
    assert page_images.largest(images.limit(0)).count() == 0


def test_rows_of_one_place_and_area_are_chosen_whatever_their_order(spark):
    rows = [("a", 0, 5, 578, 1100), ("a", 0, 5, 289, 2200), ("a", 0, 6, 578, 1100)]
    for given in (rows, rows[::-1]):
        got = page_images.largest(spark.createDataFrame(given, IMAGE).coalesce(1)).collect()
        assert [(r["place"], r["width"], r["height"]) for r in got] == [(5, 578, 1100)]


def test_images_that_are_read(spark):
    rows = [("a", p, 0, 100, 20) for p in range(12)] + [("a", 0, 1, 19, 500), ("a", 0, 2, None, 50), ("b", 0, 0, 50, 50), ("c", 0, 0, 50, 50)]
    docs = spark.createDataFrame([("a", 12), ("b", 1)], "path string, page_count int")
    got = {(r["path"], r["page"], r["place"]): (r["is_front"], r["is_back"]) for r in page_images.readable(spark.createDataFrame(rows, IMAGE), docs).collect()}
    assert got == {("a", p, 0): (p < 5, p >= 10) for p in (0, 1, 2, 3, 4, 10, 11)} | {("b", 0, 0): (True, True)}


def test_sizes_of_reading(spark):
    sizes = [(2200, 5), (4400, 3001), (1, 9000), (7, 2201), (None, 9000), (None, None)]
    got = page_images.scaled(spark.createDataFrame([("a", 0, i, *s) for i, s in enumerate(sizes)], IMAGE)).orderBy("place").collect()
    want = [(w, h) if max(w, h) <= 2200 else (max(1, int(w * (2200 / max(w, h)))), max(1, int(h * (2200 / max(w, h))))) for w, h in sizes[:4]] + [(None, None)] * 2
    assert [(r["read_width"], r["read_height"]) for r in got] == want


def test_hash_of_covers(spark):
    """Against the transform written out; small changes of a picture change few bits."""
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:64, :64]
    picture = np.clip(128 + 60 * np.sin(x / 9) + 50 * np.cos(y / 5 + x / 30) + rng.normal(0, 6, (64, 64)), 0, 255).astype(np.uint8)
    near, other = np.clip(picture.astype(int) + 3, 0, 255).astype(np.uint8), rng.integers(0, 256, (64, 64), dtype=np.uint8)
    rows = [(0, picture.tobytes()), (1, near.tobytes()), (2, other.tobytes()), (3, None), (4, b"short")]
    got = page_images.hashed_covers(spark.createDataFrame(rows, "pos int, brightness binary")).cache()
    found = {r["pos"]: r["cover_hash"] for r in got.collect()}
    k, n = np.arange(16), np.arange(64)
    low = np.array([[(picture * np.cos(np.pi * u * (2 * n[:, None] + 1) / 128) * np.cos(np.pi * v * (2 * n[None] + 1) / 128)).sum() for v in k] for u in k])
    bits = "".join(f"{h & (1 << 64) - 1:064b}" for h in found[0])
    far = [i for i, b in enumerate((low > np.median(low)).ravel()) if b != (bits[i] == "1")]
    assert all(abs(low.ravel()[i] - np.median(low)) < 1e-6 for i in far) and found[3] is found[4] is None
    a, b = got.where("pos = 0").selectExpr("cover_hash AS a"), got.where("pos IN (1, 2)").selectExpr("pos", "cover_hash AS b")
    apart = {r["pos"]: r["d"] for r in a.crossJoin(b).select("pos", hamming("a", "b").alias("d")).collect()}
    assert apart[1] <= 10 < 80 < apart[2]
