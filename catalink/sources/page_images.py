"""Images on the pages of documents, as tables: which are read, at what size, and the hash of a cover.

A table of images has ``path, page`` (from 0), ``place`` (on the page, from 0), ``width, height``; both sides are
null where a picture can't be decoded. Other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages read at the front and at the back, sides in pixels, and the hash's bits a side.
FRONT_PAGES = 5
BACK_PAGES = 2
SMALLEST_SIDE = 20
LONGEST_SIDE = 2200
HASH_SIDE = 16
#: Sides of the brightness that a hash is made of.
COVER_SIDE = 4 * HASH_SIDE


def readable(images: DataFrame, files: DataFrame, front: int = FRONT_PAGES, back: int = BACK_PAGES) -> DataFrame:
    """Images that are large enough to hold text, of the first or last pages, with ``is_front, is_back``.

    ``files`` has path and page_count. A page of a short document can be both; images of unknown documents are left out.
    """
    known = images.where((F.col("width") >= SMALLEST_SIDE) & (F.col("height") >= SMALLEST_SIDE)).join(files.select("path", "page_count"), "path")
    sided = known.withColumns({"is_front": F.col("page") < front, "is_back": F.col("page") >= F.col("page_count") - back})
    return sided.where("(is_front OR is_back) AND page < page_count").drop("page_count")


def scaled(images: DataFrame, longest: int = LONGEST_SIDE) -> DataFrame:
    """Add ``read_width, read_height``: the size at which an image is read, no side above ``longest`` and none below 1; null without both sides."""
    far = F.greatest("width", "height")
    scale = F.lit(float(longest)) / far
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    side = lambda name: F.when(known & (far <= longest), F.col(name).cast("long")).when(known, F.greatest(F.lit(1), F.floor(F.col(name) * scale)))
    return images.withColumns({"read_width": side("width"), "read_height": side("height")})


def largest(images: DataFrame) -> DataFrame:
    """``path, page, place, width, height``: the image of the greatest area on each page, the first of equal ones.

    Of several rows of one place and area the widest is taken, whatever their order.
    Pages whose images all lack an area have no row. Maxima combine map-side, so a page in thousands of strips is no burden.
    """
    area = F.col("width").cast("long") * F.col("height")
    best = images.where(area > 0).groupBy("path", "page").agg(F.max_by(F.struct("place", "width", "height"), F.struct(area, -F.col("place"), F.col("width"))).alias("best"))
    return best.select("path", "page", "best.*")


def covers(images: DataFrame) -> DataFrame:
    """``path, place, width, height``: the largest image of each document's first page."""
    return largest(images.where("page = 0")).drop("page")


def _cosines() -> np.ndarray:
    """The lowest rows of the cosine transform (type II) of ``COVER_SIDE`` values."""
    k, n = np.arange(HASH_SIDE)[:, None], np.arange(COVER_SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * COVER_SIDE))


def hashed_covers(pictures: DataFrame, column: str = "brightness") -> DataFrame:
    """Add ``cover_hash``: 256 bits as four longs, the highest bit first.

    ``column`` holds a picture's brightness scaled to 64 by 64 bytes, row by row. A bit is 1 where a low frequency of the
    picture's cosine transform is above their median. Null, and bytes of any other number, give null.
    """
    at, types = pictures.columns.index(column), pictures._jdf.schema().toDDL()
    basis = _cosines()

    def one(data: bytes | None) -> list[int] | None:
        if data is None or len(data) != COVER_SIDE**2:
            return None
        low = basis @ np.frombuffer(data, np.uint8).reshape(COVER_SIDE, COVER_SIDE).astype(float) @ basis.T
        return np.packbits(low > np.median(low)).view(">i8").tolist()

    def run(batches):
        for batch in batches:
            found = pa.array([one(x.as_py()) for x in batch.column(at)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "cover_hash"])

    return pictures.mapInArrow(run, f"{types}, cover_hash array<bigint>")
