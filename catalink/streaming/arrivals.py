"""Files that arrive as a stream, linked by known fingerprints and by content as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from catalink.operators import cascade


def known_arrivals(stream: DataFrame, cache: DataFrame) -> DataFrame:
    """A stream-static join: arrivals whose fingerprint the cache knows."""
    return cascade.cached(stream, cache)


def link_batches(stream: DataFrame, entries: DataFrame, weights: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, limits: cascade.Limits = cascade.Limits()) -> StreamingQuery:
    """Pass 1's content layer on each micro-batch. A batch is final: nothing in it waits for later files, so
    pass 2, which needs all of them, is left to a batch run."""

    def each(batch: DataFrame, number: int) -> None:
        sink(cascade.content(cascade._files(batch), entries, weights, limits), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
