"""Connected components of a links table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) -> ``node, root`` of every node that has a link to another.

    In a round each node goes to the least of itself and its neighbours (a minimum,
    combined map-side), and the links follow; what was linked stays linked. Node numbers
    should be hashes: then a constant share of the nodes goes in each round, and the rounds
    grow with the logarithm of the longest chain. A node of very many links makes joins
    on it skewed, which adaptive execution splits. Every round is a table in the shared
    folder. Null ends and loops are ignored.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both(links).select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    while not links.isEmpty():
        to = stored(both(links).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "hooks")
        move = to.where("m < a")
        labels = stored(
            labels.join(move.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("m", "root").alias("root")), "labels")
        first = links.join(to, "a").select(F.col("m").alias("a2"), F.col("b"))
        second = first.join(to.select(F.col("a").alias("b"), "m"), "b").select("a2", F.col("m").alias("b2"))
        links = stored(second.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    return labels
