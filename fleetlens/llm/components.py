"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that is not a root itself; a root is the smallest node.

    Each round hangs the larger neighbours of every node, then the smaller ones, below the
    smallest; links stay as many at most and the rounds grow with the logarithm of a component.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("center"), F.least("low", "a").alias("low"))
        # larger neighbours of each node go below the smallest around it
        links = both.join(low, both["a"] == low["center"]).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # then each node and its smaller neighbours do
        low = links.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "center")
        pairs = links.join(low, links["a"] == low["center"])
        links = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("center", "low")).filter("a <> b").distinct()
        links = stored(links, "links")
        before, state = state, _state(links)
        if before == state:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
