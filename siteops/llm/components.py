"""Connected components of a graph given by its edges, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteops.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach; roots themselves don't show.

    Edges with a null or with two equal ends don't count. In each round every node tells its larger
    neighbours about the smallest one it knows, and then its smaller ones. The number of rounds grows
    with the logarithm of a component's size. A node with very many neighbours is a skewed key of a
    join. What is joined is written first, so that both sides come straight from their exchanges and
    Spark can split it.
    """
    now = stored(pairs(edges.where("a <> b"), F.greatest("a", "b"), F.least("a", "b")))
    mark = state(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")))
        wide = both.join(least, "u").where("v > u").select("v", F.least("u", "m").alias("m"))
        large = stored(pairs(wide, F.col("v"), F.col("m")))
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        to_least = large.join(least, "u").where("v <> m").select("v", "m")
        small = pairs(to_least.unionAll(least.select("u", "m")), F.col("v"), F.col("m"))
        now = stored(small)
        before, mark = mark, state(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def pairs(df: DataFrame, u: Column, v: Column) -> DataFrame:
    return df.select(u.alias("u"), v.alias("v")).distinct()


def state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1000003)).first())
