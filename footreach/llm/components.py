"""Connected components of a distributed edge list by alternating star contraction; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.session import cut_lineage


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free sum of hashes: one row, to see whether a round changed anything."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_roots(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge list (u, v): the least node reachable.

    Rounds grow with the logarithm of a component's size. Each round is a table in the shared folder. Hot nodes (the
    centres of stars) are only ever minimised over, which Spark does before the shuffle, or sit on the large side of a
    plain join, which adaptive execution splits. Nodes without a link are not in the result.
    """
    links = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = links.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links, before = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct()), state
        state = _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return own.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
