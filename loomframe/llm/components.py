"""Connected components of an edge table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


#: A node with more than one in so many of all neighbours is hot; there are fewer hot nodes than this.
HOT_SHARE = 1000


def _with_least(both: DataFrame, least: DataFrame, neighbours: int) -> DataFrame:
    """Every pair with the least neighbour ``m`` of its node.

    The pairs of one node could be a third of all.  Hot nodes, fewer than HOT_SHARE, are broadcast,
    so that their pairs stay where they are; the pairs of all others meet by key.
    """
    hot = F.broadcast(least.filter(F.col("degree") * HOT_SHARE > neighbours).select("u", "m"))
    rest = both.join(hot, "u", "left_anti").join(least.select("u", "m"), "u")
    return both.join(hot, "u").unionByName(rest)


def _linked(pairs: DataFrame, largest: bool) -> DataFrame:
    """One star step: every node hands its (larger or smaller) neighbours to its least one."""
    back = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = pairs.union(back) if largest else pairs
    # v is the neighbour; with ``largest`` both directions are present
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
    joined = _with_least(both, least, pairs.count() * (2 if largest else 1))
    if largest:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its least node.

    Large-star and small-star steps alternate until nothing changes, which takes few rounds for
    any shape.  Minima are combined before each shuffle and hot nodes are never shuffled, so that a
    node with very many neighbours burdens no task; no neighbour list is built.  Loops and rows with a null end are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    e = settle(e.filter("a is not null and b is not null and u <> v").select("u", "v").distinct(), "edges")
    before = _mark(e)
    while before[0]:
        e = settle(_linked(settle(_linked(e, True), "stars"), False), "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select("v", "v").distinct())
