"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import stored
from cohortmill.session import broadcast_if_small


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge (``u``, ``v``); root is the smallest node.

    Each round links all neighbours of a node to the smallest one, first the larger neighbours,
    then the smaller ones; rounds grow with the logarithm of the longest path. The smallest
    neighbour is a pre-aggregated minimum that joins back by node, so a node with very many
    neighbours can be split by the join. Nothing is gathered on the driver but a count and a
    checksum per round. No edges give no rows.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # computed apart from the join, which may then split the rows of a hot node
        least = broadcast_if_small(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (both.join(least, "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "edges")
        least = broadcast_if_small(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = stored(small, "edges")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
