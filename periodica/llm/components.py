"""Connected components of links by alternating large-star and small-star rounds, as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (long columns u and v): root is the smallest node that it reaches.

    A node's neighbours are never gathered: each round keeps a minimum per node and joins it back, so a hub is split like
    any skewed join. Rounds are written to the shared folder. Links of a node to itself and null ends are ignored.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        # large star: hand every larger neighbour to the smallest one
        near = _both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "large")
        # small star: hand the smaller neighbours, and the node itself, to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
