"""Connected components by alternating large and small stars.

Edges stay in Spark: each round is two aggregations and two equality joins. A node with very many edges is a frequent
join key, not a group that one task gathers; its smallest neighbour is found map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the smallest node that can be reached.

    Nodes may have any type with an order. Edges with a null end, from a node to itself or repeated add nothing; no edges
    give an empty table. Each round ends with a reliable checkpoint, so the loss of executors repeats one round at most.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    stars = cut_lineage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(high.alias("u"), low.alias("v")).distinct()
    )
    mark = _mark(stars)
    while mark[0]:
        stars = cut_lineage(_small_star(_large_star(stars)))
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(stars: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them; one row reaches the driver."""
    return tuple(stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first())


def _large_star(stars: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the smallest of its neighbours and itself."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    lower = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
