"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node, so no component is ever gathered in one place, and the number
of rounds grows with the logarithm of the components' size. Partitions follow the number of edges; in a single one the
same steps need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges in a partition, some 20 MB.
EDGES = 500_000


def _edges(*pairs: tuple[Column, Column]) -> Column:
    return F.explode(F.array(*(F.struct(u.alias("u"), v.alias("v")) for u, v in pairs))).alias("e")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    edges: columns a and b, in either direction, loops and repeats allowed.
    """
    u, v = F.col("u"), F.col("v")
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    links = cut(links.coalesce(1 + links.count() // EDGES))
    last = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node moves to the least node of its neighbourhood
        both = links.select(_edges((u, v), (v, u))).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(_edges((v, F.col("m")), (u, F.col("m")))).select("e.*")
        links = cut(small.where("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return links.select(_edges((u, v), (v, v))).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct()
