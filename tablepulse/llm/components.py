"""Connected components of an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.storage import cut


def _lowest(pairs: DataFrame) -> DataFrame:
    """``pairs`` (node, other) with the smallest member of each node's neighbourhood."""
    least = pairs.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    return pairs.join(least, "node")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (src, dst)``; the component is its smallest node.

    Alternates the large-star and small-star steps.  Both replace a node's edges by edges
    to the smallest neighbour, so the number of edges does not grow, and stop when a round
    changes nothing.  Minima are combined in the tasks first, and adaptive execution splits
    the joins of nodes that have very many edges.
    """
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("other"))
    links = cut(links.distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _lowest(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        down = large.distinct()
        joined = _lowest(down)
        small = joined.where("other <> least").select(F.col("other").alias("node"), F.col("least").alias("other"))
        own = joined.select("node", F.col("least").alias("other"))
        links = cut(small.unionByName(own).distinct())
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")).alias("digest")
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = links.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct()
    return links.select("node", F.col("other").alias("component")).unionByName(roots)
