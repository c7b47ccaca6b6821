"""Connected components by alternating large and small stars.

Each round rewires every node to the smallest node known near it. Edges stay
rows of a table from round to round; only their count and a checksum reach the
driver. Hubs are aggregated with map-side combine, and the joins that carry a
hub's edges are plain sort-merge joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge now points from the larger node u to a smaller v
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, label)`` for every node of an edge, label being
    the smallest node of its component. Self-loops and repeats are allowed; null
    ends are not edges. No edges give an empty table."""
    cur = store(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        seen = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
        cur = store(_small_star(_large_star(cur)).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
