"""Connected components of a distributed edge table by alternating large-star and small-star rounds.

No round gathers a node's neighbours: each takes the least neighbour by a
pre-aggregated minimum and joins it back, so a node with very many neighbours
is split like any skewed join.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, written

#: Rounds grow with the logarithm of the longest path; more than this means a fault.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one orderable type -> (node, root): root is the least node reachable; nodes without edges are absent."""
    pairs = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = written(pairs.distinct(), "edges")
    seen = _state(pairs)
    for _ in range(MOST_ROUNDS):
        large = _large_star(pairs)
        now = written(_small_star(large), "edges")
        state = _state(now)
        remove(pairs)
        pairs = now
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = pairs.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = both.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
    return both.filter("w > n").join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and all its lower neighbours are linked to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
