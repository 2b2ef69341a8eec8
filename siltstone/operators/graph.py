"""Link graphs and bounded neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wikilinks(docs: DataFrame, name: str, text: str) -> DataFrame:
    """(src, dst), both directions, of [[links]] whose target exists."""
    links = docs.select(F.col(name).alias("src"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("dst")).withColumn("dst", F.trim("dst"))
    known = links.join(docs.select(F.col(name).alias("dst")), "dst", "left_semi").filter("src <> dst")
    return known.select("src", "dst").union(known.select("dst", "src")).distinct()


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, depth): nodes within so many hops of each start, at their least depth.

    A fixed number of joins; each round expands only nodes that were new in the round before."""
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen
