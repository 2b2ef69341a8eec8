"""Balanced sharding by longest-processing-time scheduling.

Documents with equal texts form a group that must stay together.  The groups,
sorted by size, go to the least-loaded shard through a heap.

What reaches the driver is bounded whatever the corpus: groups above a
hundredth of a shard's fair share are units of their own (at most
100 * shards of them), all other groups are packed by a hash of their text into
`per_shard * shards` bundles, and the heap schedules units.  A row finds its
shard from a broadcast of those units, so no row is shuffled to be assigned,
and a group of copies that holds a third of the corpus is never gathered.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Bytes counted for every row besides its text.
ROW_OVERHEAD = 8
#: Bundles of small groups for each shard; the most that one bundle can unbalance is about 1/per_shard of a shard.
BUNDLES_PER_SHARD = 1000
#: Groups larger than a shard's fair share divided by this are scheduled one by one.
HEAVY_PART = 100
#: Rows for which one task numbers the slots, on average.
SLOT_ROWS = 50_000


def longest_first(sizes: dict, shards: int) -> dict:
    """Unit -> shard: units by falling size (ties by key), each to the least-loaded shard (ties by number)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """One row per row of docs: its id, size, text_crc32, shard and slot.

    size: UTF-8 bytes of the text plus ROW_OVERHEAD; slot: gapless from 0 in each shard.
    Null texts count as having no bytes and form one group of their own, apart from
    empty texts.  Repeated or null ids are kept, each with a slot of its own.  Other
    columns of docs are ignored.  An empty table gives an empty result.
    """
    if shards < 1 or per_shard < 1:
        raise ValueError("shards and per_shard must be positive")
    bundles = shards * per_shard
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.when(F.col(text_col).isNull(), "n").otherwise("t"), F.md5(text.cast("binary"))).alias("g"),
    ).withColumn("bundle", F.pmod(F.xxhash64("g"), F.lit(bundles)).cast("int"))
    groups = written(rows.groupBy("g", "bundle").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    heavy = groups.filter(F.col("bytes") > total / (shards * HEAVY_PART))
    units = {("group", r["g"]): r["bytes"] for r in heavy.collect()}  # fewer than shards * HEAVY_PART
    light = groups.filter(F.col("bytes") <= total / (shards * HEAVY_PART)).groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
    units |= {("bundle", f"{r['bundle']:012d}"): r["bytes"] for r in light.collect()}  # at most `bundles`
    place = longest_first(units, shards)
    spark = docs.sparkSession
    own = spark.createDataFrame([(k, s) for (kind, k), s in place.items() if kind == "group"], "g string, own_shard int")
    of_bundle = spark.createDataFrame([(int(k), s) for (kind, k), s in place.items() if kind == "bundle"], "bundle int, bundle_shard int")
    buckets = max(4, min(1 << 20, n_rows // (shards * SLOT_ROWS) + 1))
    placed = (
        rows.join(F.broadcast(own), "g", "left")
        .join(F.broadcast(of_bundle), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    )
    placed = written(placed, "placed")
    before = (
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("r", rank)
        .join(before, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("r") - 1).cast("long").alias("slot"))
    )
