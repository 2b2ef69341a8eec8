"""Choosing and ordering evidence for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_pack(items: Column, budget: int, tokens: str = "tokens") -> Column:
    """Items of an ordered array that fit the budget: one that would overflow is skipped, the first always goes in.

    A running sum can't say this, since later items may still fit; it is a fold over at most a ranking's length."""
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("used"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        size = x[tokens].cast("int")
        fits = (F.size(acc["taken"]) == 0) | (acc["used"] + size <= budget)
        return F.struct(F.when(fits, F.array_append(acc["taken"], acc["i"])).otherwise(acc["taken"]).alias("taken"), F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"), (acc["i"] + 1).alias("i"))

    return F.transform(F.aggregate(items, start, step, lambda acc: acc["taken"]), lambda i: F.get(items, i))


def per_source_cap(ranked: DataFrame, cap: int, query: str = "query_id", source: str = "source_id", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(query, source).orderBy(rank)
    return ranked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def ends_first(items: Column) -> Column:
    """0, n-1, 1, n-2 ...: the best evidence at both ends."""
    n = F.size(items)
    keyed = F.transform(items, lambda x, i: F.struct(F.least(2 * i, 2 * (n - 1 - i) + 1).alias("key"), x.alias("item")))
    return F.transform(F.array_sort(keyed), lambda x: x["item"])


def wrapped_evidence(items: Column, limit: int = 12_000, marker: str = "\n[...]") -> Column:
    """[En] lines of texts up to limit characters, then a mark of what was cut."""
    whole = F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    return F.when(F.char_length(whole) <= limit, whole).otherwise(F.concat(F.substring(whole, 1, limit), F.lit(marker)))


def best_attempt(attempts: DataFrame, query: str = "query_id") -> DataFrame:
    """Of each question's attempts: not abstained before abstained, most citations, the earliest; if all abstained, the last."""
    w = Window.partitionBy(query).orderBy(F.col("abstained"), F.when(F.col("abstained"), 0).otherwise(-F.size("citations")), F.when(F.col("abstained"), -F.col("attempt")).otherwise(F.col("attempt")))
    return attempts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prior_user_turn(turns: DataFrame) -> DataFrame:
    """Each user turn with the user's turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.filter("role = 'user'").withColumn("previous", F.lag("text").over(w)).select("conv_id", "turn", "text", "previous")


def conversation_history(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
