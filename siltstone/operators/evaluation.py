"""Evaluation of retrieval and answers, comparison of runs, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m

# ---- Fixed values that results depend on.
LOWER_IS_BETTER = ("latency", "hallucination_rate", "protected_path_leakage", "error_rate")

#: Values that one task sorts, and the accuracy of the quantile sketches that lead to them.
SORTED_AT_ONCE, SKETCH = 100_000, 10_000


def retrieval_metrics(results: DataFrame, retrieved: str = "retrieved", relevant: str = "relevant", k: int = 10, total: str | None = None) -> DataFrame:
    """total: a column with the number of all relevant ids, where `relevant` lists only those of them that were retrieved."""
    r, g, n = F.col(retrieved), F.col(relevant), F.col(total) if total else None
    return results.withColumns({f"precision_{k}": m.precision_at(r, g, k), f"recall_{k}": m.recall_at(r, g, k, n), "rr": m.reciprocal_rank(r, g), f"ndcg_{k}": m.ndcg_at(r, g, k, n)})


def answer_flags(results: DataFrame) -> DataFrame:
    """Per question: cited or abstained, abstained when it must, has an expected phrase."""
    return results.withColumns({
        "citation_ok": (F.size("citations") > 0) | F.col("abstained"),
        "abstention_ok": F.col("must_abstain") == F.col("abstained"),
        "contains_ok": m.contains_expected(F.col("answer"), F.col("keywords"), F.col("must_abstain")),
    })


def question_scores(results: DataFrame, retrieved: str = "retrieved", relevant: str = "relevant", total: str | None = None) -> DataFrame:
    """results with retrieval_recall, retrieval_correct (all expected came) and hit; nothing expected is right only if nothing came.
    total: as in retrieval_metrics."""
    got, want = F.array_distinct(retrieved), F.array_distinct(relevant)
    n = F.col(total) if total else F.size(want)
    common, none = F.size(F.array_intersect(got, want)), n == 0
    return results.withColumns({
        "retrieval_recall": F.when(none, (F.size(got) == 0).cast("double")).otherwise(common / n),
        "retrieval_correct": F.when(none, F.size(got) == 0).otherwise(common == n),
        "hit": common > 0,
    })


def by_slice(scored: DataFrame, slice_col: str, columns: list[str], digits: int = 4) -> DataFrame:
    """Means by slice and overall (slice null) in one pass."""
    grouped = scored.groupingSets([[F.col(slice_col)], []], F.col(slice_col))
    return grouped.agg(F.count("*").alias("n"), *[F.bround(F.avg(F.col(c).cast("double")), digits).alias(c) for c in columns])


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta, winner) over the union of two runs' (metric, value)."""
    x, y = a.select("metric", F.col("value").alias("a")), b.select("metric", F.col("value").alias("b"))
    lower = F.lit(False)
    for name in LOWER_IS_BETTER:
        lower = lower | F.contains(F.col("metric"), F.lit(name))
    gain = F.when(lower, -F.col("delta")).otherwise(F.col("delta"))
    return x.join(y, "metric", "full_outer").withColumn("delta", F.col("b") - F.col("a")).withColumn("winner", F.when(gain > 0, "b").when(gain < 0, "a").when(gain == 0, "tie"))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(project, metric, floor, value, issue): missing and failing metrics; leakage must not exceed its bound."""
    leak = F.col("metric") == "protected_path_leakage"
    bad = F.when(F.col("value").isNull(), "missing").when(leak & (F.col("value") > F.col("floor")), "above").when(~leak & (F.col("value") < F.col("floor")), "below")
    return thresholds.join(metrics, ["project", "metric"], "left").withColumn("issue", bad).filter("issue is not null")


def value_at(rows: DataFrame, value: str, place: int, n: int, at_once: int = SORTED_AT_ONCE):
    """The non-null value at a place (from 0) of their order, n in all; None where there is none.

    Quantile sketches narrow the values to those strictly between two bounds that aren't the answer themselves, until
    one task can sort what is left: no task holds more, however many distinct values there are."""
    if not 0 <= place < n:
        return None
    part, near = rows.select(F.col(value).alias("v")).filter("v is not null"), 4 / SKETCH
    while n > at_once:
        share = (place + 0.5) / n
        bounds = F.percentile_approx("v", [max(0.0, share - near), min(1.0, share + near)], SKETCH)
        low, high = part.agg(bounds).first()[0]
        under = part.agg(*[F.count_if(c) for c in (F.col("v") < low, F.col("v") <= low, F.col("v") < high, F.col("v") <= high)]).first()
        if under[0] <= place < under[1]:
            return low
        if under[2] <= place < under[3]:
            return high
        if under[1] <= place < under[2]:
            part, place, n = part.filter((F.col("v") > low) & (F.col("v") < high)), place - under[1], under[2] - under[1]
        else:
            near *= 4
    return part.orderBy("v").offset(place).limit(1).first()[0]


def dashboard(traces: DataFrame, value: str, failed: Column) -> DataFrame:
    """One row: count, median, p95 (the value at place int(0.95 n)), error rate; null values have no place."""
    n = traces.agg(F.count(value)).first()[0]
    at = {k: value_at(traces, value, k, n) for k in sorted({(n - 1) // 2, n // 2, min(int(0.95 * n), n - 1)})} if n else {}
    p50 = (at[(n - 1) // 2] + at[n // 2]) / 2 if n else None
    p95 = at[min(int(0.95 * n), n - 1)] if n else None
    return traces.agg(F.count("*").alias("n"), F.lit(p50).cast("double").alias("p50"), F.lit(p95).cast("double").alias("p95"), F.avg(failed.cast("double")).alias("error_rate"))


def format_f1(scores: DataFrame, by: str = "format") -> DataFrame:
    """Mean recall and precision by format, and their harmonic mean."""
    out = scores.groupBy(by).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))
    total = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("recall") * F.col("precision") / total).otherwise(0.0))


def expected_blocks_found(expected: DataFrame, blocks: DataFrame) -> DataFrame:
    """Expected blocks with `found`: some extracted block of the file has the type, page, words and size asked for."""
    e = F.col
    same = (
        (e("e.file") == e("b.file")) & (e("e.block_type") == e("b.block_type"))
        & (e("e.page").isNull() | (e("e.page") == e("b.page")))
        & F.forall("e.keywords", lambda k: F.contains(F.col("b.text"), k))
        & F.forall("e.headers", lambda h: F.array_contains(F.col("b.headers"), h))
        & (F.size("b.rows") >= F.coalesce("e.min_rows", F.lit(0))) & (F.char_length("b.text") >= F.coalesce("e.min_chars", F.lit(0)))
    )
    hits = expected.alias("e").join(blocks.alias("b"), same, "left_semi").withColumn("found", F.lit(True))
    misses = expected.alias("e").join(blocks.alias("b"), same, "left_anti").withColumn("found", F.lit(False))
    return hits.unionByName(misses)


def heuristic_grade(citations: Column, abstained: Column) -> Column:
    return F.when(abstained | (F.size(citations) == 0), "poor").otherwise("good")
