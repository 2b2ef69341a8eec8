"""Answer quality by a judge, query rewriting and reranking, all with the model as an argument.

A judge is `(Column, Column) -> Column` of text: of a statement and its evidence it says 1 or 0, of a question and an answer a
score.  judge_by() makes one of any `str -> str` model; native expressions serve as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import coerced_score
from ..functions.python import generate_with
from ..functions.text import statements
from .retrieval import top_k

Judge = Callable[[Column, Column], Column]
EVIDENCE_CHARS, ANSWER_CHARS, TRUTH_CHARS = 2000, 1500, 500
REWRITES = ("multi-query", "hyde", "step-back", "decomposition")


def judge_by(model: Callable[[str], str], instruction: str) -> Judge:
    """A judge that asks a model; a call that fails says nothing, which counts as no."""
    return lambda a, b: generate_with(model, F.concat(F.lit(instruction + "\n\n"), a, F.lit("\n\n"), b))


def _yes(said: Column) -> Column:
    return F.contains(said, F.lit("1")) & ~F.contains(said, F.lit("0"))


def _share(rows: DataFrame, key: str, parts: Column, other: Column, judge: Judge, name: str) -> DataFrame:
    """(key, name): the share of an array's parts that the judge says yes to beside other; 0 without parts or other."""
    one = rows.select(F.col(key), F.explode(parts).alias("part"), other.alias("other")).filter("other <> ''")
    return rows.select(key).join(one.groupBy(key).agg(F.avg(_yes(judge(F.col("part"), F.col("other"))).cast("double")).alias(name)), key, "left").select(key, F.coalesce(name, F.lit(0.0)).alias(name))


def _evidence(contexts: str) -> Column:
    return F.substring(F.trim(F.array_join(contexts, "\n")), 1, EVIDENCE_CHARS)


def faithfulness(rows: DataFrame, judge: Judge, key: str = "id") -> DataFrame:
    """The share of the answer's statements that its contexts support."""
    return _share(rows, key, statements(F.col("answer")), _evidence("contexts"), judge, "faithfulness")


def context_recall(rows: DataFrame, judge: Judge, key: str = "id") -> DataFrame:
    """The share of the ground truth's statements that the contexts support."""
    return _share(rows, key, statements(F.col("ground_truth")), _evidence("contexts"), judge, "context_recall")


def context_precision(rows: DataFrame, judge: Judge, key: str = "id") -> DataFrame:
    """The share of the contexts that help with the ground truth."""
    return _share(rows, key, F.transform("contexts", lambda c: F.substring(c, 1, ANSWER_CHARS)), F.substring("ground_truth", 1, TRUTH_CHARS), lambda c, t: judge(t, c), "context_precision")


def answer_relevancy(rows: DataFrame, judge: Judge, key: str = "id") -> DataFrame:
    """The judge's score of the answer to its question, 0 where either is empty."""
    said = coerced_score(judge(F.col("question"), F.substring("answer", 1, ANSWER_CHARS)))
    return rows.select(key, F.when((F.col("question") != "") & (F.col("answer") != ""), said).otherwise(0.0).alias("answer_relevancy"))


def hallucination_rate(faithful: Column) -> Column:
    return F.bround(1 - faithful, 4)


def unsupported_rate(said: Column) -> Column:
    """Of a reply that lists claims and ends in `unsupported: n`, the share that is unsupported; 0 where it can't be read."""
    n = F.nullif(F.regexp_extract(F.lower(said), r"unsupported[:：]\s*(\d+)", 1), F.lit("")).cast("int")
    claims = F.regexp_count(said, F.lit(r"(?m)^[\s\-*]\s*\S+"))
    return F.when(n.isNull() | (claims == 0), 0.0).otherwise(F.bround(F.least(n, claims) / claims, 4))


METRICS: dict[str, Callable[..., DataFrame]] = {"faithfulness": faithfulness, "answer_relevancy": answer_relevancy, "context_precision": context_precision, "context_recall": context_recall}


def evaluate_answers(rows: DataFrame, judges: dict[str, Judge], key: str = "id") -> DataFrame:
    """(metric, value): each metric's mean over all rows, a row without a value as 0."""
    out = None
    for name, judge in judges.items():
        one = rows.select(key).join(METRICS[name](rows, judge, key), key, "left").agg(F.bround(F.avg(F.coalesce(name, F.lit(0.0))), 4).alias("value")).select(F.lit(name).alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def rewritten(questions: DataFrame, model: Callable[[str], str], kind: str, prompt: str, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, kind, number, query): the lines that a model makes of each question; the question itself where it makes none."""
    if kind not in REWRITES:
        raise ValueError(f"kind must be one of {REWRITES}")
    said = generate_with(model, F.concat(F.lit(prompt), F.col(text)))
    lines = F.filter(F.transform(F.split(said, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    made = questions.select(F.col(key), F.col(text).alias("asked"), lines.alias("lines"))
    whole = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array("asked"))
    return made.select(key, F.lit(kind).alias("kind"), F.posexplode(whole).alias("number", "query"))


def reranked(candidates: DataFrame, score: Column, k: int = 5, query: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best candidates of each query by a second score, ties by id."""
    return top_k(candidates.withColumn("score", score), [query], "score", tie, k)


def graded(question: Column, evidence: Column, judge: Judge | None = None) -> Column:
    """good or poor: what a judge says, or without one (or without its answer) whether any word of the question is in the evidence."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"\w{2,}"), F.lit(0))), lambda w: F.contains(F.lower(evidence), w))
    plain = F.when((F.trim(evidence) != "") & (F.size(words) > 0), "good").otherwise("poor")
    if judge is None:
        return plain
    said = F.lower(F.trim(judge(question, evidence)))
    return F.when(said.startswith("good"), "good").when(said.startswith("poor"), "poor").otherwise(plain)


def retriever_hits(rankings: dict[str, DataFrame], relevant: DataFrame, k: int) -> DataFrame:
    """(retriever, n, hits): how many queries have a relevant document among their k best, for several rankings (query_id, id, rank)."""
    out = None
    for name, ranking in rankings.items():
        part = ranking.filter(F.col("rank") <= k).select(F.lit(name).alias("retriever"), "query_id", "id")
        out = part if out is None else out.unionByName(part)
    hit = out.join(relevant.select("query_id", "id").withColumn("relevant", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("retriever", "query_id").agg(F.max(F.coalesce("relevant", F.lit(0))).alias("hit")).groupBy("retriever").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
