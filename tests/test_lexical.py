"""BM25's best by the two passes, against all scores."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical, retrieval

WORDS = "red green blue the of 7 42 Ünï 猫 狗 x".split()
DOCS = [(i, " ".join(WORDS[(i * k + k * k) % len(WORDS)] for k in range(i % 9))) for i in range(60)] + [(60 + i, "red blue the the 7") for i in range(12)] + [(72, None), (73, "")]
DOCS += [DOCS[5]]
ASKED = [(1, "red blue"), (2, "the the of 猫"), (3, "nothing here"), (4, ""), (5, None), (6, "7 42 red x")]


@pytest.mark.parametrize("okapi", [False, True])
def test_best_of_all_scores(spark, monkeypatch, okapi):
    """Ties, copies, texts without tokens, queries without hits, and two rows of one id; blocks of one document too."""
    docs, asked = spark.createDataFrame(DOCS[: -1 if okapi else None], "doc_id long, text string").repartition(3), spark.createDataFrame(ASKED, "query_id int, query string")
    every = retrieval.bm25_scores(docs, asked, okapi=okapi).withColumn("score", F.bround("score", 6))
    want = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in retrieval.top_k(every, ["query_id"], "score", "id", 5).collect())
    for scores in (lexical.SCORES, 1):
        monkeypatch.setattr(lexical, "SCORES", scores)
        got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in retrieval.bm25_top(docs, asked, 5, okapi=okapi).collect())
        assert got == want
    assert len({q for q, *_ in want}) == 3


def test_queries_too_large_to_send_are_joined(spark, monkeypatch):
    docs, asked = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ASKED, "query_id int, query string")
    few = sorted(map(str, retrieval.bm25_top(docs, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 1)
    assert sorted(map(str, retrieval.bm25_top(docs, asked, 3).collect())) == few


def test_scores_of_all_pairs_are_not_shuffled(spark):
    """What is shuffled are each task's best; before, it was every document for every query."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("red blue").alias("text"))
    asked = spark.createDataFrame([(i, "red") for i in range(20)], "query_id int, query string")
    plan = retrieval.bm25_top(docs.repartition(2), asked, 5)
    assert plan.count() == 100
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in text and text.count("MapInArrow") >= 1


def test_hashed_buckets_are_the_same_when_forgotten(monkeypatch):
    from siltstone.functions import python

    once = python.hash_embedder()(["a b c a", "c d 7"])
    monkeypatch.setattr(python, "BUCKETS_KEPT", 1)
    assert python.hash_embedder()(["a b c a", "c d 7"]) == once
