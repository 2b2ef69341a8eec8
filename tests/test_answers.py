"""Judges, metadata, assistants, similar pairs, near duplicates, lineage: small cases with nulls and empties."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import python
from siltstone.operators import assistant, chunking, cleaning, evaluation, judging, lineage, records, retrieval
from siltstone.plans import jobs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_judged_metrics(spark):
    df = spark.createDataFrame([(1, "q one", "a fact. b lie", ["a fact here", "else"], "a fact"), (2, "q", "", [], ""), (3, "q", "x y", None, "x y")], "id int, question string, answer string, contexts array<string>, ground_truth string")
    judge = lambda s, e: F.when(F.contains(e, s), "1").otherwise("0")
    assert rows(judging.faithfulness(df, judge), "id", "faithfulness") == [(1, 0.5), (2, 0.0), (3, 0.0)]
    assert rows(judging.context_precision(df, judge), "id", "context_precision") == [(1, 0.5), (2, 0.0), (3, 0.0)]
    assert rows(judging.context_recall(df, judge), "id", "context_recall") == [(1, 1.0), (2, 0.0), (3, 0.0)]
    by_model = judging.judge_by(lambda p: "4/5" if "q one" in p else 1 / 0, "Score it.")
    assert rows(judging.answer_relevancy(df, by_model), "id", "answer_relevancy") == [(1, 0.8), (2, 0.0), (3, 0.0)]
    assert rows(judging.evaluate_answers(df, {"faithfulness": judge}), "metric", "value") == [("faithfulness", 0.1667)]
    said = spark.createDataFrame([("- one\n- two\nunsupported: 1",), ("nothing",), (None,)], "s string").select(judging.unsupported_rate(F.col("s")).alias("r"))
    assert sorted(x["r"] for x in said.collect()) == [0.0, 0.0, 0.5]


def test_rewrites_grades_and_reranking(spark):
    q = spark.createDataFrame([(1, "how to x"), (2, "")], "query_id int, query string")
    got = rows(judging.rewritten(q, lambda p: "a\n\n b " if "how" in p else "", "multi-query", ""), "query_id", "number", "query")
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "")]
    with pytest.raises(ValueError):
        judging.rewritten(q, str, "other", "")
    g = spark.createDataFrame([("red car", "a red one"), ("red car", "blue"), ("red", "")], "q string, e string")
    assert [r[0] for r in g.select(judging.graded(F.col("q"), F.col("e"))).collect()] == ["good", "poor", "poor"]
    assert [r[0] for r in g.select(judging.graded(F.col("q"), F.col("e"), lambda a, b: F.lit("Good!"))).collect()] == ["good"] * 3


def test_metadata(spark):
    df = spark.createDataFrame([(1, "s", 3, "h", "t", {"a": "x", "tenant_id": "forged", "n": None})], "chunk_id int, source_id string, ordinal int, author string, tenant_id string, metadata map<string,string>")
    got = df.select(records.chunk_metadata(df, ("author", "source_id")).alias("m")).first()["m"]
    assert got == {"chunk_id": "1", "source_id": "s", "ordinal": "3", "author": "h", "a": "x", "tenant_id": "t"}
    m = spark.createDataFrame([({"a": ["1", "2"], "b": None},), ({},)], "m map<string,array<string>>").select(records.scalar_metadata(F.col("m")).alias("m"))
    assert [r["m"] for r in m.collect()] == [{"a": "1|2"}, {"_": ""}]


def test_loose_redaction(spark):
    text = "tel 13812345678 id 110101199001011234 mail a.b@c.org ip 10.0.0.1 api_key=abcdefghijklmnopqrstuvwx mysql://u:p@h/d"
    df = spark.createDataFrame([(text, "public"), ("plain", "internal"), (None, "public")], "t string, base string")
    got = [tuple(r) for r in df.select(assistant.loosely_redacted(F.col("t")), assistant.loose_sensitivity(F.col("t"), F.col("base"))).collect()]
    assert got[0] == ("tel *******5678 id **************1234 mail [EMAIL] ip [EMAIL] [REDACTED] [REDACTED]", "restricted")
    assert got[1:] == [("plain", "internal"), (None, "public")]


def test_similar_pairs_are_all_there(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 8)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = sorted((i, j) for i, j in itertools.combinations(range(60), 2) if round(float(unit[i] @ unit[j]), 6) >= 0.5)
    for tile_rows in (7, 1000):
        assert rows(retrieval.similar_pairs(df, 0.5, tile_rows=tile_rows), "a", "b") == want


def test_shingles_of_any_script():
    assert python.shingle_list("One two three four five six") == ["one two three four five", "two three four five six"]
    assert python.shingle_list("中文 字符测试") == ["中文字符测", "文字符测试"]
    assert python.shingle_list("Привет!") == ["приве", "ривет", "ивет!"]
    assert python.shingle_list(None) == python.shingle_list("") == []


def test_near_duplicates_in_any_script_and_their_recall(spark):
    rng = random.Random(8)
    letters = "абвгдежзиклмнопрст"
    russian = [" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(40)) for _ in range(3)]
    data = [(i, t) for i, t in enumerate([*russian, russian[0], "", None, "!!"])]
    words = [f"w{k}" for k in range(2000)]
    for k in range(40):
        base = [rng.choice(words) for _ in range(250)]
        near = list(base)
        for at in rng.sample(range(250), rng.randint(1, 3)):
            near[at] = "other"
        data += [(100 + 2 * k, " ".join(base)), (101 + 2 * k, " ".join(near))]
    got = {(r["later"], r["earlier"]) for r in cleaning.near_duplicate_pairs(spark.createDataFrame(data, "id long, t string"), "id", "t", threshold=0.8).collect()}
    assert {p for p in got if p[0] < 100} == {(3, 0)}
    sets = {i: set(python.shingle_list(t)) for i, t in data if i >= 100}
    close = {(a + 1, a) for a in range(100, 180, 2) if len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) >= 0.88}
    assert len(close) > 20 and len(close & got) >= 0.9 * len(close) and all(a - b == 1 for a, b in got if b >= 100)


def test_no_piece_is_over_the_limit():
    text = "x" * 9401 + ". " + "short one. " * 40 + "\n\n" + "y" * 500 + "\n\n" + "z" * 50
    got = chunking.split_long(text, 600, 80)
    assert max(map(len, got)) <= 600 and sum(p.count("x") for p in got) >= 9401 and got[-1].endswith("z" * 50)
    assert chunking.split_long("", 600, 80) == [] and chunking.split_long("a", 600, 80) == ["a"]


def test_faq_tickets_and_tenants(spark):
    faq = spark.createDataFrame([(1, "how to pay", "pay"), (2, "how to log in", "account")], "id int, question string, intent string")
    q = spark.createDataFrame([(1, "pay how", "pay"), (2, "log in", "none"), (3, None, "pay")], "query_id int, query string, intent string")
    assert rows(assistant.faq_top(q, faq, 1), "query_id", "id", "score") == [(1, 1, 2), (2, 2, 2), (3, 1, -1)] or rows(assistant.faq_top(q, faq, 1), "query_id", "id") == [(1, 1), (2, 2), (3, 1)]
    t = assistant.tickets(spark.createDataFrame([("u", "紧急 help", "x"), ("u", "hm", "x")], "user_id string, text string, intent string"))
    assert rows(t, "severity") == [("P0",), ("P2",)]
    used = assistant.refunded_usage(spark.createDataFrame([("a", 5.0)], "k string, amount double"), spark.createDataFrame([("a", 7.0)], "k string, amount double"), "k")
    assert rows(used, "k", "used") == [("a", 0.0)]


def test_question_scores(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, ["a"], []), (3, [], []), (4, ["x"], ["a", "b"])], "i int, retrieved array<string>, relevant array<string>")
    assert rows(evaluation.question_scores(df), "i", "retrieval_recall", "retrieval_correct", "hit") == [(1, 1.0, True, True), (2, 0.0, False, False), (3, 1.0, True, False), (4, 0.0, False, False)]


def test_runs_are_written(spark, tmp_path):
    listed = spark.createDataFrame([("a", "k", "a text that is long enough to be kept in the index", "public"), ("b", "k", "no", "public")], "source_id string, change_key string, text string, sensitivity string")
    done = jobs.ingest(listed, spark.createDataFrame([], "source_id string, change_key string, last_seen_run string, chunk_count long, tenant_id string"), spark.createDataFrame([], "chunk_id string, source_id string, text string, sensitivity string, tenant_id string, embedding array<float>"), "acme", "r1")
    jobs.write_run(done, str(tmp_path / "runs"), "r1")
    assert rows(spark.read.json(str(tmp_path / "runs" / "dead_letters")), "source_id", "stage", "run_id") == [("b", "quality", "r1")]
    report = spark.read.json(str(tmp_path / "runs" / "reports")).first()
    assert (report["run_id"], report["new"], report["dead_letters"], report["chunks"]) == ("r1", 2, 1, 1)


def test_spread_and_cut(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long").coalesce(1)
    assert lineage.spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = df.repartition(64, "id")
    assert lineage.spread(many, "id") is many and lineage.cut(df).count() == 10
