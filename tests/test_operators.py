import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, cleaning, context, evaluation, governance, graph, retrieval, state
from siltstone.plans import jobs
from siltstone.sources import files, parsers
from siltstone.streaming import jobs as streams


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_sections_keep_paths_and_tail():
    got = list(chunking.sections("intro\n# A\nx\n## B\ny\n# C\ntail"))
    assert [(p, t) for p, _, t in got] == [("", "intro"), ("A", "x"), ("A > B", "y"), ("C", "tail")]
    assert [p for p, _, _ in chunking.sections("一、总则\n内容\n# X\nz")] == ["一、总则", "X"]


def test_table_header_is_repeated():
    table = "| h |\n|---|\n" + "\n".join(f"| {i} |" for i in range(5))
    got = list(chunking.table_pieces("# T\n" + table + "\nafter", rows=2))
    assert [k for _, k, _ in got] == ["table"] * 3 + ["text"]
    assert all(t.startswith("| h |\n|---|\n") for _, k, t in got if k == "table")


def test_split_long_respects_limit_and_overlap():
    text = ". ".join(f"sentence number {i}" for i in range(60))
    got = chunking.split_long(text, 200, 20)
    assert all(len(x) <= 260 for x in got) and "sentence number 59" in got[-1] and len(got) > 3


def test_heading_windows_legacy_tail():
    text = "# A\nx\n# B\ny"
    assert [t for _, _, t in chunking.heading_windows(text)] == ["x", "y"]
    assert [t for _, _, t in chunking.heading_windows(text, legacy_drop_tail=True)] == ["x"]


def test_parents_link(spark):
    df = spark.createDataFrame([("d", "# H\n" + "word " * 500)], "doc_id string, text string")
    out = chunking.split_parents(df)
    parents = {r["chunk_id"] for r in out.filter("chunk_type = 'parent'").collect()}
    assert parents and {r["parent_id"] for r in out.filter("chunk_type = 'child'").collect()} <= parents


def test_manifest_diff_and_deletions(spark):
    listed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "")], "source_id string, change_key string")
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", ""), ("d", "4")], "source_id string, change_key string")
    assert rows(state.manifest_diff(listed, known, True), "source_id", "change_type") == [("a", "unchanged"), ("b", "changed"), ("c", "changed"), ("d", "deleted")]
    assert ("d", "deleted") not in rows(state.manifest_diff(listed, known, False), "source_id", "change_type")


def test_versioned_table(spark, tmp_path):
    t = state.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"])
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])
    assert rows(t.read(), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_admission_matches_loop(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = [(rng.choice("ab"), start + dt.timedelta(minutes=i * 37), float(rng.randint(1, 9))) for i in range(200)]
    got = {(r["key"], r["ts"]): r["admitted"] for r in governance.admit(spark.createDataFrame(data, "key string, ts timestamp, amount double"), 60).collect()}
    for key in "ab":
        kept = []
        for _, at, x in [e for e in data if e[0] == key]:
            used = sum(v for t, v in kept if t >= at - dt.timedelta(days=1))
            if used + x <= 60:
                kept.append((at, x))
            assert got[key, at] == ((at, x) in kept)


def test_admission_stream_matches_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + dt.timedelta(hours=i), 3.0) for i in range(40)], "key string, ts timestamp, amount double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "key string, ts timestamp, amount double")
    q = streams.admitted_stream(stream, 10.0).writeStream.format("memory").queryName("adm").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("adm"), "ts", "admitted") == rows(governance.admit(df, 10.0), "ts", "admitted")


def test_ingest_stream_is_idempotent(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        q = streams.ingest_stream(streams.file_stream(spark, str(tmp_path / "in"), "id long"), lambda df, n: seen.append(df.count()), str(tmp_path / "c"))
        q.awaitTermination(120)
    assert sum(seen) == 5


def test_token_bucket(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", start + dt.timedelta(seconds=s)) for s in (0, 0, 0, 1, 5)], "key string, ts timestamp")
    assert [r["allowed"] for r in streams.token_bucket(df, 2, 0.5).orderBy("ts").collect()] == [True, True, False, False, True]


def test_folds_stream_through_null_keys_and_small_batches(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(k, start + dt.timedelta(minutes=7 * i), 1.0) for i in range(300) for k in ("a", None)]
    data += [("a", None, 1.0), ("a", start, None)]
    df = spark.createDataFrame(data, "key string, ts timestamp, amount double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = governance.admit(df, 50.0).collect()
        tokens = streams.token_bucket(df, 2, 1 / 840).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(tokens) == len(data)
    for key in ("a", None):
        timed = sorted((r["ts"], r["admitted"]) for r in got if r["key"] == key and r["ts"] and r["amount"])
        kept = []
        for at, ok in timed:
            assert ok == (sum(t >= at - dt.timedelta(days=1) for t in kept) + 1 <= 50)
            kept += [at] * ok
    assert [r["admitted"] for r in got if r["ts"] and r["amount"] is None] == [False]
    assert governance.admit(df.filter("false"), 1.0).count() == 0
    free = [r["allowed"] for r in sorted((r for r in tokens if r["key"] is None), key=lambda r: r["ts"])]
    assert free[:2] == [True, True] and 0.45 < sum(free) / len(free) < 0.55


@pytest.mark.parametrize("at_once", [100_000, 50])
def test_value_at_equals_sorting(spark, at_once):
    rng = random.Random(4)
    data = [(rng.choice([1.0, 2.0, rng.random() * 5, rng.gauss(0, 100), None]),) for _ in range(3000)] + [(7.0,)] * 900
    df = spark.createDataFrame(data, "v double").repartition(4)
    want = sorted(v for (v,) in data if v is not None)
    n = len(want)
    for place in (0, 1, n // 2, int(0.95 * n), n - 1):
        assert evaluation.value_at(df, "v", place, n, at_once) == want[place]
    assert evaluation.value_at(df, "v", n, n) is None
    empty = evaluation.dashboard(df.filter("false"), "v", F.lit(False)).first()
    assert empty["n"] == 0 and empty["p50"] is None and empty["p95"] is None


def test_near_duplicates_found(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(300)]
    near = list(base)
    near[100] = "other"
    far = [rng.choice(words) for _ in range(300)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base)), (5, ""), (6, None)], "id long, t string")
    got = {(r["later"], r["earlier"]) for r in cleaning.near_duplicate_pairs(df, "id", "t").collect()}
    assert {(2, 1), (4, 1)} <= got and not any(3 in p for p in got)


def test_packing_skips_and_continues(spark):
    items = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(t).alias("tokens")) for n, t in (("a", 5), ("b", 90), ("c", 4), ("d", 2))])
    got = spark.range(1).select(context.greedy_pack(items, 10).alias("x")).first()["x"]
    assert [r["id"] for r in got] == ["a", "c"]
    assert spark.range(1).select(context.ends_first(F.array(*map(F.lit, range(5)))).alias("x")).first()["x"] == [0, 4, 1, 3, 2]


def test_best_attempt(spark):
    df = spark.createDataFrame([(1, 0, True, []), (1, 1, False, ["a"]), (1, 2, False, ["b"]), (2, 0, True, []), (2, 1, True, [])], "query_id int, attempt int, abstained boolean, citations array<string>")
    assert rows(context.best_attempt(df), "query_id", "attempt") == [(1, 1), (2, 1)]


def test_wikilinks_and_hops(spark):
    docs = spark.createDataFrame([("a", "[[b]] [[zz]]"), ("b", "[[c|name]]"), ("c", "")], "name string, text string")
    edges = graph.wikilinks(docs, "name", "text")
    assert rows(edges, "src", "dst") == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert rows(graph.within_hops(edges, spark.createDataFrame([("a",)], "node string"), 2), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple"), (3, "pear")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "apple")], "query_id long, query string")
    assert [r["id"] for r in retrieval.bm25_scores(docs, q).orderBy(F.desc("score")).collect()] == [2, 1]


def test_gate_and_grouping(spark):
    floors = spark.createDataFrame([("p", "m", 0.5), ("p", "x", 0.5), ("p", "protected_path_leakage", 0.0)], "project string, metric string, floor double")
    got = spark.createDataFrame([("p", "m", 0.4), ("p", "protected_path_leakage", 0.1)], "project string, metric string, value double")
    assert rows(evaluation.gate(got, floors), "metric", "issue") == [("m", "below"), ("protected_path_leakage", "above"), ("x", "missing")]


def test_expected_blocks(spark):
    e = spark.createDataFrame([("f", "text", None, ["ab"], [], None, 1), ("f", "table", "2", [], ["h"], 1, None)], "file string, block_type string, page string, keywords array<string>, headers array<string>, min_rows int, min_chars int")
    b = spark.createDataFrame([("f", "text", "1", "xxabxx", [], []), ("f", "table", "2", "", ["h"], [["1"]])], "file string, block_type string, page string, text string, headers array<string>, rows array<array<string>>")
    assert rows(evaluation.expected_blocks_found(e, b), "block_type", "found") == [("table", True), ("text", True)]


def test_html_parser_and_dead_letters(spark):
    page = b"<nav>no</nav><h1>T</h1><p>a <b>b</b></p><table><tr><th>x</th><th>y</th></tr><tr><td>1</td></tr></table><img alt='pic'>"
    df = spark.createDataFrame([("u", "html", page), ("v", "nope", b"")], "uri string, source_format string, raw binary")
    got = {r["block_type"]: r for r in parsers.parse_blocks(df).filter("error is null").collect()}
    assert got["heading"]["text"] == "T" and got["text"]["text"] == "a b" and got["table"]["rows"] == [["1"]] and got["image"]["text"] == "pic"
    assert parsers.parse_blocks(df).filter("error is not null").count() == 1


def test_file_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\nsensitivity: internal\n---\nbody")
    (tmp_path / "y.bin").write_text("no")
    recs = files.file_records(spark, str(tmp_path)).collect()
    assert [(r["source_id"], r["source_format"]) for r in recs] == [("fs:a/x.md", "markdown")]
    got = files.markdown_documents(spark, str(tmp_path)).first()
    assert got["doc_id"] == "x" and got["meta"] == {"sensitivity": "internal"} and got["body"] == "body"


def test_wiki_and_registry(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"id": "1", "title": "t", "version": {"number": 3, "by": {"displayName": "n"}}, "metadata": {"labels": {"results": [{"name": "acl-hr"}, {"name": "Confidential"}]}}, "body": {"storage": {"value": "<p>x</p>"}}}]}))
    r = files.wiki_pages(spark, str(tmp_path / "p.json")).first()
    assert (r["source_id"], r["etag"], r["acl_principals"], r["sensitivity"]) == ("confluence:1", "v3", ["acl-hr"], "restricted")
    (tmp_path / "t.json").write_text(json.dumps({"acme": {"plan": "team", "custom_quota": {"max_tokens_per_day": 5}}}))
    q = governance.tenant_quotas(files.tenant_registry(spark, str(tmp_path / "t.json")), governance.plans(spark)).first()
    assert (q["max_queries_per_day"], q["max_tokens_per_day"]) == (5000, 5)


def test_concatenated_json():
    assert files.concatenated_json('{"a":1}\n\n{"b":\n2} ') == [{"a": 1}, {"b": 2}]


def test_python_units(spark):
    df = spark.createDataFrame([("m.py", 'class A:\n    """doc"""\n    def f(self, x=1):\n        pass\n'), ("bad.py", "def (")], "uri string, text string")
    assert rows(parsers.python_units(df).filter("kind <> 'module'"), "kind", "name", "signature") == [("class", "A", "class A"), ("method", "f", "f(self, x=1)")]


INDEX = "chunk_id string, source_id string, text string, sensitivity string, tenant_id string, embedding array<float>"
MANIFEST = "source_id string, change_key string, last_seen_run string, chunk_count long, tenant_id string"


def test_ingest_then_answer(spark):
    docs = [(f"d{i}", f"k{i}", f"# Topic {i}\nThe answer to question number {i} is value{i} and it is long enough to keep.", "public") for i in range(6)]
    listed = spark.createDataFrame(docs, "source_id string, change_key string, text string, sensitivity string")
    first = jobs.ingest(listed, spark.createDataFrame([], MANIFEST), spark.createDataFrame([], INDEX), "acme", "r1")
    index, manifest = jobs.cut(first.index), jobs.cut(first.manifest)
    assert index.count() == 6 and manifest.count() == 6
    again = jobs.ingest(listed.filter("source_id <> 'd0'"), manifest, index, "acme", "r2")
    assert rows(again.counts, "change_type", "n") == [("deleted", 1), ("unchanged", 5)]
    assert again.index.count() == 5 and again.manifest.count() == 5
    reply = lambda p: '{"answer": "value3", "citations": ["E1"], "abstained": false}'
    got = jobs.answer(jobs.Session(spark, "acme"), index, spark.createDataFrame([("q", "question number 3 value3")], "query_id string, query string"), reply).first()
    assert got["answer"] == "value3" and not got["abstained"] and got["retrieved"]
    with pytest.raises(ValueError):
        jobs.Session(spark, "").visible(index)
