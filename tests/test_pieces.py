"""Passes over texts whose memory doesn't grow with a batch, and words that are counted where their text is."""

import zlib
from collections import Counter

import pyarrow as pa

from siltstone.functions import python, text
from siltstone.operators import chunking, retrieval


def held(df, monkeypatch, texts):
    """The longest batch that the pass of a plan gives for a batch of all texts, in characters."""
    passes = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, *a, **b: passes.append(f) or self)
    return passes, pa.RecordBatch.from_pydict({"source_id": [str(i) for i in range(len(texts))], "text": texts})


def test_parents_and_chunks_come_in_bounded_batches(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    texts = ["One two three four. " * 400] * 800  # each makes many times its length, all in one batch
    for make in (lambda: chunking.split_parents(df), lambda: chunking.split(df, "layout")):
        with monkeypatch.context() as m:
            passes, batch = held(df, m, texts)
            try:
                make()
            except Exception:  # the columns made aren't there, since the pass is only caught
                pass
        sizes = [b.nbytes for b in passes[0](iter([batch]))]
        assert len(sizes) > 3 and max(sizes) < 4 * python.CHARS_AT_ONCE


def test_rows_in_pieces_are_all_there(monkeypatch):
    monkeypatch.setattr(python, "CHARS_AT_ONCE", 50)
    make = lambda i, t: ((i, w) for w in (t or "").split())
    batches = [pa.RecordBatch.from_pydict({"i": list(range(n)), "t": [None if i % 7 == 3 else f"a{i} b c" for i in range(n)]}) for n in (0, 1, 130)]
    got = [(r["i"], r["w"]) for b in python.in_pieces(make, "i long, w string")(iter(batches)) for r in b.to_pylist()]
    assert got == [(i, w) for n in (1, 130) for i in range(n) if i % 7 != 3 for w in (f"a{i}", "b", "c")]


def test_grams_among_some_are_those_of_all():
    for t in (None, "", "a b", "A b c d e f, g h a b c d", "x " * 30):
        every = python.word_grams(t, 4)
        some = frozenset(zlib.crc32(g.encode()) for g in every[::2])
        assert python.word_grams(t, 4, some) == every[::2] and python.word_grams(t, 4, frozenset()) == []


def test_keywords_of_rows_that_share_an_id(spark):
    """Rows of one id (null too) are one document; others are counted where they are, and no word is shuffled."""
    rows = [(1, "the cat sat, cat AND dog"), (2, None), (3, "dog dog owl"), (3, "owl owl emu dog"), (None, "elk elk yak"), (None, "yak yak"), (4, "ab cd"), (5, "zebra yak xerus wolf vole urial zebra")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = {}
    for i, t in rows:
        words.setdefault(i, []).extend(w for w in (t or "").lower().replace(",", " ").split() if len(w) > 2 and w not in text.KEYWORD_STOPS)
    got = retrieval.keyword_top(df, "doc_id", "text", text.KEYWORD_STOPS)
    assert {(r["id"], r["term"], r["n"]) for r in got.collect() if r["id"] not in (3,)} == {(i, w, n) for i, ws in words.items() if i != 3 for w, n in Counter(ws).most_common(5)}
    assert sorted((r["term"], r["n"]) for r in got.filter("id = 3").collect()) == [("dog", 3), ("emu", 1), ("owl", 3)]
    assert [r["term"] for r in got.filter("id = 5").orderBy("rank").collect()] == ["zebra", "yak", "xerus", "wolf", "vole"]
    once = retrieval.keyword_top(df.filter("doc_id <> 3"), "doc_id", "text", text.KEYWORD_STOPS)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
