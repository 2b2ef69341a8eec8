"""Nearest and farthest vectors and similar pairs against plain loops, and their size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import nearest as kernel
from siltstone.operators import retrieval

SCHEMA = "id long, v array<float>"


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot, x, y = sum(p * q for p, q in zip(a, b, strict=True)), sum(p * p for p in a), sum(p * p for p in b)
    return round(dot / (math.sqrt(x) * math.sqrt(y) + 1e-9), 6) + 0.0


def expected(rows, near, far, but_self):
    out = []
    for q, v in [r for r in rows if r[0] % 3 == 0]:
        all_ = [(cosine(w, v), i) for i, w in rows if not (but_self and i == q)]
        for sign, k in ((1, near), (-1, far)):
            best = sorted(all_, key=lambda x: (x[0] is None, -sign * (x[0] or 0), x[1]))[:k]
            out += [(sign < 0, q, i, n + 1, None if s is None else sign * s + 0.0) for n, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def vectors(n, copies):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, [1.0, 0.5, 0.0, 0.0, 0.25, -1.0]) for i in range(copies)]
    odd = [None, [], [0.0] * 6, [1e-6, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    return rows + [(n + copies + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize("but_self", [True, False])
@pytest.mark.parametrize(("tile", "block"), [(4 << 20, (256, 2048)), (700, (3, 5)), (400, (64, 40))])
def test_nearest_and_farthest(spark, monkeypatch, but_self, tile, block):
    """Ties, copies, null, empty, short and tiny vectors, several tiles, streams and blocks."""
    monkeypatch.setattr(kernel, "QUERY_TILE_BYTES", tile)
    monkeypatch.setattr(kernel, "LEAST_ROWS", 20)
    monkeypatch.setattr(kernel, "BLOCK", block)
    rows = vectors(60, 25)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = retrieval.nearest(df, df.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 4, 3, but_self)
    got = sorted([(r["far"], r["query_id"], r["id"], r["rank"], r["score"]) for r in out.collect()], key=str)
    assert got == expected(rows, 4, 3, but_self)


def test_scores_are_rounded_by_their_decimal_form():
    import numpy as np

    assert kernel._units(np.array([0.0000005, 0.0000015, -0.0000025, 0.1234565, float("nan")]), 6).tolist() == [0.0, 2.0, -2.0, 123456.0, float("inf")]


def test_pairs_of_many_tiles_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(kernel, "BLOCK", (7, 5))
    monkeypatch.setattr(kernel, "PAIRS_OUT", 50)
    rows = vectors(50, 20)
    want = sorted((a, b, s) for a, v in rows for b, w in rows if a < b and (s := cosine(v, w)) is not None and s >= 0.6)
    df = spark.createDataFrame(rows, SCHEMA)
    for tile_rows in (9, 1000, None):
        assert sorted((r["a"], r["b"], r["score"]) for r in retrieval.similar_pairs(df, 0.6, tile_rows=tile_rows).collect()) == want


def test_what_travels_for_pairs_grows_as_the_table():
    """A row goes once to each tile and once more; tiles of 2,000 rows made that a square."""
    assert [kernel.pair_tiles(n, n * 64 * 8) for n in (100, 100_000, 600_000, 2_000_000)] == [1, 10, 10, 31]


def test_queries_of_one_label_do_not_meet_all_of_it(spark, tmp_path):
    """Metrics count the rows of a label; they don't list them for each query."""
    from siltstone import catalog

    rows = [(i, [float(i % 7), 1.0, float(i % 11)], 1) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog._rankings(spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(r["n_relevant"] == 399 and len(r["relevant"]) == 10 for r in got)
