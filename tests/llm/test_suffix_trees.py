"""Suffix order, common prefixes and deep nodes against brute force; blocks of null ids."""

import random

import numpy as np

from siltstone.llm import blocks, suffixtrees


def test_suffixes_and_nodes():
    rng = random.Random(11)
    for _ in range(60):
        strings = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 9))]
        lengths = np.array([len(s) for s in strings])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        order, lcp = suffixtrees.suffix_order(np.array([x for s in strings for x in s]), starts, lengths)
        suffixes = [(s[k:] + [100 + i], k) for i, s in enumerate(strings) for k in range(len(s))]
        got = [suffixes[i][0] for i in order]
        assert got == sorted(x for x, _ in suffixes)
        shared = lambda a, b: next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
        assert lcp[1:].tolist() == [shared(a, b) for a, b in zip(got, got[1:], strict=False)]
        for depth in (1, 2, 4):
            want = {}
            for at, s in enumerate(got):
                if len(s) > depth:
                    want.setdefault(tuple(s[:depth]), []).append(at)
            first, stop = suffixtrees.deep_nodes(lcp, depth)
            assert sorted((v[0], v[-1] + 1) for v in want.values() if len(v) > 1) == sorted(zip(first.tolist(), stop.tolist(), strict=True))


def test_keys_survive_narrowing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (blocks.widened(blocks.narrow(keys)) == keys).all()


def test_null_ids_are_spread(spark):
    rows = spark.range(0, 100_000, 1, 8).selectExpr("cast(null as long) as doc_id", "concat('text ', pmod(hash(id), 10)) as text")
    texts, n = blocks.blocked(rows, "doc_id", "text", block_bytes=100_000)
    counts = [r["count"] for r in texts.groupBy("block").count().collect()]
    assert sum(counts) == 100_000 and n > 50 and max(counts) < 20_000
    got = suffixtrees.remove_repeats(rows.limit(300), block_bytes=2_000)
    assert got.count() == 300
