"""Scores of order three against a recursion over plain counts, whatever the blocks and however long the texts."""

import math
import random
import zlib
from collections import Counter

import pytest

from siltstone.llm import ngramlm


def made():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocabulary[: rng.randint(2, 40)]) for _ in range(rng.randint(0, 50))) for _ in range(90)]
    texts += [texts[3], texts[3], None, "", " ", "w1 " * 3000, " ".join(rng.choice(vocabulary) for _ in range(60_000))]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2"), (None, "w1 w2")]


@pytest.mark.parametrize("block_bytes", [1500, None])
def test_trigram_scores(spark, block_bytes):
    rows = made()
    docs = spark.createDataFrame([(i, t, True, 1, 2, 3) for i, t in rows], "doc_id long, text string, train boolean, c0 int, block int, part int")
    got = ngramlm.score_documents(docs, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    seq = lambda t: [*(t or "").split(), None]
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, t in rows:
        if train(i):
            s = ["<s>", *seq(t)]
            uni.update(s[1:])
            bi.update(zip(s[:-1], s[1:], strict=True))
            tri.update(zip(s[:-2], s[1:-1], s[2:], strict=True))
    total, distinct = sum(uni.values()), len(uni)
    starts = uni[None]
    mass = lambda c: ngramlm.MASS * c**ngramlm.GROWTH

    def p(w, v=None, u=None):
        if v is None:
            return (uni[w] + 0.5) / (total + 0.5 * (distinct + 1))
        if u is None:
            c = starts if v == "<s>" else uni[v]
            return (bi[v, w] + mass(c) * p(w)) / (c + mass(c)) if c else p(w)
        c = bi[u, v]
        return (tri[u, v, w] + mass(c) * p(w, v)) / (c + mass(c)) if c else p(w, v)

    want = {}
    for i, t in rows:
        s = ["<s>", *seq(t)]
        want[i] = sum(math.log10(p(s[k], s[k - 1], s[k - 2] if k > 1 else None)) for k in range(1, len(s)))
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9), r
        assert r["train_tokens"] == total
    for u, v in [("w1", "w2"), ("<s>", "w3")]:
        assert math.isclose(sum(p(w, v, u) for w in uni) + p("never", v, u), 1.0, rel_tol=1e-9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngramlm.score_documents(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = ngramlm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert only["train_tokens"] == 0 and only["score"] == 0.0
