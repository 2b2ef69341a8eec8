"""What the operators must not lose: near copies, classes, templates, leaks."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, htmlextract, langid, nearcopies


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_rows():
    """Texts of 8 to 400 words with changed words, cut ends and inserted passages; exact copies, empty and short ones."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (8, 30, 50, 100, 200, 400) for _ in range(4)]
    for t in list(texts):
        for edits in (1, 2, 4, 8):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        w = t.split()
        texts.append(" ".join(w[: len(w) - len(w) // 8]))
    texts += [texts[3].upper(), texts[0], "", "  ", None, "one", "One", "a b c d", "a b c d e"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = []
    for a in sets:
        for b in sets:
            if a < b and (s := jaccard(sets[a], sets[b])) >= 0.8:
                similar.append(s)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}, similar


@pytest.mark.parametrize("part_rows", [1024, 2])
def test_near_copies_equal_brute_force(spark, part_rows):
    rows = near_rows()
    want, similar = brute_groups(rows)
    assert sum(0.8 <= s < 0.85 for s in similar) >= 5 and sum(0.85 <= s < 0.95 for s in similar) >= 15
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs, part_rows=part_rows).collect()}
    assert got == want
    assert nearcopies.near_copies(docs.filter("false")).count() == 0


def test_pipeline_stage_removes_near_copies(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want, _ = brute_groups(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {i for i, r in want.items() if i == r}


def test_bands_reach_similarity_point_eight():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):  # 80 of 100 shingles are in both
        own = rng.integers(0, 2**63, 100, dtype=np.uint64)
        a, b = np.sort(own[:90]), np.sort(own[10:])
        bands = nearcopies.band_hashes(np.r_[a, b], np.array([0, 90, 180]))
        missed += not (bands[0] == bands[1]).any()
    assert missed == 0


def test_op5_learns_every_language(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    data = []
    for k in range(70):  # more languages than CLASSES
        own = [a + b + c for a, b, c in zip(rng.sample(letters, 12), rng.sample(letters, 12), rng.sample(letters, 12), strict=True)]
        data += [(f"l{k:02}", " ".join(rng.choice(own) for _ in range(40))) for _ in range(5)]
    data += [("long", " ".join(rng.choice(["ñaña", "ßeß", "éçé"]) for _ in range(6000))) for _ in range(3)]  # all over 20,000 characters
    rows = spark.createDataFrame(data, "lang string, text string")
    copies = spark.range(0, 200_000, 1, 4).select(F.concat(F.lit("copies"), F.col("id") % 5).alias("lang"), F.concat(F.lit("zq xj "), F.repeat(F.lit("wv "), (F.col("id") % 10 + 1).cast("int")), F.lit("kk")).alias("text"))
    model = langid.fit_languages(rows.unionByName(copies))
    assert model.classes == sorted({lang for lang, _ in data} | {f"copies{k}" for k in range(5)})
    found = model.predict([t for _, t in data])[0]
    assert sum(a == b for a, (b, _) in zip(found, data, strict=True)) >= 0.95 * len(data) and found[-1] == "long"


@pytest.mark.parametrize("pages, padding", [(3, 0), (4, 60_000), (12, 60_000)])
def test_op2_template_of_small_hosts_and_long_pages(spark, pages, padding):
    page = lambda i: f"<body><p>Welcome to our site</p><p>News {i} of the day</p><script>{'x' * padding}</script><p>All rights belong to us</p></body>"
    data = [(i, "http://h.example/", page(i)) for i in range(pages)] + [(99, "http://one.example/", page(99))]
    got = {r["page_id"]: r["text"] for r in htmlextract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(pages)} == {i: f"News {i} of the day" for i in range(pages)} and "News 99 of the day" in got[99]


def test_op3_items_side_by_side(spark):
    rng = random.Random(21)
    common = ["the", "of", "and", "to", "in"]
    vocabulary = [f"w{i}x" for i in range(3000)]
    sentence = lambda k: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(k)]
    items = [sentence(n) for n in (8, 9, 10, 12, 14, 16, 20, 26, 27, 40, 52, 60) for _ in range(8)]
    other = lambda w: [rng.choice(vocabulary) if j % 3 == 1 and j < len(w) - 5 else x for j, x in enumerate(w)]
    texts = []
    for i in range(120):  # dumps: verbatim items in a row, or paraphrases with their answers between two of them
        some = rng.sample(range(len(items)), 5)
        texts.append(sum([other(items[k]) if i % 3 == 0 and n % 2 else items[k] for n, k in enumerate(some)], sentence(10 if i % 2 else 0)))
    texts += [sentence(200) for _ in range(40)]
    # brute force: all windows of the items' lengths and a quarter more
    want = set()
    for i, w in enumerate(texts):
        for k, item in enumerate(items):
            if len(set(item) & set(w)) >= decontaminate.PARAPHRASE * len(set(item)):
                n = len(item) + len(item) // 4
                if any(decontaminate.check_words(item, w[a : a + n])[2] for a in range(max(1, len(w) - n + 1))):
                    want.add((i, k))
    assert len(want) >= 560
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    # an unrelated text may have an item's frequent words in order by chance; all planted items must be found
    assert {x for x in want if x[0] < 120} <= got and len(want - got) <= 1 and len(got - want) <= 5
