"""The operators against brute-force versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from siltstone.llm import bwtmerge, bytebpe, decontaminate, domtree, htmlextract, langid, ngramlm, quality, sharding, simhash, suffixtrees
from siltstone.llm import textkernel as tk
from siltstone.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n long, block long, part long, fp long, html string, host string"


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = sentence(60)
    texts = [sentence(rng.randint(0, 120)) for _ in range(n)]
    texts += [sentence(20) + " " + shared + "\n" + sentence(5), shared, sentence(9) + "\t" + shared, texts[0], texts[0], texts[3] + " ", "", None, "   ", "x", "ab " * 400, "z" * 3000, texts[1].upper(), "日本語 テキスト 🙂 " * 3, "a\x00b c\x0bd"]
    near = texts[5].split()
    if near:
        near[len(near) // 2] = "changed"
    texts.append(" ".join(near))
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    data = [(i, t, "en", 1, 2, 3, 4, "h", "o") for i, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df if extra else df.select("doc_id", "text")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).persist()


def test_kernels_agree_with_python():
    texts = ["a  b\tc", "", "é ü", " x ", "日本"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    starts, ends, bounds = tk.word_spans(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [words(t) for t in texts]
    h = tk.span_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len({w for t in texts for w in words(t)})
    same = tk.window_hashes(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    assert same[0] == same[3] and len(set(same.tolist())) == 3


def test_op1_scores(docs, rows):
    got = {r["doc_id"]: r for r in ngramlm.score_documents(docs, block_bytes=3000, order=2).collect()}
    seqs = {i: [*words(lower(t)), None] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in seqs}
    uni, bi = Counter(), Counter()
    for i, s in seqs.items():
        if not out[i]:
            uni.update(s)
            bi.update(zip(["start", *s[:-1]], s, strict=True))
    total, distinct = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (total + 0.5 * (distinct + 1))

    def q(v, w):
        c = uni[None] if v == "start" else uni[v]
        m = ngramlm.MASS * c**ngramlm.GROWTH
        return (bi[v, w] + m * p(w)) / (c + m) if c else p(w)

    assert len(got) == len(rows)
    for i, s in seqs.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(s), sum(uni[w] > 0 for w in s), total)
        assert math.isclose(r["base_score"], sum(math.log10(p(w)) for w in s), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(q(v, w)) for v, w in zip(["start", *s[:-1]], s, strict=True)), rel_tol=1e-9)
    some = [w for w, _ in uni.most_common(5)]
    for v in some:  # the arcs and the failure arc of a state sum to one over the vocabulary and the unknown word
        assert math.isclose(sum(q(v, w) for w in uni) + q(v, "never seen"), 1.0, rel_tol=1e-9)


def brute_windows(rows, width=13):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("long_prefix", [50_000, 0])
def test_op4_windows(docs, rows, monkeypatch, long_prefix):
    monkeypatch.setattr(suffixtrees, "LONG_PREFIX_AT", long_prefix)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffixtrees.remove_repeats(docs, output="sha256", block_bytes=4000).collect()}
    assert got == brute_windows(rows)


def test_op4_text_and_carried_columns(spark, docs, rows):
    out = suffixtrees.remove_repeats(docs, carry=["block", "part"])
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["block"] == 2 and r["part"] == 3 for r in got.values())
    assert all(got[i]["kept_text"] == t for i, t in rows if got[i]["n_removed"] == 0)
    assert suffixtrees.remove_repeats(docs.filter("false")).count() == 0


def brute_bytes(rows, width):
    count, out = Counter(), {}
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        count.update(b[k : k + width] for k in range(len(b) - width + 1))
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_op8_bytes(docs, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwtmerge.remove_repeated_bytes(docs, output="sha256", block_bytes=4000).collect()}
    assert got == brute_bytes(rows, 200)


def test_op8_merge_is_exact():
    rng = random.Random(2)
    for width in (3, 6, 7):
        strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(width, 30))) for _ in range(25)})
        got = bwtmerge.repeated_windows([np.frombuffer(s, np.uint8) for s in strings], width, shard_bytes=60)
        count = Counter(s[k : k + width] for s in strings for k in range(len(s) - width + 1))
        assert [g.tolist() for g in got] == [[count[s[k : k + width]] > 1 for k in range(len(s) - width + 1)] for s in strings]


def test_op5_languages(spark):
    rng = random.Random(4)
    kinds = {"xx": ["the", "ing", "ton", "ver"], "yy": ["des", "ei", "schö", "ung"], "zz": ["ción", "ña", "los", "que"]}
    data = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        data.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(2)) for _ in range(rng.randint(8, 60))), lang if i % 7 else None))
    data += [(1000, None, "xx"), (1001, "123 !!", "yy"), (1002, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    assert held and all(got[i]["lang_pred"] == sorted(kinds)[i % 3] for i in held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(df.withColumn("lang", df["lang"].substr(100, 1)).filter("lang is null")).collect()
    assert {r["lang_pred"] for r in none} <= {"und"}


def test_op6_measures_and_votes(docs, rows):
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    for i, t in rows:
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = set()
        for k in range(len(w) - 7):
            if count[tuple(w[k : k + 8])] > 1:
                repeated |= set(range(k, k + 8))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op6_em_finds_the_odd_rule():
    def pattern(*votes):
        out = 0
        for v in votes:
            out = out * 3 + v
        return out

    good, bad = pattern(1, 1, 2, 1), pattern(0, 0, 0, 1)
    post = quality.fit_votes({good: 900, bad: 80, pattern(2, 2, 2, 2): 20}, 4)
    assert post[good] > 0.9 and post[bad] < 0.1


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("cell_rows", [16_384, 2])
def test_op7_components(spark, docs, rows, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash.links_within, "__defaults__", (2, cell_rows))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {}
    for i, t in rows:
        w = [x.encode() for x in words(lower(t))]
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints, 2)


def test_op7_tiles_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64))
    left, right = np.unique(base), np.unique(np.r_[near, base[:3]])
    a, b = simhash.tile_links(left, right, 2)
    own = np.unique(np.r_[left, right])
    c, d = simhash.tile_links(own, None, 2)
    want = brute_components({int(x): int(x) for x in own}, 2)
    root = {int(x): int(x) for x in own}
    for x, y in [*zip(c.tolist(), d.tolist(), strict=True)]:
        assert (x ^ y).bit_count() <= 64
        rx, ry = x, y
        while root[rx] != rx:
            rx = root[rx]
        while root[ry] != ry:
            ry = root[ry]
        root[max(rx, ry)] = min(rx, ry)
    find = lambda x: x if root[x] == x else find(root[x])
    assert {x: find(x) for x in root} == want and len(a) == len(b) >= 12


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_op9_equals_tiktoken(docs, rows):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bytebpe.parse_ranks(bytebpe.read_ranks(path))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bytebpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        assert got[i]["ids"] == known.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode() and got[i]["n_tokens"] == len(got[i]["ids"])
    bpe = bytebpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("aab 'é\n1🙂z") for _ in range(rng.randint(0, 60)))
        assert bpe.encode(t) == known.encode_ordinary(t)


def test_op10_shards(docs, rows):
    got = {r["doc_id"]: r for r in sharding.assign_shards(docs, 5).collect()}
    size = {i: len((t or "").encode()) + 8 for i, t in rows}
    assert all(got[i]["size"] == size[i] and got[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in rows)
    by_text, slots, load = {}, {}, Counter()
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i]["shard"])
        slots.setdefault(got[i]["shard"], []).append(got[i]["slot"])
        load[got[i]["shard"]] += size[i]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(size.values())
    assert sharding.assign_shards(docs.filter("false"), 3).count() == 0


def test_op10_longest_first():
    assert sharding.longest_first({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


PAGE = "<html><head><title>{t}</title><style>p{{}}</style></head><body><nav><a href=x>menu {i}</a></nav><div class='ad big'>buy {i}</div><div class=note>Same everywhere</div><article><h1>{t}</h1><p>First &amp; <b>bold</b>  text {i}<br><p>Second {i}</article><div id=comments><p>me too</p></div><footer>f {i}</footer><script>var a='</p>';</script></body></html>"


def test_op2_pages(spark):
    data = [(i, f"http://Host{i % 2}.example/p{i}", PAGE.format(i=i, t=f"Title {i}"), 1) for i in range(40)]
    data += [(90, None, None, 1), (91, "x", "", 1), (92, "http://one.example", "plain <p>only", 1), (93, "http://host0.example/q", data[0][2].replace("<article>", "<main>").replace("</article>", "</main>"), 1), (94, data[0][1], data[0][2], 1)]
    got = {r["page_id"]: r for r in htmlextract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string, wrapper long")).collect()}
    assert len(got) == len(data)
    for i in range(40):
        assert got[i]["text"] == f"Title {i}\nFirst & bold text {i}\nSecond {i}" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "plain\nonly" and got[93]["text"] == got[94]["text"] == got[0]["text"]


def test_op2_template_of_pages_without_article(spark):
    data = [(i, "http://h.example/", f"<body><p>Welcome to our site</p><p>News {i} of the day</p><p>All rights belong to us</p></body>") for i in range(15)]
    got = {r["page_id"]: r["text"] for r in htmlextract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {i: f"News {i} of the day" for i in range(15)}


def test_op2_tree_matching():
    shapes = domtree.Shapes()
    a = domtree.read_tree("<div><ul><li>1<li>2</ul><p>x</p></div>")
    b = domtree.read_tree("<div><h1>t</h1><ul><li>1</ul><p>y</p></div>")
    assert shapes.score(shapes.of(a), shapes.of(b)) == 5  # html, div, ul, li, p


def test_op3_leaks(spark):
    rng = random.Random(8)
    common = ["the", "of", "and", "to", "in"]
    vocabulary = [f"w{rng.randint(0, 10**6)}x" for _ in range(3000)]
    sentence = lambda k: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(sentence(rng.randint(14, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "too short item")]
    data, want = [], set()
    for i in range(160):
        w = sentence(rng.randint(20, 400))
        if i % 4 == 0:
            k = rng.randrange(40)
            leak = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: every seventh word another
                leak = [rng.choice(vocabulary) if j % 7 == 3 else x for j, x in enumerate(leak)]
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() for x in leak] if i % 16 == 4 else leak
            want.add((i, k))
        data.append((i, " ".join(w), 5))
    data += [(500, None, 5), (501, "", 5), (502, "so a too short item here", 5), (503, "too item short", 5)]
    want.add((502, 92))
    docs = spark.createDataFrame(data, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _, _ in data} - {d for d, _ in want}
    assert decontaminate.find_leaks(docs, bench.filter("false")).count() == 0 and decontaminate.find_leaks(docs.filter("false"), bench).count() == 0
