"""Wrapper induction on made hosts: foreign class names, deep markup, tree matching against brute force."""

import random

from siltstone.llm import domtree, htmlextract

SCHEMA = "page_id long, url string, html string, host string, slot string"


def site(host, i, rng, classes):
    """A page of a host without any telling element but p and h1, and its article."""
    word = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(k))
    paragraphs = [word(rng.randint(15, 60)) for _ in range(rng.randint(3, 8))]
    title = word(5)
    menu = "".join(f"<li><a href='/{k}'>{word(1)}</a></li>" for k in range(rng.randint(3, 7)))
    comments = "".join(f"<div><b>{word(1)}</b><p>{word(8)}</p></div>" for _ in range(rng.randint(0, 4)))
    body = "".join(f"<p>{p}</p>" if k % 3 else f"<p>{p}</p><blockquote><p>{p[:20]}</p></blockquote>" for k, p in enumerate(paragraphs))
    lines = [title] + [x for k, p in enumerate(paragraphs) for x in ([p] if k % 3 else [p, p[:20].strip()])]
    html = f"<html><body><div class='{classes[0]}'><ul>{menu}</ul></div><div class='{classes[1]}'>{word(9)}</div><h1>{title}</h1><div class='{classes[2]}'>{body}</div><div class='{classes[3]}'>{comments}</div><div>Alle Rechte {host}</div></body></html>"
    return html, "\n".join(lines)


def test_foreign_class_names(spark):
    """No name here is on the list: what goes, goes by its slot."""
    rng = random.Random(6)
    rows, want = [], {}
    for h in range(4):
        for i in range(1 + 6 * h):
            html, text = site(f"h{h}", i, rng, ("navi", "werbung", "inhalt", "kommentare"))
            rows.append((len(rows), f"https://h{h}.example/{i}", html, "x", "y"))
            want[len(rows) - 1] = text
    got = {r["page_id"]: r["text"] for r in htmlextract.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    exact = sum(got[k] == want[k] for k in want)
    assert exact == len(want), [(got[k], want[k]) for k in want if got[k] != want[k]][:2]


def test_names_inside_an_article_stay(spark):
    pages = ["<article><h1>T</h1><p class='social'>one</p><section class='discussion'><p>two</p></section><article>a reader</article></article>", "<div class='search-results-article'>only</div>", "<div>" * 10_000 + "deep", "<div class='cookie-notice'>cookies</div><main><p>text</main>"]
    rows = [(i, None, p, "x", "y") for i, p in enumerate(pages)] + [(2, None, pages[2], "x", "y")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmlextract.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "T\none\ntwo", 9), (1, "only", 4), (2, "deep", 4), (2, "deep", 4), (3, "text", 4)]
    assert htmlextract.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_page_is_whole(spark):
    body = "".join(f"<p>paragraph {i} &lt;of&gt; many</p>" for i in range(20_000))
    rows = [(i, "http://l.example/", f"<nav>m</nav><article><h1>{i}</h1>{body}{i}</article>", "x", "y") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in htmlextract.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == "\n".join([str(i), *(f"paragraph {k} <of> many" for k in range(20_000)), str(i)]) for i in got) and len(got) == 2


def brute(a, b):
    """Most pairs of a top-down, order-keeping matching, by trying all ways."""
    if a.tag != b.tag:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute(xs[0], ys[0]) + best(xs[1:], ys[1:]))

    return 1 + best(a.children, b.children)


def test_matching_is_the_best_there_is():
    rng = random.Random(3)

    def tree(depth):
        node = domtree.Node(rng.choice("ab"))
        last = None
        for _ in range(rng.randint(0, 3) if depth else 0):
            kid = tree(depth - 1)
            if domtree.dumped(kid) != last:  # runs of equal children are one by definition
                node.children.append(kid)
            last = domtree.dumped(kid)
        return node

    for _ in range(150):
        a, b = tree(3), tree(3)
        a.tag = b.tag = "r"
        shapes = domtree.Shapes()
        assert shapes.score(shapes.of(a), shapes.of(b)) == brute(a, b)
        whole = domtree.merged(shapes, [a, b])
        shapes.of(whole)
        for t in (a, b):  # the merged tree holds both
            assert domtree.dumped(domtree.loaded(domtree.dumped(t))) == domtree.dumped(t)
            assert shapes.score(whole.shape, t.shape) >= shapes.score(a.shape, b.shape)
