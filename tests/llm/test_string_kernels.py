"""Every labelled language is learned, whatever its number, copies or length; letters are told apart."""

import random
import zlib

import numpy as np

from siltstone.llm import langid

HELD = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 == 1]
FREE = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]


def run(spark, train, held):
    """Accuracy on held (text, lang) pairs after learning from train pairs."""
    rows = [(i, t, c, 0, 0) for i, (t, c) in zip(FREE, train, strict=False)] + [(i, t, c, 0, 0) for i, (t, c) in zip(HELD, held, strict=False)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, c0 int, h int")).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    return sum(got[i]["lang_pred"] == c for i, (_, c) in zip(HELD, held, strict=False)) / len(held)


def speech(rng, letters):
    syllables = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)]
    return lambda n: " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))


def test_seventy_languages(spark):
    rng = random.Random(1)
    say = {f"l{k:02}": speech(rng, "abcdefghijklmnopqrstuvwxyz") for k in range(70)}
    pairs = lambda n: [(f(40), c) for c, f in say.items() for _ in range(n)]
    assert run(spark, pairs(6), pairs(2)) > 0.97


def test_copies_only_and_long_texts_only(spark):
    rng = random.Random(2)
    a, b, c = (speech(rng, "abcdefghijklmnop") for _ in range(3))
    copy = b(60)
    train = [(a(40), "aa") for _ in range(60)] + [(copy, "bb")] * 900 + [(c(4000), "cc") for _ in range(4)]
    assert run(spark, train, [(a(40), "aa"), (copy + " x", "bb"), (c(30), "cc"), (b(60), "bb")] * 5) == 1.0


def test_letters_of_one_residue_are_told_apart(spark):
    rng = random.Random(3)
    letters = [chr(x) for x in range(0x0430, 0x0440)]
    far = [chr(ord(x) + 36) for x in letters]
    pattern = [rng.sample(range(16), 3) for _ in range(10)]
    word = lambda own: " ".join("".join(own[k] for k in rng.choice(pattern)) for _ in range(30))
    pairs = [(word(letters), "x") for _ in range(30)] + [(word(far), "y") for _ in range(30)]
    assert run(spark, pairs, pairs) == 1.0


def test_grams_by_brute_force():
    for text in ("", "a", "Ab, cd!  12", "日本語 テキスト", "é🙂é", "नमस्ते"):
        symbols, last = ["\0"], None
        for ch in text.lower():
            s = ch if ch.isalpha() or ch in "े्" else "0" if ch.isdigit() else "\0"
            if s != "\0" or last != "\0":
                symbols.append(s)
            last = s
        symbols.append("\0")
        want = {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)} if text else set()
        assert len(langid.gram_set(text)) == len(want), text
        assert (np.diff(langid.gram_set(text).astype(object)) > 0).all()


def test_empty_table(spark):
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
