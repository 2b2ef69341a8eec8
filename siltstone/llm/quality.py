"""Quality filtering by weak supervision.

Each rule votes a text good or bad, or abstains.  Expectation-maximisation over the
counts of vote patterns estimates how often each rule votes what for good and for bad
texts, and the posterior probability of being good replaces all-must-pass filtering.

There are at most 3 ** len(RULES) vote patterns whatever the corpus, so the model is
fitted on exact counts of all documents with one small aggregation, and a text's posterior
is looked up by its pattern.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import written

REPEAT_WINDOW = 8
#: Where estimation starts, and the ranges that hold rules to "right more often than not": on good texts a
#: rule seldom objects; on bad texts a rule that speaks may miss what it wasn't made for.
START, START_SHARE = 0.8, 0.8
RANGE = ((0.90, 0.999), (0.25, 0.999))
SHARE_RANGE = (0.05, 0.99)
#: Texts with fewer words, or with a larger percentage of repeated words, fail outright.
LEAST_WORDS, MOST_REPEATED = 20, 30
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Name, measure, and bounds: below / from which the vote is bad, and from / up to which it is good; None: no such vote.
RULES = (
    # name, measure, bad below, bad from, good from, good up to
    ("length", "n_words", 20, None, 50, None),
    ("word_length", "mean_length", 2.0, 14.0, None, None),
    ("symbols", "symbol_share", None, 0.05, None, None),
    ("symbol_words", "symbols_per_word", None, 0.15, None, None),
    ("letters", "letter_share", 0.80, None, 0.90, None),
    ("capitals", "capital_share", None, 0.40, None, 0.15),
    ("shouting", "bangs_per_word", None, 0.20, None, None),
    ("lines", "dup_line_share", None, 0.30, None, None),
    ("repeats", "repeat_share", None, 0.25, None, None),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_bangs")


def _classes() -> np.ndarray:
    """Bits for each byte: 1 starts a character in a word, 2 symbol, 4 letter, 8 capital, 16 exclamation mark."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if b & 0xC0 != 0x80 and b != 0x20 and not 9 <= b <= 13:
            out[b] |= 1
        if chr(b) in "#*$%&|<>":
            out[b] |= 2
        if b < 128 and chr(b).isalpha() or b >= 0xC0:
            out[b] |= 4
        if 65 <= b <= 90:
            out[b] |= 8
        if b == 33:
            out[b] |= 16
    return out


_CLASS = _classes()


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of entries whose key occurs twice or more, and of those that aren't a key's first."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    any_ = again.copy()
    any_[order[:-1][same]] = True
    return any_, again


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The MEASURES of every text."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    starts, ends, bounds = tk.word_spans(data, offsets)
    row = tk.rows_of(bounds)
    h = tk.span_hashes(data, starts, ends)
    out = {"n_words": np.diff(bounds), "word_chars": _sums(kind & 1, offsets), "n_symbols": _sums(kind & 2, offsets) // 2, "n_letters": _sums(kind & 4, offsets) // 4, "n_capitals": _sums(kind & 8, offsets) // 8, "n_bangs": _sums(kind & 16, offsets) // 16}
    w = tk.window_hashes(h, REPEAT_WINDOW)
    at = np.flatnonzero(row[: len(w)] == row[REPEAT_WINDOW - 1 :]) if len(w) else np.zeros(0, np.int64)
    any_, _ = _repeated(tk.mix(w[at] + row[at].astype(np.uint64) * np.uint64(tk.BYTE_BASE))) if len(at) else (np.zeros(0, bool), None)
    change = np.zeros(len(h) + 1, np.int64)
    change[at[any_]] += 1
    change[at[any_] + REPEAT_WINDOW] -= 1
    out["n_repeat_words"] = _sums(np.cumsum(change[:-1]) > 0, bounds)
    # lines: cut at \n and at the ends of texts; only those with a word count
    cut = np.flatnonzero(data == 10)
    begins = np.sort(np.r_[offsets[:-1], cut + 1])
    stops = np.sort(np.r_[offsets[1:], cut])
    line_row = np.searchsorted(offsets[1:], stops, "left") if n else np.zeros(0, np.int64)
    words_in = np.searchsorted(starts, stops) - np.searchsorted(starts, begins)
    keep = words_in > 0
    begins, stops, line_row = begins[keep], stops[keep], np.searchsorted(offsets, begins[keep], "right") - 1
    out["n_lines"] = np.bincount(line_row, minlength=n)
    if len(begins):
        key = tk.mix(tk.span_hashes(data, begins, stops) + line_row.astype(np.uint64) * np.uint64(tk.BYTE_BASE))
        _, again = _repeated(key)
        out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    return out


def _measured(batches):
    for rows, data, offsets in tk.text_pieces(batches, piece_bytes=1 << 17):
        found = measure(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])


def _votes() -> Column:
    """The vote pattern as a number in base 3."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "n_words": F.col("n_words"), "mean_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars, "symbols_per_word": F.col("n_symbols") / words, "letter_share": F.col("n_letters") / chars,
        "capital_share": F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1)), "bangs_per_word": F.col("n_bangs") / words, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
    }
    pattern: Column = F.lit(0)
    for _, name, bad_below, bad_from, good_from, good_upto in RULES:
        x = shares[name]
        bad, good = F.lit(False), F.lit(False)
        for bound, test in ((bad_below, x < F.lit(bad_below)), (bad_from, x >= F.lit(bad_from))):
            bad = bad if bound is None else bad | test
        for bound, test in ((good_from, x >= F.lit(good_from)), (good_upto, x <= F.lit(good_upto))):
            good = good if bound is None else good | test
        pattern = pattern * 3 + F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    return pattern.cast("int")


def fit_votes(counts: dict[int, int], n_rules: int, rounds: int = 200) -> dict[int, float]:
    """Pattern -> posterior probability of good, by EM with a prior that rules are right more often than not."""
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns], float)
    votes = np.stack([(patterns // 3 ** (n_rules - 1 - j)) % 3 for j in range(n_rules)], axis=1)
    onehot = np.eye(3)[votes]  # pattern, rule, vote (BAD, GOOD, ABSTAIN)
    spoke = onehot[:, :, :2].sum(2)
    agrees = onehot[:, :, GOOD]
    right = np.full((2, n_rules), START)  # P(vote is right | rule speaks), for good and for bad texts
    share = START_SHARE
    posterior = np.full(len(n), share)
    for _ in range(rounds):
        good = math.log(share) + (agrees * np.log(right[0]) + (spoke - agrees) * np.log(1 - right[0])).sum(1)
        bad = math.log(1 - share) + ((spoke - agrees) * np.log(right[1]) + agrees * np.log(1 - right[1])).sum(1)
        new = 1.0 / (1.0 + np.exp(np.clip(bad - good, -500, 500)))
        done = float(np.abs(new - posterior).max()) < 1e-10
        posterior = new
        if done:
            break
        for c, w, hit in ((0, posterior * n, agrees), (1, (1 - posterior) * n, spoke - agrees)):
            right[c] = np.clip((w @ hit + 8 * START) / (w @ spoke + 8), *RANGE[c])
        share = float(np.clip(((posterior * n).sum() + 8 * START_SHARE) / (n.sum() + 8), *SHARE_RANGE))
    return {int(p): START_SHARE if math.isnan(x) else float(x) for p, x in zip(patterns, posterior, strict=True)}


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the MEASURES, base_failed, votes (the pattern), posterior and kept.

    kept is false if base_failed, else whether the posterior reaches the threshold.  Null and empty
    texts have no words and fail.  Repeated rows are judged alike; other columns are ignored; an
    empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    found = written(own.mapInArrow(_measured, schema).withColumn("votes", _votes()), "measures")
    counts = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** len(RULES)
    posterior = fit_votes(counts, len(RULES))
    table = docs.sparkSession.createDataFrame(list(posterior.items()), "votes int, posterior double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.join(F.broadcast(table), "votes", "left").withColumn("posterior", F.coalesce("posterior", F.lit(START_SHARE))).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).select("doc_id", *MEASURES, "base_failed", "votes", "posterior", "kept")
