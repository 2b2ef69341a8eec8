"""Counting terms of texts, and adding up their weights for many queries, on Arrow batches in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .nearest import _Best, _ids, _units

K1, B = 1.5, 0.75
#: Texts that are Python strings at once, and scores of documents and queries at once.
TEXTS, SCORES = 64, 1 << 17
_TOKEN = re.compile("[A-Za-z]+|[0-9]+|[一-鿿]")


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def count_terms(codes: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (id, dl, codes, tfs): the number of all tokens, and of those that have a code the codes in order and how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            lengths, offsets, found, counts = [], [0], [], []
            for part in pieces(batch.select(["text"]), TEXTS):
                for t in part.column(0).to_pylist():
                    toks = _TOKEN.findall(t)
                    seen: dict[int, int] = {}
                    for c in map(codes.get, toks):
                        if c is not None:
                            seen[c] = seen.get(c, 0) + 1
                    own = sorted(seen)
                    found += own
                    counts += [seen[c] for c in own]
                    lengths.append(len(toks))
                    offsets.append(len(found))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32()), type=ints), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()), type=ints)],
                ["id", "dl", "codes", "tfs"],
            )

    return run


def best_by_terms(weights: list[tuple], query_type: pa.DataType, terms: int, avgdl: float, k: int, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, dl, codes, tfs), sorted by id, to (query_id, id, score): each query's k best by BM25.  weights: (code, query id, times asked, idf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(dict.fromkeys(q for _, q, _, _ in weights))
        number = {q: n for n, q in enumerate(names)}
        rows = sorted((c, number[q], qtf, idf) for c, q, qtf, idf in weights)
        code, query, qtf, idf = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
        start = np.searchsorted(code, np.arange(terms + 1))
        many = np.diff(start)  # queries that have a term
        best, place, id_of = _Best(len(names), k, digits), 0, None
        step = max(1, SCORES // max(1, len(names)))
        for batch in batches:
            id_of = batch.schema.field("id").type
            ids = _ids(batch.column("id"))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n, lists, tf = part.num_rows, part.column("codes"), part.column("tfs").flatten().to_numpy().astype(float)
                c, dl = lists.flatten().to_numpy(), part.column("dl").to_numpy().astype(float)
                doc = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
                times = many[c]
                item = np.repeat(start[c] - np.cumsum(times) + times, times) + np.arange(times.sum())  # rows of weights for each term found
                cell = query[item] * n + np.repeat(doc, times)
                score = np.bincount(cell, qtf[item] * (idf[item] * np.repeat(share, times)), len(names) * n).astype(float)
                score[np.bincount(cell, minlength=len(names) * n) == 0] = -np.inf  # no term shared
                block = score.reshape(len(names), n)
                p = np.flatnonzero((block >= best.limits(slice(None), block, 0)[:, None]) & (block > -np.inf))
                best.add(p // n, _units(score[p], digits), p % n + place, ids[at + p % n])
                if not best.full.all():
                    best.merge()
                place += n
        if id_of is not None:
            best.merge()
            q, units, _, found = best.kept
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in q], query_type), pa.array(found, id_of), pa.array(units / 10.0**digits)], ["query_id", "id", "score"])

    return run

