"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Equal fingerprints are folded first, so copies cost nothing.  Two different
fingerprints within `radius` bits agree on at least one of radius + 1 bands of
bits, so only fingerprints of one band cell are compared: cells are cut into
tiles, sorted by bit count, and each pair of tiles is compared whole with
numpy's exclusive-or and bit counts, unless their bit counts differ by more than
the radius.  Nothing is missed and nothing is sampled.  A cell larger than
CELL_ROWS is dealt to several tasks, a task for each pair of its parts.

A task returns, for the rows it compared, links to the least member of each
local component: every link's connection is kept without listing all pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import written

TILE = 1024
#: Rows of one band cell that a task compares among themselves; larger cells are dealt out in pairs of parts.
CELL_ROWS = 16_384
#: Fingerprints for one task of the comparison, on average.
TASK_ROWS = 200_000
HASH_SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    count = len(words) - width + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), dtype="<u8", count=count)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 16):
        part = h[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > count, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return run


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, for edges a-b among 0 .. n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect all fingerprints within radius: of left, or between left and right."""
    own = right is None
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if own else right[np.argsort(np.bitwise_count(right), kind="stable")]
    base = 0 if own else len(left)
    pop_l, pop_r = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    found_a, found_b = [], []
    for i in range(0, len(left), TILE):
        tile = left[i : i + TILE]
        low, high = pop_l[i] - radius, pop_l[min(i + TILE, len(left)) - 1] + radius
        for j in range(i if own else 0, len(right), TILE):
            if pop_r[j] > high:
                break
            other = right[j : j + TILE]
            if pop_r[min(j + TILE, len(right)) - 1] < low:
                continue
            near = np.bitwise_count(tile[:, None] ^ other[None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            if own:
                keep = x < y
                x, y = x[keep], y[keep]
            if len(x):
                label = _settle(len(tile) + len(other), x - i, y - j + len(tile)) if not (own and i == j) else _settle(len(tile), x - i, y - j)
                node = np.flatnonzero(label != np.arange(len(label)))
                to_row = lambda k: np.where(k < len(tile), k + i, k - len(tile) + j + base)
                found_a.append(to_row(node))
                found_b.append(to_row(label[node]))
    if not found_a:
        return np.zeros(0, left.dtype), np.zeros(0, left.dtype)
    values = left if own else np.concatenate([left, right])
    return values[np.concatenate(found_a)], values[np.concatenate(found_b)]


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        side = table.column("side").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(cell, kind="stable")
        cell, side, fp = cell[order], side[order], fp[order]
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(cell)]
        out_a, out_b = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            rows, of = fp[s:e], side[s:e]
            if (of == 0).all():
                a, b = tile_links(rows, None, radius)
            else:
                a, b = tile_links(rows[of == 1], rows[of == 2], radius)
            out_a.append(a)
            out_b.append(b)
        a = np.concatenate([np.zeros(0, np.uint64), *out_a]).view(np.int64)
        b = np.concatenate([np.zeros(0, np.uint64), *out_b]).view(np.int64)
        return pa.table({"a": a, "b": b})

    return run


def links_within(prints: DataFrame, radius: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints fp (long) within radius bits."""
    bands = radius + 1
    width = -(-64 // bands)
    mask = (1 << width) - 1
    rows = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask)).alias("value")) for i in range(bands)])).alias("x")).select("fp", "x.*")
    # at most bands * 2 ** width cells, whatever the number of fingerprints
    cells = written(rows.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    n_dealt = cells.agg(F.coalesce(F.sum(F.col("n") * F.ceil(F.col("n") / cell_rows)), F.lit(0))).first()[0]
    rows = rows.join(cells, ["band", "value"])
    parts = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    rows = rows.withColumns({"parts": parts, "own": own})
    pair = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.withColumn("other", pair).select(
        "fp",
        F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    tasks = max(8, -(-int(n_dealt) // TASK_ROWS))
    return dealt.withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int")).repartition(tasks, "task").groupBy("task").applyInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lower-case hex digits), component_id.

    component_id is the smallest doc_id reachable over links of radius bits or fewer, the
    row's own included; null ids are passed over unless a component has no other.  Null,
    empty and blank texts have fingerprint zero, linked like any other.  Repeated rows give
    repeated results; other columns of docs are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    prints = written(own.mapInArrow(_fingerprints(width), f"doc_id {id_type}, fp long"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links_within(distinct.select("fp"), radius))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = member.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
