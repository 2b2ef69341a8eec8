"""Near copies by SimHash, tiled comparison and exact Jaccard similarity of word shingles.

1. Each text is the set of its word shingles.  Texts with equal sets are folded first.
2. A set's fingerprint has BITS bits; a bit is 1 if set in over half of the shingles' hashes.  Sets of
   Jaccard similarity s differ in about BITS * arccos(2s / (1 + s)) / pi bits, 39 of 256 at 0.8; other sets
   in 128.  Fingerprints within a radius well above that are candidates.
3. So wide a radius leaves no bits that all candidates must share, so cells are bands of bits drawn at
   random, as many as lose a pair with probability LOST (band_plan).  Within a cell all fingerprints are
   compared in tiles, by exclusive-or and bit counts.  A cell larger than CELL_ROWS is dealt to several
   tasks, a task for each pair of its parts.
4. Within the components of the candidates' links the sets themselves are compared: every pair that is not
   connected yet is counted exactly, through an index of the group's shingles.  A group of more than
   PART_ROWS texts or PART_SHINGLES shingles is dealt to several tasks likewise.

Tasks return links that connect all pairs of the wanted similarity without listing them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .blocks import gathered
from .components import connected_components
from .shared import given_back, written
from .simhash import _settle

#: Bits of a fingerprint.
BITS = 256
#: Probability that a pair of the wanted similarity shares no band.
LOST = 1e-7
#: Standard deviations of two such fingerprints' distance that the radius leaves.
ROOM = 7
#: Fingerprints that are compared with one another at once.
TILE = 256
#: In larger cells, so many fingerprints at most are compared with all others first; what they link isn't compared again.
LEADERS = 16
#: Fingerprints of one cell that a task compares among themselves, and those for one task on average.
CELL_ROWS, TASK_ROWS = 16_384, 200_000
#: Texts and shingles of a candidate group that a task compares among themselves.
PART_ROWS, PART_SHINGLES = 1_024, 1 << 20
#: Shingles for one task of the comparison, on average.
TASK_SHINGLES = 2 << 20
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, BITS // 64, dtype=np.uint64)
#: The eight bits of a byte as the bytes of a number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_PRINT = [f"f{k}" for k in range(BITS // 64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the rows' bounds; a text of fewer words is one shingle."""
    starts, ends, bounds = tk.word_spans(data, offsets)
    h = tk.span_hashes(data, starts, ends)
    length = np.diff(bounds)
    row, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for words in range(1, width + 1):
        own = np.flatnonzero(length >= words if words == width else length == words)
        if len(own):
            found, at = gathered(tk.window_hashes(h, words), bounds[own], bounds[own + 1] - words + 1)
            row.append(np.repeat(own, np.diff(at)))
            grams.append(found)
    row, grams = np.concatenate(row), np.concatenate(grams)
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return grams[first], np.searchsorted(row[first], np.arange(len(length) + 1))


def set_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set; 0 for the empty set."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(tk.mix(grams), out=total[1:])
    return tk.mix(total[bounds[1:]] - total[bounds[:-1]])


def fingerprints(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x BITS / 64: the SimHash of each row's set; zero for the empty set."""
    out = np.zeros((len(bounds) - 1, BITS // 64), np.uint64)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    # runs of at most 128 shingles are added up in bytes, eight bits' counts in one addition
    runs = -(-size[full] // 128)
    first = np.r_[0, np.cumsum(runs)]
    starts = np.repeat(bounds[:-1][full], runs) + 128 * (np.arange(first[-1]) - np.repeat(first[:-1], runs))
    ends = np.r_[starts[1:], bounds[-1]]
    counts = np.empty((len(starts), BITS), np.uint8)
    for at in range(0, len(starts), 256):
        to = min(at + 256, len(starts))
        own = grams[starts[at] : ends[to - 1]]
        hashes = np.stack([tk.mix(own ^ seed) for seed in _SEEDS], axis=1).astype("<u8")
        ones = _SPREAD[hashes.view(np.uint8)]
        counts[at:to] = np.add.reduceat(ones, starts[at:to] - starts[at], axis=0).view(np.uint8)
    for at in range(0, len(full), 1024):
        rows = first[at : at + 1025]
        total = np.add.reduceat(counts[rows[0] : first[min(at + 1024, len(full))]].astype(np.int32), first[at : min(at + 1024, len(full))] - rows[0], axis=0)
        own = full[at : at + 1024]
        out[own] = np.packbits(2 * total > size[own][:, None], axis=1, bitorder="little").view("<u8")
    return out


def agreement(similarity: float) -> float:
    """The share of bits in which fingerprints of this Jaccard similarity agree."""
    return 1 - float(np.arccos(min(1.0, 2 * similarity / (1 + similarity)))) / np.pi


def radius_of(similarity: float) -> int:
    """Differing bits up to which fingerprints are candidates."""
    own = 1 - agreement(similarity)
    return int(BITS * own + ROOM * np.sqrt(BITS * own * (1 - own)))


def band_plan(n: int, similarity: float = 0.8) -> np.ndarray:
    """bands x width places of bits, for n fingerprints: cells of about the square root of n."""
    width = max(8, round(np.log2(max(1, n)) / 2))
    shared = min(agreement(similarity), 0.99) ** width
    bands = int(np.ceil(np.log(LOST) / np.log1p(-shared)))
    rng = np.random.default_rng(13)
    return np.concatenate([rng.permutation(BITS) for _ in range(-(-bands * width // BITS))])[: bands * width].reshape(bands, width)


def band_cells(prints: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """rows x bands: the band's number and the fingerprint's bits in it."""
    bands, width = plan.shape
    ones = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), BITS // 8), axis=1, bitorder="little")
    out = np.repeat(np.arange(bands, dtype=np.int64)[None, :] << width, len(prints), axis=0)
    for k in range(width):
        out |= ones[:, plan[:, k]].astype(np.int64) << k
    return out


def band_hashes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x bands: the cells of each row's set in a small table."""
    return band_cells(fingerprints(grams, bounds), band_plan(1))


def _sketches(width: int):
    def run(batches):
        for part, data, offsets in tk.text_pieces(batches):
            grams, bounds = shingle_sets(tk.lower_ascii(data), offsets, width)
            prints = fingerprints(grams, bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(set_keys(grams, bounds).view(np.int64)), pa.array(np.diff(bounds), pa.int64()), *(pa.array(prints[:, k]) for k in range(len(_PRINT)))], ["doc_id", "key", "n", *_PRINT])

    return run


def _dealt_cells(plan: np.ndarray, prints_too: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = np.stack([part.column(c).to_numpy() for c in _PRINT], axis=1)
                cells = pa.array(band_cells(prints.view(np.uint64), plan).ravel())
                if not prints_too:
                    yield pa.RecordBatch.from_arrays([cells], ["cell"])
                    continue
                again = np.repeat(np.arange(len(prints)), len(plan))
                yield pa.RecordBatch.from_arrays([cells, pa.array(part.column("key").to_numpy()[again]), *(pa.array(prints[again, k]) for k in range(len(_PRINT)))], ["cell", "key", *_PRINT])

    return run


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of left (rows x words) with all of right."""
    out = np.zeros((len(left), len(right)), np.uint16)
    other = np.empty(out.shape, np.uint64)
    count = np.empty(out.shape, np.uint8)
    for k in range(left.shape[1]):
        np.bitwise_xor(left[:, k][:, None], right[:, k][None, :], out=other)
        np.bitwise_count(other, out=count)
        out += count
    return out


def tile_links(prints: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to), as places, that connect all fingerprints within radius; sides 1 and 2 are compared with each other only."""
    group = np.full(len(prints), -1)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for turn in range(LEADERS):
        free = np.flatnonzero(group < 0)
        if len(free) <= TILE:
            break
        leader = free[len(free) // 2]
        near = free[distances(prints[leader : leader + 1], prints[free])[0] <= radius]
        group[near] = turn
        found_a.append(near[near != leader])
        found_b.append(np.full(len(near) - 1, leader))
    count = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.lexsort((count, group))
    prints, side, group, count = prints[order], side[order], group[order], count[order]
    tiles = [slice(i, i + TILE) for i in range(0, len(prints), TILE)]
    for i, a in enumerate(tiles):
        for b in tiles[i:]:
            if group[a][0] >= 0 and group[a][0] == group[b][-1] or count[a].min() > count[b].max() + radius or count[b].min() > count[a].max() + radius:
                continue
            near = distances(prints[a], prints[b]) <= radius
            near &= (side[a][:, None] + side[b][None, :]) % 3 == 0
            x, y = np.nonzero(np.triu(near, 1) if a is b else near)
            if len(x):
                n = len(group[a])
                label = _settle(n if a is b else n + len(group[b]), x, y if a is b else y + n)
                node = np.flatnonzero(label != np.arange(len(label)))
                place = np.r_[order[a], order[b]]
                found_a.append(place[node])
                found_b.append(place[label[node]])
    return np.concatenate(found_a), np.concatenate(found_b)


def _close(radius: int):
    def run(table: pa.Table) -> pa.Table:
        cell, side, key = (table.column(c).to_numpy() for c in ("cell", "side", "key"))
        prints = np.stack([table.column(c).to_numpy() for c in _PRINT], axis=1).view(np.uint64)
        order = np.argsort(cell, kind="stable")
        out = [np.zeros((2, 0), np.int64)]
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if len(rows) > 1:
                a, b = tile_links(prints[rows], side[rows].astype(np.int64), radius)
                out.append(np.stack([key[rows[a]], key[rows[b]]]))
        # the same sets are near in many cells: one link for each of them
        ends = np.concatenate(out, axis=1)
        node, at = np.unique(ends, return_inverse=True)
        label = _settle(len(node), *at.reshape(2, -1))
        linked = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[linked]), "b": pa.array(node[label[linked]])})

    return run


def close_links(sets: DataFrame, similarity: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect the keys of sets (key and fingerprint) whose fingerprints share a band and lie within the radius."""
    n = sets.count()
    plan = band_plan(n, similarity)
    hot = written(sets.mapInArrow(_dealt_cells(plan, False), "cell long").groupBy("cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > cell_rows), "hot-cells")
    more = hot.agg(F.coalesce(F.sum(F.col("rows") * F.ceil(F.col("rows") / cell_rows)), F.lit(0))).first()[0]
    # one hot cell for cell_rows rows at most
    rows = sets.mapInArrow(_dealt_cells(plan, True), "cell long, key long, " + ", ".join(f"{c} long" for c in _PRINT)).join(F.broadcast(hot), "cell", "left")
    parts = F.coalesce(F.ceil(F.col("rows") / cell_rows), F.lit(1)).cast("int")
    rows = rows.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("key"), parts).cast("int")})
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key",
        *_PRINT,
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    tasks = max(8, -(-(n * len(plan) + int(more)) // TASK_ROWS))
    return dealt.withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int")).repartition(tasks, "task").groupBy("task").applyInArrow(_close(radius_of(similarity)), "a long, b long")


def _sets(width: int):
    def run(batches):
        for part, data, offsets in tk.text_pieces(batches):
            grams, bounds = shingle_sets(tk.lower_ascii(data), offsets, width)
            # an id may stand on rows with other texts
            own = np.flatnonzero(set_keys(grams, bounds).view(np.int64) == part.column("key").to_numpy())
            rows = part.take(pa.array(own))
            blobs = [grams[bounds[i] : bounds[i + 1]].tobytes() for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("root"), rows.column("parts"), pa.array(blobs, pa.binary())], ["key", "root", "parts", "grams"])

    return run


def similar_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all pairs of sets (sorted, distinct, not empty) of Jaccard similarity `similarity` or more.

    Sides 1 and 2 are compared with each other only, side 0 with itself."""
    size = np.array([len(s) for s in sets])
    grams, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], of[order]
    label, links = np.arange(len(sets)), []
    for i in np.flatnonzero(side < 2).tolist():
        other = side == 2 if side[i] else np.arange(len(sets)) > i
        other = other & (label != label[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9)
        if not other.any():
            continue
        low, high = np.searchsorted(grams, sets[i]), np.searchsorted(grams, sets[i], "right")
        common = np.bincount(gathered(of, low, high)[0], minlength=len(sets))
        near = np.flatnonzero(other & (common >= similarity * (size + size[i] - common) - 1e-9))
        if len(near):
            labels, at = np.unique(label[near], return_index=True)
            links += [(i, int(near[k])) for k in at]
            label[np.isin(label, labels)] = label[i]
    return links


def _compare(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        cell, side, key = (table.column(c).to_numpy() for c in ("cell", "side", "key"))
        blobs = table.column("grams")
        order = np.argsort(cell, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if len(rows) > 1:
                found = similar_links([np.frombuffer(blobs[int(r)].as_py(), np.uint64) for r in rows], side[rows], similarity)
                out += [(key[rows[a]], key[rows[b]]) for a, b in found]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, component_id.

    component_id is the smallest doc_id reachable over pairs of texts whose sets of `width`-word shingles
    (A-Z lower-cased) have Jaccard similarity `similarity` or more, the row's own included; null ids are passed
    over unless a component has no other.  Texts without a word are alike and like no other.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    prints = written(own.mapInArrow(given_back(_sketches(width)), f"doc_id {id_type}, key long, n long, " + ", ".join(f"{c} long" for c in _PRINT)), "sketches")
    distinct = written(prints.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), *(F.min(c).alias(c) for c in _PRINT)), "distinct-sets")
    links = close_links(distinct.filter("n > 0").select("key", *_PRINT), similarity, cell_rows).distinct()
    grouped = written(distinct.select("key", "first_id", "n").join(connected_components(links).withColumnRenamed("node", "key"), "key"), "candidates")
    # parts of a group, by its texts and by its shingles
    sizes = grouped.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / part_rows), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    wanted = written(grouped.join(sizes, "root").select("first_id", "key", "root", "parts", "n"), "wanted")
    total = wanted.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0))).first()[0]
    rows = own.join(wanted, own["doc_id"].eqNullSafe(wanted["first_id"])).select("text", "key", "root", "parts").mapInArrow(given_back(_sets(width)), "key long, root long, parts int, grams binary")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key",
        "grams",
        F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    tasks = max(8, -(-int(total) // TASK_SHINGLES))
    near = dealt.withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int")).groupBy("task").applyInArrow(_compare(similarity), "a long, b long")
    roots = connected_components(near)
    member = distinct.join(roots, distinct["key"] == roots["node"], "left").select("key", F.coalesce("root", "key").alias("root"), "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.select("doc_id", "key").join(member.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
