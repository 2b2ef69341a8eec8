"""Candidates of near copies: SimHash fingerprints, bands of their bits, tiled comparison."""

import numpy as np
import pytest

from siltstone.llm import nearcopies
from siltstone.llm import textkernel as tk


def families(rng, n=900):
    """Fingerprints of some families within a few bits, others at random, and chains whose ends are far apart."""
    prints = rng.integers(0, 2**64, (n, 4), dtype=np.uint64)
    for start, size, bits in ((0, 400, 30), (400, 200, 45), (600, 50, 90)):
        prints[start : start + size] = prints[start]
        for _ in range(bits):
            prints[np.arange(start, start + size), rng.integers(0, 4, size)] ^= np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64)
    for i in range(701, 720):
        prints[i] = prints[i - 1] ^ np.array([(1 << 60) - 1 if k == i % 4 else 0 for k in range(4)], np.uint64)
    return prints[rng.permutation(n)]


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    return [find(i) for i in range(n)]


def test_fingerprints_by_brute_force():
    rng = np.random.default_rng(7)
    sizes = [0, 1, 2, 5, 128, 129, 300, 70_000, 0, 40]
    bounds = np.r_[0, np.cumsum(sizes)]
    grams = rng.integers(0, 2**64, bounds[-1], dtype=np.uint64)
    got = nearcopies.fingerprints(grams, bounds)
    for i, size in enumerate(sizes):
        for k, seed in enumerate(nearcopies._SEEDS):
            h = tk.mix(grams[bounds[i] : bounds[i + 1]] ^ seed)
            assert int(got[i, k]) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > size)


@pytest.mark.parametrize("tile", [256, 16])
def test_tiles_lose_no_link(monkeypatch, tile):
    monkeypatch.setattr(nearcopies, "TILE", tile)
    rng = np.random.default_rng(9)
    prints, radius = families(rng), nearcopies.radius_of(0.8)
    near = nearcopies.distances(prints, prints) <= radius
    assert near[5, 7] == (sum((int(prints[5, k]) ^ int(prints[7, k])).bit_count() for k in range(4)) <= radius)
    for side in (np.zeros(900, np.int64), rng.integers(1, 3, 900)):
        a, b = nearcopies.tile_links(prints, side, radius)
        assert near[a, b].mean() > 0.9  # a link may go to the least of a tile's component
        got = components(900, zip(a, b, strict=True))
        for x, y in zip(*np.nonzero(near), strict=True):
            assert got[x] == got[y] or side[x] == side[y] != 0
        assert got == components(900, [*zip(a, b, strict=True), *((x, y) for x, y in zip(*np.nonzero(near), strict=True) if got[x] == got[y])])


@pytest.mark.parametrize("n", [1, 200_000, 10_000_000])
def test_bands_are_bits_of_the_fingerprint_and_share_near_ones(n):
    rng = np.random.default_rng(5)
    own = rng.integers(0, 2**64, (300, 100), dtype=np.uint64)
    prints = [nearcopies.fingerprints(np.ascontiguousarray(x).ravel(), np.arange(0, 27_001, 90)) for x in (own[:, :90], own[:, 10:])]  # 80 of 100 are in both
    plan = nearcopies.band_plan(n)
    cells = [nearcopies.band_cells(x, plan) for x in prints]
    assert (cells[0] == cells[1]).any(axis=1).all()
    assert (np.bitwise_count(prints[0] ^ prints[1]).sum(axis=1) <= nearcopies.radius_of(0.8)).all()
    bit = lambda p, at: int(p[at // 64]) >> int(at % 64) & 1
    assert [int(c) for c in cells[0][3]] == [(k << plan.shape[1]) + sum(bit(prints[0][3], at) << j for j, at in enumerate(band)) for k, band in enumerate(plan.tolist())]


@pytest.mark.parametrize("cell_rows", [16_384, 40])
def test_links_of_a_table(spark, cell_rows):
    prints = families(np.random.default_rng(3))
    keys = np.arange(900) * 7 - 2000
    rows = [(int(k), *map(int, p.view(np.int64))) for k, p in zip(keys, prints, strict=True)]
    sets = spark.createDataFrame(rows, "key long, f0 long, f1 long, f2 long, f3 long")
    plan, radius = nearcopies.band_plan(900), nearcopies.radius_of(0.8)
    cells = nearcopies.band_cells(prints, plan)
    want = [(x, y) for x, y in zip(*np.nonzero(nearcopies.distances(prints, prints) <= radius), strict=True) if x < y and (cells[x] == cells[y]).any()]
    got = [((r["a"] + 2000) // 7, (r["b"] + 2000) // 7) for r in nearcopies.close_links(sets, 0.8, cell_rows).collect()]
    assert len(want) > 50_000 and components(900, got) == components(900, want)
