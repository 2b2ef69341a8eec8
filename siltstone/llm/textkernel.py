"""Columnar text kernels: tokenising and hashing whole Arrow string columns with numpy.

A column of texts is one byte buffer plus offsets, so words, word hashes and
window hashes of a whole batch are a handful of vectorised passes and no
Python loop per row or per word.  Every routine works on UTF-8 bytes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  Null texts count
as empty.  Hashes are 64-bit, deterministic across machines and processes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M64 = (1 << 64) - 1
#: Multipliers of the polynomial hashes; each is 3 modulo 8, so odd powers stay well mixed.
BYTE_BASE = 0x9E3779B97F4A7C1B
WORD_BASE = 0xC2B2AE3D27D4EB53
#: Rows are handed to the kernels in pieces of about so many bytes: small enough for the arrays of a piece to stay in cache.
PIECE_BYTES = 1 << 17
#: Spans are hashed in pieces of about so many bytes.
HASH_BYTES = 1 << 20


def _splitmix(n: int, seed: int) -> np.ndarray:
    out = []
    state = seed & _M64
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _M64
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE_VALUES = _splitmix(256, 20_240_607)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_pieces(batches, column: str = "text", piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with about piece_bytes of text each; one text is never cut."""
    for batch in batches:
        col = batch.column(column)
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        col = pc.fill_null(col, "")
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece_bytes, "right")) - 1)
            to = min(to, len(col))
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data | 0x20, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and bounds: words of row i are bounds[i] .. bounds[i+1]."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[starts[i]:ends[i]] for every i; spans are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + HASH_BYTES)))
        low, high = int(starts[at]), int(ends[to - 1])
        part = data[low:high]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[part] * powers(BYTE_BASE, len(part)), out=total[1:])
        back = powers(pow(BYTE_BASE, -1, 1 << 64), len(part) + 1)
        begin, end = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
        at = to
    return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i+width] for i in 0 .. len(h)-width; empty if there are fewer."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(WORD_BASE, len(h)), out=total[1:])
    back = powers(pow(WORD_BASE, -1, 1 << 64), len(h) + 1)
    return mix((total[width:] - total[:-width]) * back[: len(h) - width + 1])


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row number of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
