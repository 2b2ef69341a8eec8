"""Exact substring deduplication on bytes by merging shard Burrows-Wheeler transforms.

Shards of suffixes, each sorted on its own, are merged by refining their
interleave: knowing the order by the first h bytes, one stable distribution of
the shards' transforms by symbol gives the order by more.  Boundaries between
groups are carried along, so in the end each group is an interval of suffixes with a
common prefix of `width` bytes; an interval of two or more rows is a repeat.  The suffixes of the union are never sorted again.

Which suffixes are merged together.  Every `width`-byte window has an anchor: the
leftmost place of the least hash among its `gram`-byte substrings.  Equal windows
have equal anchors, so anchors that occur once are dropped first, and the runs of
windows around the others go to the part of the anchor's hash.  There, equal runs
are folded with a count, since they are one interval however often they occur;
the distinct runs of an anchor that has several are split into shards and merged.

Every byte of every text is looked at; nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .blocks import MESSAGE, among, blocked, by_block, by_part, gathered, message_rows, narrow, packed, part_cuts, unpacked, widened

#: Bytes of a repeat, and of the substrings among which its anchor is chosen.
WIDTH, GRAM = 200, 32
#: Distinct runs beyond which an anchor's windows are grouped by their whole content instead.
LONG_PREFIX_AT = 20_000
#: Bytes of one shard, and shards merged at once.
SHARD_BYTES, SHARDS = 1 << 18, 255
#: Bytes by which a shard's suffixes are sorted.
ORDER = 8
#: Never part of UTF-8, so it can end the strings of a shard.
_END = 0xFF
_AT_BITS = 22
#: Parts of the key space for each block of texts.
PARTS_PER_BLOCK = 4


def _pieces(table):
    for rows, data, offsets in tk.text_pieces(table.select(["doc_id", "text"]).combine_chunks().to_batches(), piece_bytes=1 << 16):
        yield rows, data, offsets, tk._BYTE_VALUES[data]


def _runs(data, offsets, h, width, gram):
    """Runs of windows with one anchor place: first and last window, anchor's hash, and a hash of the run's bytes."""
    empty = np.zeros(0, np.int64)
    if len(h) < width:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    row = tk.rows_of(offsets)
    at = np.flatnonzero(row[: len(h) - width + 1] == row[width - 1 :])
    if not len(at):
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = tk.window_hashes(h, gram)
    bits = max(_AT_BITS, len(grams).bit_length())
    low = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    have, need = 1, width - gram + 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    place = (low[at] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    begin, stop = at[first], at[np.r_[first[1:], len(at)] - 1]
    # mixed anew, since least hashes are all small and would share few parts
    return begin, stop, tk.mix(grams[place[first]]), _content(h, begin, stop + width)


def _content(h, begin, end):
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * tk.powers(tk.WORD_BASE, len(h)), out=total[1:])
    back = tk.powers(pow(tk.WORD_BASE, -1, 1 << 64), len(h) + 1)
    return tk.mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _single(h, begin, stop, group, long, width):
    """Runs of frequent anchors cut into single windows, grouped by the window's hash."""
    n = np.where(long, stop - begin + 1, 1)
    base = np.r_[0, np.cumsum(n)]
    inner = np.arange(base[-1]) - np.repeat(base[:-1], n)
    of = np.repeat(np.arange(len(n)), n)
    cut = long[of]
    b = np.where(cut, begin[of] + inner, begin[of])
    s = np.where(cut, b, stop[of])
    g = group[of].copy()
    content = _content(h, b, s + width)
    g[cut] = content[cut]
    return b, s, g, content


def _ask(parts, width, gram):
    def run(key, table):
        found = []
        for _, data, offsets, h in _pieces(table):
            _, _, anchor, content = _runs(data, offsets, h, width, gram)
            found.append((anchor, content))
        anchor, content = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((content, anchor))
        anchor, content = anchor[order], content[order]
        if not len(anchor):
            return message_rows([], [], [])
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        several = np.diff(np.r_[first, len(anchor)]) > 1
        kinds = np.add.reduceat(np.r_[1, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])].astype(np.int64), first)
        k = anchor[first]
        cuts = part_cuts(k, parts)
        count = np.minimum(kinds, 60_000).astype(np.uint16)
        rows = [(p, packed(narrow(k[a:b]), np.packbits(several[a:b]), count[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return message_rows([key[0].as_py()] * len(rows), [p for p, _ in rows], [x for _, x in rows])

    return run


def _answer(key, table):
    blocks, got = table.column("block").to_pylist(), [unpacked(x) for x in table.column("blob").to_pylist()]
    keys = [widened(x[0]) for x in got]
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    several = np.concatenate([np.unpackbits(x[1], count=len(own)) for x, own in zip(got, keys, strict=True)])[order].astype(bool)
    count = np.concatenate([x[2] for x in got])[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    shared = (np.diff(np.r_[first, len(k)]) > 1) | np.logical_or.reduceat(several, first)
    frequent = (np.add.reduceat(count, first) > LONG_PREFIX_AT)[shared]
    repeated = k[first][shared]
    out = []
    for own in keys:
        have, at = among(own, repeated)
        out.append(packed(narrow(own[have]), frequent[at[have]]) if have.any() else None)
    told = [k for k, x in enumerate(out) if x is not None]
    return message_rows([blocks[k] for k in told], [-1] * len(told), [out[k] for k in told])


def _told(table):
    got = [unpacked(x) for x in table.column("blob").to_pylist()]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, frequent = np.concatenate([widened(x[0]) for x in got]), np.concatenate([x[1] for x in got])
    order = np.argsort(keys, kind="stable")
    return keys[order], frequent[order]


def _repeated_runs(data, offsets, h, repeated, frequent, width, gram):
    begin, stop, anchor, content = _runs(data, offsets, h, width, gram)
    have, at = among(anchor, repeated)
    begin, stop, anchor, content, at = begin[have], stop[have], anchor[have], content[have], at[have]
    long = frequent[at] if len(frequent) else np.zeros(0, bool)
    if long.any():
        begin, stop, anchor, content = _single(h, begin, stop, anchor, long, width)
    return begin, stop, anchor, content


def _send(parts, width, gram):
    def run(key, texts, told):
        if not texts.num_rows:
            return message_rows([], [], [])
        repeated, frequent = _told(told)
        found = []
        for _, data, offsets, h in _pieces(texts):
            begin, stop, group, content = _repeated_runs(data, offsets, h, repeated, frequent, width, gram)
            content, keep, times = np.unique(content, return_index=True, return_counts=True)
            text, cuts = gathered(data, begin[keep], stop[keep] + width)
            found.append((group[keep], content, times, (stop - begin + 1)[keep], np.diff(cuts), text))
        group, content, times, n, size = (np.concatenate([x[i] for x in found]) for i in range(5))
        text = np.concatenate([x[5] for x in found])
        offsets = np.r_[0, np.cumsum(size)]
        _, keep, back = np.unique(content, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=times, minlength=len(keep)).astype(np.int64)
        order = np.argsort(group[keep], kind="stable")
        keep, total = keep[order], total[order]
        cuts = part_cuts(group[keep], parts)
        rows = []
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                own = keep[a:b]
                flat, at = gathered(text, offsets[own], offsets[own + 1])
                rows.append((p, packed(group[own], content[own], np.minimum(total[a:b], 2).astype(np.uint8), n[own].astype(np.int32), at, flat)))
        return message_rows([key[0].as_py()] * len(rows), [p for p, _ in rows], [x for _, x in rows])

    return run


class Shard:
    """Distinct strings, each ended by _END, with the order of their suffixes and its transforms.

    The order is by the first ORDER bytes, then by place: the Burrows-Wheeler transform of bounded order
    (Schindler's).  Refining the interleave sorts by more, so a longer order in the shards would not be used.

    symbols, back: for each row, the two bytes before its suffix and the row of the suffix that starts
    there; symbol, step: the same for one byte.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        key = np.zeros(n, np.uint64)
        around = np.resize(text, n + ORDER)
        for i in range(ORDER):
            key = key << np.uint64(8) | around[i : i + n]
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[self.order] = np.arange(n, dtype=np.int32)
        self.symbol = text[self.order - 1]
        self.symbols = text[self.order - 2].astype(np.uint16) << np.uint16(8) | self.symbol
        self.step, self.back = rank[self.order - 1], rank[self.order - 2]


def merge_transforms(shards: list[Shard], width: int) -> np.ndarray:
    """For every row of the shards, end to end, whether its suffix shares its first width bytes with another.

    rows is the interleave, known by the first h bytes; distributing it by the two bytes before each
    suffix gives the interleave of the suffixes that start there, by h + 2 bytes.  A suffix that is
    alone in its interval stays alone as it grows to the left, so its row is settled and leaves.
    """
    base = np.r_[0, np.cumsum([len(s.order) for s in shards])].astype(np.int32)
    rows = np.arange(base[-1], dtype=np.int32)
    group = np.zeros(len(rows), np.int32)
    two = (np.concatenate([s.symbols for s in shards]), np.concatenate([s.back + b for s, b in zip(shards, base, strict=False)]))
    one = (np.concatenate([s.symbol for s in shards]), np.concatenate([s.step + b for s, b in zip(shards, base, strict=False)]))
    for symbols, back in [one] * (width % 2) + [two] * (width // 2):
        symbol = symbols[rows]
        order = np.argsort(symbol, kind="stable")
        source, symbol = group[order], symbol[order]
        edge = np.ones(len(order), bool)
        edge[1:] = (source[1:] != source[:-1]) | (symbol[1:] != symbol[:-1])
        edge |= (symbol & 0xFF) == _END
        if symbol.dtype != np.uint8:
            edge |= symbol >> 8 == _END
        alone = edge.copy()
        alone[:-1] &= edge[1:]
        order, group = order[~alone], np.cumsum(edge, dtype=np.int32)[~alone]
        rows = back[rows[order]]
    again = np.zeros(base[-1], bool)
    again[rows] = True
    return again


def repeated_windows(strings: list[np.ndarray], width: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string, whether each of its width-byte windows occurs again in the strings."""
    packs, now, size = [], [], 0
    most = max(shard_bytes, sum(len(s) + 1 for s in strings) // SHARDS + 1)
    for i, s in enumerate(strings):
        if now and size + len(s) > most:
            packs.append(now)
            now, size = [], 0
        now.append(i)
        size += len(s) + 1
    if now:
        packs.append(now)
    end = np.array([_END], np.uint8)
    shards = [Shard(np.concatenate([x for i in p for x in (strings[i], end)])) for p in packs]
    by_shard = merge_transforms(shards, width)
    out: list = [None] * len(strings)
    at = 0
    for p, shard in zip(packs, shards, strict=True):
        flags = np.zeros(len(shard.order), bool)
        flags[shard.order] = by_shard[at : at + len(shard.order)]
        at += len(shard.order)
        place = 0
        for i in p:
            out[i] = flags[place : place + max(0, len(strings[i]) - width + 1)]
            place += len(strings[i]) + 1
    return out


def _merge(width):
    def run(key, table):
        blocks, got = table.column("block").to_pylist(), [unpacked(x) for x in table.column("blob").to_pylist()]
        size = np.r_[0, np.cumsum([len(x[1]) for x in got])]
        group, content, times, n = (np.concatenate([x[i] for x in got]) for i in range(4))
        text = np.concatenate([x[5] for x in got])
        offsets = np.r_[0, np.cumsum(np.concatenate([np.diff(x[4]) for x in got]))]
        kinds, first, back = np.unique(content, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=times)
        n_kind, group_kind = n[first].astype(np.int64), group[first]
        place = np.r_[0, np.cumsum(n_kind)]
        flags = np.repeat(total > 1, n_kind)
        order = np.argsort(group_kind, kind="stable")
        of = np.unique(group_kind, return_inverse=True, return_counts=True)
        unsure = order[(of[2] > 1)[of[1]][order]]
        if len(unsure):
            strings = [text[offsets[first[k]] : offsets[first[k] + 1]] for k in unsure]
            for k, again in zip(unsure.tolist(), repeated_windows(strings, width), strict=True):
                flags[place[k] : place[k + 1]] |= again
        hit = np.logical_or.reduceat(flags, place[:-1])
        out = []
        for k, x in enumerate(got):
            own = back[size[k] : size[k + 1]]
            own = own[hit[own]]
            marks, _ = gathered(flags, place[own], place[own + 1])
            out.append(packed(kinds[own], n_kind[own].astype(np.int32), marks))
        return message_rows(blocks, [1] * len(blocks), out)

    return run


def _finish(width, gram, output, carried, schema):
    def run(key, texts, told):
        if not texts.num_rows:
            return schema.empty_table()
        kind = told.column("part").to_numpy()
        repeated, frequent = _told(told.filter(pa.array(kind == -1)))
        found = [unpacked(x) for x in told.filter(pa.array(kind == 1)).column("blob").to_pylist()]
        key_of = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in found)])
        per = np.concatenate([np.zeros(0, np.int32), *(x[1] for x in found)]).astype(np.int64)
        flags = np.concatenate([np.zeros(0, bool), *(x[2] for x in found)])
        place = np.r_[0, np.cumsum(per)]
        order = np.argsort(key_of, kind="stable")
        keys = key_of[order]
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for _, data, offsets, h in _pieces(texts):
            begin, _, _, content = _repeated_runs(data, offsets, h, repeated, frequent, width, gram)
            have, at = among(content, keys)
            change = np.zeros(len(data) + 1, np.int32)
            if have.any():
                which = order[at[have]]
                count = per[which]
                base = np.r_[0, np.cumsum(count)]
                inner = np.arange(base[-1]) - np.repeat(base[:-1], count)
                window = (np.repeat(begin[have], count) + inner)[flags[np.repeat(place[which], count) + inner]]
                np.add.at(change, window, 1)
                np.add.at(change, window + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i in range(len(offsets) - 1):
                a, b = offsets[i], offsets[i + 1]
                own, raw = gone[a:b], data[a:b]
                lost = int(np.count_nonzero(own))
                n_bytes.append(int(b - a))
                n_removed.append(lost)
                n_spans.append(int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if lost else 0)
                left = (raw[~own] if lost else raw).tobytes()
                kept.append(left if output == "bytes" else hashlib.sha256(left).hexdigest())
        columns = [texts.column("doc_id"), *(texts.column(f"c{i}") for i in range(carried)), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary() if output == "bytes" else pa.string())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, output: str = "bytes", block_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, carried columns, n_bytes, n_removed, n_spans and what is kept.

    A byte goes if a string of `width` bytes that covers it also starts anywhere else, in the same row
    or another; strings are judged on the input and never cross rows.  n_spans counts maximal runs of
    removed bytes.  output: "bytes" gives kept (binary, since a removal may cut a character), "sha256" gives
    kept_sha256.  Null and empty texts have no bytes; repeated rows are copies of each other, so all
    their long strings go.  Ids are integers or null; other columns are ignored unless carried.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    if not 1 <= gram <= width:
        raise ValueError("gram must be between 1 and width")
    carry = carry or []
    texts, n = blocked(docs, id_col, text_col, carry, block_bytes)
    parts = n * PARTS_PER_BLOCK
    asked = texts.groupBy("block").applyInArrow(_ask(n, width, gram), MESSAGE)
    told = by_block(by_part(asked, n).groupBy("part").applyInArrow(_answer, MESSAGE), n)
    sent = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send(parts, width, gram), MESSAGE)
    marks = by_block(by_part(sent, parts).groupBy("part").applyInArrow(_merge(width), MESSAGE), n)
    last = StructField("kept", BinaryType()) if output == "bytes" else StructField("kept_sha256", StringType())
    inner = StructType([StructField("doc_id", LongType()), *(StructField(f"c{i}", texts.schema[f"c{i}"].dataType) for i in range(len(carry))), *(StructField(x, LongType()) for x in ("n_bytes", "n_removed", "n_spans")), last])
    done = texts.groupBy("block").cogroup(told.unionByName(marks).groupBy("block")).applyInArrow(_finish(width, gram, output, len(carry), to_arrow_schema(inner)), inner)
    return done.toDF("doc_id", *carry, "n_bytes", "n_removed", "n_spans", last.name)
