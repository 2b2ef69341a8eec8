"""Substring deduplication with suffix trees of groups of suffixes.

The suffixes of the corpus are dealt to groups that fit in memory.  Of each group the suffix tree is built as
sorted suffixes with the prefixes they share, its internal nodes read off by the stretches of those: the leaves below
an internal node of `width` words or more are the places of one repeat, and of their documents the least keeps it.

What groups a suffix.  A plain prefix would part neighbouring suffixes, and so move each word `width` times.
Instead each window of `width` words has an anchor, the least hash among its `gram`-word substrings (a
minimiser), so windows of equal words have equal anchors, and neighbours mostly have the same one: they move together,
as one run.  Anchors that occur once in the corpus are dropped first, since no window around them
can repeat; this moves a few bytes for each distinct anchor.  Where an anchor is so frequent
that its group would outgrow memory, the grouping prefix is lengthened to the whole window.
Equal runs of one block are folded to their least document before they move, so a passage in
a third of all documents costs one row a block.

Nothing is sampled or capped, and windows never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .blocks import MESSAGE, among, blocked, by_block, by_part, gathered, message_rows, narrow, packed, part_cuts, unpacked, widened

#: Words of a window, and of the substrings among which its anchor is chosen.
WIDTH, GRAM = 13, 5
#: Occurrences beyond which an anchor's prefix is lengthened to the whole window.
LONG_PREFIX_AT = 50_000
#: Windows of one run, at most; longer runs are cut.
RUN = 32
#: Parts of the key space for each block of texts.
PARTS_PER_BLOCK = 4
_NO_ID = np.iinfo(np.int64).max


def _pieces(table: pa.Table):
    for rows, data, offsets in tk.text_pieces(table.select(["doc_id", "text"]).combine_chunks().to_batches(), piece_bytes=1 << 17):
        ids = rows.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        starts, ends, bounds = tk.word_spans(data, offsets)
        yield rows, data, offsets, ids, starts, ends, bounds, tk.span_hashes(data, starts, ends)


def _anchors(h: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their rows and their anchors."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, have, need = tk.window_hashes(h, gram), 1, width - gram + 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    row = tk.rows_of(bounds)
    at = np.flatnonzero(row[: len(h) - width + 1] == row[width - 1 :])
    return at, row[at], tk.mix(least[at])  # mixed anew: least hashes are all small


def _ask_anchors(parts: int, width: int, gram: int):
    def run(key, table):
        keys, docs, counts = [], [], []
        for _, _, _, ids, _, _, bounds, h in _pieces(table):
            at, row, anchor = _anchors(h, bounds, width, gram)
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])
            first = np.flatnonzero(new)
            keys.append(anchor[first])
            docs.append(ids[row[first]])
            counts.append(np.diff(np.r_[first, len(at)]).astype(np.int64))
        k, d, c = (np.concatenate(x) for x in (keys, docs, counts))
        order = np.argsort(k, kind="stable")
        k, d, c = k[order], d[order], c[order]
        if not len(k):
            return message_rows([], [], [])
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        count = np.minimum(np.add.reduceat(c, first), 60_000).astype(np.uint16)
        k = k[first]
        cuts = part_cuts(k, parts)
        block = key[0].as_py()
        rows = [(p, packed(narrow(k[a:b]), np.packbits(several[a:b]), count[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return message_rows([block] * len(rows), [p for p, _ in rows], [x for _, x in rows])

    return run


def _answer_anchors(key, table):
    blocks, got = table.column("block").to_pylist(), [unpacked(x) for x in table.column("blob").to_pylist()]
    keys = [widened(x[0]) for x in got]
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    several = np.concatenate([np.unpackbits(x[1], count=len(own)) for x, own in zip(got, keys, strict=True)])[order].astype(bool)
    count = np.concatenate([x[2] for x in got])[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    n = np.diff(np.r_[first, len(k)])
    shared = (n > 1) | np.logical_or.reduceat(several, first)
    frequent = np.add.reduceat(count, first) > LONG_PREFIX_AT
    repeated, frequent = k[first][shared], frequent[shared]
    out = []
    for own in keys:
        have, at = among(own, repeated)
        out.append(packed(narrow(own[have]), frequent[at[have]]) if have.any() else None)
    told = [k for k, x in enumerate(out) if x is not None]
    return message_rows([blocks[k] for k in told], [-1] * len(told), [out[k] for k in told])


def _runs(h, bounds, repeated, frequent, width, gram):
    """Runs of windows that share a repeated anchor: first and last window, row, group key and a hash of the run's words."""
    at, row, anchor = _anchors(h, bounds, width, gram)
    have, place = among(anchor, repeated)
    at, row, anchor, long = at[have], row[have], anchor[have], frequent[place[have]] if len(frequent) else np.zeros(0, bool)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | long[1:]
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    first = np.flatnonzero(inside % RUN == 0)
    last = np.r_[first[1:], len(at)] - 1
    begin, stop = at[first], at[last]
    group = anchor[first].copy()
    whole = long[first]
    group[whole] = tk.window_hashes(h, width)[begin[whole]]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * tk.powers(tk.WORD_BASE, len(h)), out=total[1:])
    back = tk.powers(pow(tk.WORD_BASE, -1, 1 << 64), len(h) + 1)
    end = stop + width
    words = tk.mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return begin, stop, row[first], group, words


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = [unpacked(x) for x in table.column("blob").to_pylist()]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, frequent = np.concatenate([widened(x[0]) for x in got]), np.concatenate([x[1] for x in got])
    order = np.argsort(keys, kind="stable")
    return keys[order], frequent[order]


def _send_runs(parts: int, width: int, gram: int):
    def run(key, texts, told):
        if not texts.num_rows:
            return message_rows([], [], [])
        repeated, frequent = _told(told)
        found = []
        for _, data, _, ids, starts, ends, bounds, h in _pieces(texts):
            begin, stop, row, group, words = _runs(h, bounds, repeated, frequent, width, gram)
            order = np.lexsort((ids[row], words))
            keep = order[np.r_[True, words[order][1:] != words[order][:-1]]] if len(order) else order
            text, offsets = gathered(data, starts[begin[keep]], ends[stop[keep] + width - 1])
            found.append((group[keep], words[keep], ids[row[keep]], (stop - begin + 1)[keep], text, np.diff(offsets)))
        group, words, ids, n, _, size = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.concatenate([x[4] for x in found])
        offsets = np.r_[0, np.cumsum(size)]
        order = np.lexsort((ids, words))
        order = order[np.r_[True, words[order][1:] != words[order][:-1]]] if len(order) else order
        order = order[np.argsort(group[order], kind="stable")]
        cuts = part_cuts(group[order], parts)
        rows = []
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                own = order[a:b]
                flat, at = gathered(text, offsets[own], offsets[own + 1])
                rows.append((p, packed(words[own], ids[own], n[own].astype(np.int32), at, flat)))
        return message_rows([key[0].as_py()] * len(rows), [p for p, _ in rows], [x for _, x in rows])

    return run


def suffix_order(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of some strings of words in lexical order, and how many words each shares with the one before it.

    words: the strings end to end, as numbers; strings end at places that no suffix reaches beyond.  Suffixes are
    named by their first 1, 2, 4 ... words, in order, until the longest is told apart; the names then give the common prefixes.
    """
    n = len(words)
    # each string is ended by a number of its own, larger than all words
    at = np.arange(n) + np.repeat(np.arange(len(starts)), lengths)
    text = np.empty(n + len(starts), np.int64)
    text[at] = words
    text[starts + lengths + np.arange(len(starts))] = (int(words.max()) + 1 if n else 0) + np.arange(len(starts))
    levels, names, have = [], text, 1
    longest = int(lengths.max()) + 1 if len(lengths) else 1
    while True:
        levels.append(names.astype(np.int32))
        if have >= longest:
            break
        pair = names.astype(np.uint64) << np.uint64(32)
        pair[:-have] |= names[have:].astype(np.uint64)
        names = np.unique(pair, return_inverse=True)[1]
        have *= 2
    order = np.argsort(levels[-1][at], kind="stable")
    sorted_at = at[order]
    lcp = np.zeros(n, np.int64)
    left, right = sorted_at[:-1].copy(), sorted_at[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (left < len(text)) & (right < len(text))
        same = np.zeros(len(left), bool)
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        lcp[1:][same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    return order, lcp


def deep_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree's highest internal nodes of a string depth of `depth` or more: first leaf of each, and the leaf after its last.

    A node is a longest stretch of sorted suffixes whose neighbours all share that much; its own string depth, the length of the
    repeat, is the least of theirs."""
    deep = np.r_[False, lcp[1:] >= depth, False] if len(lcp) else np.zeros(2, bool)
    first = np.flatnonzero(deep[1:] & ~deep[:-1])
    last = np.flatnonzero(deep[:-1] & ~deep[1:])
    return first, last + 1


def _build_trees(width: int):
    def run(key, table):
        blocks, got = table.column("block").to_pylist(), [unpacked(x) for x in table.column("blob").to_pylist()]
        size = np.r_[0, np.cumsum([len(x[0]) for x in got])]
        ids = np.concatenate([x[1] for x in got])
        n = np.concatenate([x[2] for x in got]).astype(np.int64)
        text = np.concatenate([x[4] for x in got])
        lengths = np.concatenate([np.diff(x[3]) for x in got])
        offsets = np.r_[0, np.cumsum(lengths)]
        starts, ends, bounds = tk.word_spans(text, offsets)
        names = np.unique(tk.span_hashes(text, starts, ends), return_inverse=True)[1]
        order, lcp = suffix_order(names, bounds[:-1], np.diff(bounds))
        doc = np.repeat(ids, np.diff(bounds))[order]
        first, stop = deep_nodes(lcp, width)
        later = np.zeros(len(names), bool)
        if len(first):
            inside = np.arange(int((stop - first).sum())) + np.repeat(first - np.r_[0, np.cumsum(stop - first)[:-1]], stop - first)
            least = np.minimum.reduceat(doc, np.ravel(np.column_stack([first, stop]))[: -1 if stop[-1] == len(doc) else None])[::2]
            later[order[inside]] = doc[inside] > np.repeat(least, stop - first)
        # the windows of a run are its first suffixes
        place = np.r_[0, np.cumsum(n)]
        later = later[np.arange(place[-1]) + np.repeat(bounds[:-1] - place[:-1], n)]
        out = []
        for k, x in enumerate(got):
            a, b = size[k], size[k + 1]
            flags = later[place[a] : place[b]]
            per = n[a:b]
            hit = np.logical_or.reduceat(flags, place[a:b] - place[a])
            out.append(packed(x[0][hit], per[hit].astype(np.int32), flags[np.repeat(hit, per)]))
        return message_rows(blocks, [1] * len(blocks), out)

    return run


def _finish(width: int, gram: int, output: str, carried: int, schema: pa.Schema):
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
        # The least document of the block for every run, as it was sent.
        runs = []
        for _, _, _, ids, _, _, bounds, h in _pieces(texts):
            _, _, row, _, words = _runs(h, bounds, repeated, frequent, width, gram)
            runs.append((words, ids[row]))
        words, ids = np.concatenate([x[0] for x in runs]), np.concatenate([x[1] for x in runs])
        by = np.lexsort((ids, words))
        head = by[np.r_[True, words[by][1:] != words[by][:-1]]] if len(by) else by
        block_words, block_least = words[head], ids[head]

        n_words, n_removed, kept = [], [], []
        for _, data, offsets, ids, starts, ends, bounds, h in _pieces(texts):
            begin, stop, row, _, words = _runs(h, bounds, repeated, frequent, width, gram)
            change = np.zeros(len(h) + 1, np.int64)
            _, at = among(words, block_words)
            behind = ids[row] > block_least[at] if len(block_words) else np.zeros(len(words), bool)
            np.add.at(change, begin[behind], 1)
            np.add.at(change, stop[behind] + width, -1)
            have, at = among(words, key_of[order])
            have &= ~behind
            if have.any():
                which = order[at[have]]
                count = per[which]
                base = np.r_[0, np.cumsum(count)]
                inner = np.arange(base[-1]) - np.repeat(base[:-1], count)
                hit = flags[np.repeat(place[which], count) + inner]
                window = (np.repeat(begin[have], count) + inner)[hit]
                np.add.at(change, window, 1)
                np.add.at(change, window + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i in range(len(offsets) - 1):
                a, b = bounds[i], bounds[i + 1]
                n_words.append(int(b - a))
                lost = int(np.count_nonzero(gone[a:b])) if b > a else 0
                n_removed.append(lost)
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if lost:
                    mask = ~gone[a:b]
                    joined = b" ".join(raw[x:y] for x, y in zip((starts[a:b][mask] - offsets[i]).tolist(), (ends[a:b][mask] - offsets[i]).tolist(), strict=True))
                    kept.append(joined if output == "text" else hashlib.sha256(joined).hexdigest())
                elif output == "text":
                    kept.append(raw)
                else:
                    kept.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
        if output == "text":
            kept = [None if null else x.decode("utf-8") for x, null in zip(kept, texts.column("text").is_null().to_pylist(), strict=True)]
        columns = [texts.column("doc_id"), *(texts.column(f"c{i}") for i in range(carried)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, output: str = "text", block_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, carried columns, n_words, n_removed and what is kept.

    A word goes if a window of `width` words of its row that covers it also starts in a row
    with a smaller id; windows are judged on the input.  output: "text" gives kept_text (the text
    as it is where nothing goes, else the kept words joined by one space; null stays null), "sha256"
    gives kept_sha256, of the kept words joined by one space.  Null, empty and short texts have no
    window.  Rows with equal ids don't count as smaller than each other; a null id counts as the
    largest.  Ids are integers; other columns are ignored unless carried.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    if width < 2 or not 1 <= gram <= width:
        raise ValueError("width must be at least 2, gram between 1 and width")
    carry = carry or []
    texts, n = blocked(docs, id_col, text_col, carry, block_bytes)
    parts = n * PARTS_PER_BLOCK
    asked = texts.groupBy("block").applyInArrow(_ask_anchors(n, width, gram), MESSAGE)
    told = by_block(by_part(asked, n).groupBy("part").applyInArrow(_answer_anchors, MESSAGE), n)
    sent = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send_runs(parts, width, gram), MESSAGE)
    marks = by_block(by_part(sent, parts).groupBy("part").applyInArrow(_build_trees(width), MESSAGE), n)
    last = "kept_text" if output == "text" else "kept_sha256"
    inner = StructType([StructField("doc_id", LongType()), *(StructField(f"c{i}", texts.schema[f"c{i}"].dataType) for i in range(len(carry))), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField(last, StringType())])
    finish = _finish(width, gram, output, len(carry), to_arrow_schema(inner))
    done = texts.groupBy("block").cogroup(told.unionByName(marks).groupBy("block")).applyInArrow(finish, inner)
    return done.toDF("doc_id", *carry, "n_words", "n_removed", last)
