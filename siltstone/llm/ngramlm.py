"""Language-model scoring with a weighted backoff automaton.

States are the model's contexts: the empty one (the root), the start of a text, each word, and each
pair of words.  A state has an arc for every word seen after it in training, weighted by the
smoothed n-gram's log-probability and leading to the longest context it ends in; and a failure arc to the state of its
context without the first word, weighted by its backoff.  The root has an arc for every word.  A text is scored in one
left-to-right traversal that carries the state: take the arc if the state has one, else pay the failure arc and
look again from where it leads.

Smoothing: p(w | v) = (c(v w) + m(v) p(w | v')) / (c(v) + m(v)) with m(v) = MASS * c(v) ** GROWTH and v' the context v
without its first word, which sums to one for every v; p(w) is the add-half unigram.

The whole automaton never meets in one place.  Texts are dealt to blocks; a block asks the
parts of the key space for the counts of just the n-grams that occur in it, and builds
the piece of the automaton that its own texts can reach.  Counts cover all training
texts: nothing is pruned, and an n-gram costs one entry for each block it is in.  Triples of words are asked for
once the counts of pairs are known: a triple occurs in one block only if one of its two pairs does, and then
its own count there is the whole one and needn't move.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .blocks import MESSAGE, blocked, by_block, by_part, message_rows, narrow, packed, part_cuts, unpacked, widened

MASS, GROWTH = 5.0, 0.75
#: Words of the longest n-grams: 2 or 3.
ORDER = 3
#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(0x51AB_1E5E_ED00_0001), np.uint64(0x51AB_1E5E_ED00_0002)
#: What a message is about, in place of its part: counts of words and pairs, of triples, and the corpus's totals; and the block that sums these up.
PAIRS, TRIPLES, TOTALS, SUMMING = -1, -2, -3, -1
#: Texts scored side by side, a token each at a time; where fewer are left, one after the other.
ABREAST = 24


def _small(counts: np.ndarray, shared: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """Counts as bytes, deflated since most are one, those of 127 and more apart; the upper bit says whether several blocks have the key."""
    small = np.minimum(counts, 127).astype(np.uint8)
    return zlib.compress((small if shared is None else small | shared.astype(np.uint8) << 7).tobytes(), 1), counts[counts >= 127].astype(np.int64)


def _marked(small: bytes, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of _small(), and what their upper bits say."""
    raw = np.frombuffer(zlib.decompress(small), np.uint8)
    out = (raw & 127).astype(np.int64)
    out[out == 127] = large
    return out, raw > 127


def _whole(small: bytes, large: np.ndarray) -> np.ndarray:
    return _marked(small, large)[0]


class Tokens:
    """Of all texts of a block: every token's hash, the row it belongs to, and its words, pairs and triples by number.

    The end of a text is a token; the pair of a text's first token has the start as context; the triple of a text's
    first token is -1.
    """

    def __init__(self, table: pa.Table):
        found, rows, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for _, data, offsets in tk.text_pieces(table.select(["text"]).combine_chunks().to_batches(), piece_bytes=1 << 17):
            data = tk.lower_ascii(data)
            starts, ends, bounds = tk.word_spans(data, offsets)
            row, n = tk.rows_of(bounds), len(offsets) - 1
            token = np.full(len(starts) + n, END)
            token[np.arange(len(starts)) + row] = tk.span_hashes(data, starts, ends)
            found.append(token)
            rows.append(np.repeat(np.arange(n) + base, np.diff(bounds) + 1))
            base += n
        self.token, self.row = np.concatenate(found), np.concatenate(rows)
        self.first = np.r_[True, self.row[1:] != self.row[:-1]] if len(self.row) else np.zeros(0, bool)
        context = np.r_[START, self.token[:-1]] if len(self.token) else self.token
        context[self.first] = START
        self.words, self.word_of = np.unique(self.token, return_inverse=True)
        self.pair = tk.mix(context * np.uint64(tk.WORD_BASE) + self.token)
        self.pairs, self.pair_of = np.unique(self.pair, return_inverse=True)

    def with_triples(self) -> Tokens:
        later = np.flatnonzero(~self.first)
        self.triples, of = np.unique(tk.mix(self.pair[later - 1] * np.uint64(tk.BYTE_BASE) + self.token[later]), return_inverse=True)
        self.triple_of = np.full(len(self.token), -1)
        self.triple_of[later] = of
        return self

    def asked_triples(self, shared: np.ndarray) -> np.ndarray:
        """Which triples other blocks may have: those whose pairs both are in several blocks."""
        later = np.flatnonzero(~self.first)
        wide = shared[self.pair_of]
        out = np.zeros(len(self.triples), bool)
        out[self.triple_of[later]] = wide[later - 1] & wide[later]
        return out

    def counted(self, train: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        use = train[self.row] & (numbers >= 0)
        return np.bincount(numbers[use], minlength=n)


def _train(table: pa.Table) -> np.ndarray:
    return table.column("c0").to_numpy(zero_copy_only=False).astype(bool)


def _ask(parts: int):
    def run(key, table):
        t, train = Tokens(table), _train(table)
        words, pairs = t.counted(train, t.word_of, len(t.words)), t.counted(train, t.pair_of, len(t.pairs))
        cut_w, cut_p = part_cuts(t.words, parts), part_cuts(t.pairs, parts)
        rows = []
        for p in range(parts):
            w, x = slice(cut_w[p], cut_w[p + 1]), slice(cut_p[p], cut_p[p + 1])
            if w.start < w.stop or x.start < x.stop:
                rows.append((p, packed(narrow(t.words[w]), *_small(words[w]), narrow(t.pairs[x]), *_small(pairs[x]))))
        return message_rows([key[0].as_py()] * len(rows), [p for p, _ in rows], [x for _, x in rows])

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Each asker's counts summed over all askers, whether several ask for the key, and the sums by distinct key."""
    distinct, of, askers = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    sums = np.bincount(of, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return np.split(sums[of], cuts), np.split(askers[of] > 1, cuts), sums


def _answer(key, table):
    blocks, got = table.column("block").to_pylist(), [unpacked(x) for x in table.column("blob").to_pylist()]
    words, _, sums = _totals([widened(x[0]) for x in got], [_whole(x[1], x[2]) for x in got])
    pairs, shared, _ = _totals([widened(x[3]) for x in got], [_whole(x[4], x[5]) for x in got])
    part = key[0].as_py()
    told = [packed(part, *_small(w), *_small(p, s)) for w, p, s in zip(words, pairs, shared, strict=True)]
    size = packed(part, int(sums.sum()), int(np.count_nonzero(sums)))
    return message_rows([*blocks, SUMMING], [PAIRS] * (len(blocks) + 1), [*told, size])


def _told(table: pa.Table, about: int) -> list[tuple]:
    """The answers about one thing, in the order of their parts, which is that of their keys."""
    kind = table.column("part").to_numpy()
    return sorted((unpacked(x) for x in table.filter(pa.array(kind == about)).column("blob").to_pylist()), key=lambda x: x[0])


def _told_pairs(table: pa.Table, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = _told(table, PAIRS)
    words = np.concatenate([np.zeros(0, np.int64), *(_whole(x[1], x[2]) for x in got)])
    marked = [_marked(x[3], x[4]) for x in got]
    pairs = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in marked)])
    shared = np.concatenate([np.zeros(0, bool), *(x[1] for x in marked)])
    if len(words) != len(t.words) or len(pairs) != len(t.pairs):
        raise RuntimeError("a block's texts changed between asking and scoring; the input is not deterministic")
    return words, pairs, shared


def _ask_triples(blocks: int, parts: int, order: int):
    """Of a block, its triples; of the block that sums up, the corpus's totals for every block."""

    def run(key, texts, told):
        block = key[0].as_py()
        if block == SUMMING:
            got = _told(told, PAIRS)
            size = packed(0, sum(x[1] for x in got), sum(x[2] for x in got))
            return message_rows(list(range(blocks)), [TOTALS] * blocks, [size] * blocks)
        if not texts.num_rows or order < 3:
            return message_rows([], [], [])
        t = Tokens(texts).with_triples()
        ask = t.asked_triples(_told_pairs(told, t)[2])
        keys, counts = t.triples[ask], t.counted(_train(texts), t.triple_of, len(t.triples))[ask]
        cuts = part_cuts(keys, parts)
        rows = [(p, packed(narrow(keys[a:b]), *_small(counts[a:b]))) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return message_rows([block] * len(rows), [p for p, _ in rows], [x for _, x in rows])

    return run


def _answer_triples(key, table):
    part = key[0].as_py()
    if part == TOTALS:
        return table.select(["block", "part", "blob"])
    blocks, got = table.column("block").to_pylist(), [unpacked(x) for x in table.column("blob").to_pylist()]
    sums, _, _ = _totals([widened(x[0]) for x in got], [_whole(x[1], x[2]) for x in got])
    return message_rows(blocks, [TRIPLES] * len(blocks), [packed(part, *_small(x)) for x in sums])


class BackoffAutomaton:
    """The piece of the automaton that some texts can reach; weights are log10.

    States: 0 the root, 1 the start of a text, then the words, then the pairs of words.  fail[s]: where the failure arc of a
    state leads, and back[s] what it costs.  arcs: for every level of states the n-gram's number of an arc gives its
    weight (NaN: there is none) and where it leads.
    """

    def __init__(self, total, distinct, words, starts, pairs, pair_context, pair_word, triples, triple_pair, triple_last, order):
        self.base = np.log10((words + 0.5) / (total + 0.5 * (distinct + 1)))
        n_words = len(words)
        word_state = np.where(words > 0, np.arange(n_words) + 2, 0)
        pair_state = np.where(pairs > 0, np.arange(len(pairs)) + 2 + n_words, word_state[pair_word]) if order > 2 else word_state[pair_word]
        count = np.r_[0, starts, words, pairs].astype(float)
        mass = MASS * np.maximum(count, 1) ** GROWTH
        self.start = 1 if starts > 0 else 0
        self.fail = np.r_[0, 0, np.zeros(n_words, np.int64), word_state[pair_word]]
        self.back = np.where(count > 0, np.log10(mass / (count + mass)), 0.0)
        source = np.where(pair_context < 0, self.start, word_state[np.maximum(pair_context, 0)])
        smoothed = (pairs + mass[source] * 10.0 ** self.base[pair_word]) / (count[source] + mass[source])
        seen = (pairs > 0) & (source > 0)
        self.pair_arc, self.pair_to = np.where(seen, np.log10(smoothed), np.nan), pair_state
        self.root_to = word_state
        self.triple_arc = np.array([np.nan])
        if order > 2:
            source = triple_pair + 2 + n_words
            below = np.where(np.isnan(self.pair_arc[triple_last]), self.back[self.fail[source]] + self.base[pair_word[triple_last]], self.pair_arc[triple_last])
            smoothed = (triples + mass[source] * 10.0**below) / (count[source] + mass[source])
            self.triple_arc = np.r_[np.where((triples > 0) & (pairs[triple_pair] > 0), np.log10(smoothed), np.nan), np.nan]  # the last: no triple
        self.first_pair = 2 + n_words

    def step(self, state, word, pair, triple):
        """The weight of reading one token in each of some states, and the states reached."""
        weight = np.zeros(len(state))
        deep = state >= self.first_pair
        arc = np.full(len(state), np.nan)
        if deep.any():
            arc[deep] = self.triple_arc[triple[deep]]
        to = np.where(deep, self.pair_to[pair], 0)
        failed = deep & np.isnan(arc)
        weight[failed] += self.back[state[failed]]
        state = np.where(failed, self.fail[state], state)
        middle = (state > 0) & (state < self.first_pair) & np.isnan(arc)
        arc[middle] = self.pair_arc[pair[middle]]
        to[middle] = self.pair_to[pair[middle]]
        failed = middle & np.isnan(arc)
        weight[failed] += self.back[state[failed]]
        low = np.isnan(arc)
        arc[low], to[low] = self.base[word[low]], self.root_to[word[low]]
        return weight + arc, to

    def traverse(self, t: Tokens, n_rows: int, triples: np.ndarray) -> np.ndarray:
        """Log-probability of every text: all texts side by side from left to right, each carrying its state."""
        total = np.zeros(n_rows)
        begin = np.flatnonzero(t.first)
        length = np.diff(np.r_[begin, len(t.token)])
        rank = np.argsort(-length, kind="stable")
        begin, length, row = begin[rank], length[rank], t.row[begin[rank]]
        state, score = np.full(len(begin), self.start), np.zeros(len(begin))
        at, active = 0, len(begin)
        while active:
            active = int(np.searchsorted(-length, -at, "left"))  # texts with more than `at` tokens
            if active < ABREAST:
                break
            place = begin[:active] + at
            weight, state[:active] = self.step(state[:active], t.word_of[place], t.pair_of[place], triples[place])
            score[:active] += weight
            at += 1
        if active:
            self._one_by_one(t, triples, begin[:active], length[:active], at, state, score)
        total[row] = score
        return total

    def _one_by_one(self, t, triples, begin, length, at, state, score) -> None:
        """The rest of the longest texts, the same steps on plain numbers."""
        for k, (b, n) in enumerate(zip(begin.tolist(), length.tolist(), strict=True)):
            place = slice(b + at, b + n)
            word, pair, triple = t.word_of[place], t.pair_of[place], triples[place]
            third = self.triple_arc[triple].tolist()
            s, total, first_pair = int(state[k]), 0.0, self.first_pair
            fail, back = self.fail, self.back
            for w, p2, to2, p3, w_arc, w_to in zip(word.tolist(), self.pair_arc[pair].tolist(), self.pair_to[pair].tolist(), third, self.base[word].tolist(), self.root_to[word].tolist(), strict=True):
                if s >= first_pair:
                    if p3 == p3:
                        total += p3
                        s = to2
                        continue
                    total += back[s]
                    s = fail[s]
                if s > 0:
                    if p2 == p2:
                        total += p2
                        s = to2
                        continue
                    total += back[s]
                total += w_arc
                s = w_to
            score[k] += total


def _score(order: int):
    def run(key, texts, told):
        n = texts.num_rows
        if not n:
            return _RESULT.empty_table()
        t, train = Tokens(texts).with_triples(), _train(texts)
        words, pairs, shared = _told_pairs(told, t)
        (_, total, distinct), = _told(told, TOTALS)
        triples = np.zeros(0, np.int64)
        if order > 2:
            ask = t.asked_triples(shared)
            triples = t.counted(train, t.triple_of, len(t.triples))
            triples[ask] = np.concatenate([np.zeros(0, np.int64), *(_whole(x[1], x[2]) for x in _told(told, TRIPLES))])
        later = np.flatnonzero(~t.first)
        context = np.full(len(t.pairs), -1)
        context[t.pair_of[later]] = t.word_of[later - 1]
        word = np.zeros(len(t.pairs), np.int64)
        word[t.pair_of] = t.word_of
        triple_pair, triple_last = np.zeros(len(t.triples), np.int64), np.zeros(len(t.triples), np.int64)
        triple_pair[t.triple_of[later]], triple_last[t.triple_of[later]] = t.pair_of[later - 1], t.pair_of[later]
        end = int(np.searchsorted(t.words, END))
        model = BackoffAutomaton(total, distinct, words, int(words[end]), pairs, context, word, triples, triple_pair, triple_last, order)
        score = model.traverse(t, n, t.triple_of if order > 2 else np.full(len(t.token), -1))
        base = np.bincount(t.row, weights=model.base[t.word_of], minlength=n)
        known = np.bincount(t.row, weights=words[t.word_of] > 0, minlength=n).astype(np.int64)
        tokens = np.bincount(t.row, minlength=n)
        return pa.table([texts.column("doc_id"), pa.array(~train), pa.array(tokens), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(score)], schema=_RESULT)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, order: int = ORDER, block_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32 of the id as text, modulo folds, is not held_out (a null id
    counts as not), and scores every row.  Null and empty texts have one token, the end.  Repeated rows
    count as often as they occur.  Without any training row every probability is one.  Ids are integers;
    other columns are ignored.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    train = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out, F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    texts, n = blocked(rows, "doc_id", "text", ["train"], block_bytes)
    asked = texts.groupBy("block").applyInArrow(_ask(n), MESSAGE)
    told = by_block(by_part(asked, n).groupBy("part").applyInArrow(_answer, MESSAGE), n)
    more = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_ask_triples(n, n, order), MESSAGE)
    told_more = by_block(by_part(more, n).groupBy("part").applyInArrow(_answer_triples, MESSAGE), n)
    return texts.groupBy("block").cogroup(told.unionByName(told_more).groupBy("block")).applyInArrow(_score(order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
