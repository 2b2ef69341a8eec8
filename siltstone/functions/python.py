"""The few text functions that need Python: Arrow-batched, never row by row through the JVM."""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .security import PII_PATTERNS, SECRET_TYPES
from .text import INVISIBLE, WHITE_CHARS


#: Texts that are Python strings at once, and characters of results that are.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 64, 1 << 20


def in_pieces(make: Callable[..., Iterable[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: make(*values of a row) gives rows of the schema (a DDL string).

    However many rows a batch has, and however many are made of one, memory holds a few texts and CHARS_AT_ONCE of results."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                for values in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    for row in make(*values):
                        rows.append(row)
                        size += 32 + sum(len(x) for x in row if isinstance(x, str))
                        if size > CHARS_AT_ONCE:
                            yield done()
                            size = 0
        if rows:
            yield done()

    return run


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


_BLANKS, _LINES = re.compile("[ \u3000]{2,}"), re.compile(r"\n{3,}")
_ENDS = re.compile(f"[{''.join(c for c in WHITE_CHARS if c not in '\n\r')}]+(?=[\n\u0085\u2028\u2029]|\\Z)")
_RARE = [c for c in WHITE_CHARS if c not in " \n"]


def normal(t: str | None) -> str:
    """tidy() of the compatibility form, without its patterns where a text has nothing for them."""
    t = t or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        for c in INVISIBLE:
            t = t.replace(c, "")
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = t.replace("\t", " ")
    if "  " in t or "\u3000" in t:
        t = _BLANKS.sub(" ", t)
    if "\n\n\n" in t:
        t = _LINES.sub("\n\n", t)
    t = t.strip(WHITE_CHARS)
    return _ENDS.sub("", t) if " \n" in t or any(c in t for c in _RARE) else t


@pandas_udf(StringType())
def _normal(text: pd.Series) -> pd.Series:
    return text.map(normal)


def normalize(text: Column) -> Column:
    """Compatibility form and tidying; ids must be computed after this."""
    return _normal(text)


def _grams(units, k: int, glue: str) -> list[str]:
    """Distinct runs of k units in order; fewer units make one run, none make none."""
    whole = glue.join(units)
    if len(units) <= k:
        return [whole] if whole else []
    if not glue and isinstance(units, str):
        return list(dict.fromkeys(whole[i : i + k] for i in range(len(units) - k + 1)))
    ends = list(accumulate(len(u) + len(glue) for u in units))  # of each unit with its glue
    return list(dict.fromkeys(whole[a : b - len(glue)] for a, b in zip([0, *ends], ends[k - 1 :], strict=False)))


def shingle_list(t: str | None, k: int = 5) -> list[str]:
    """k-word shingles of English-like text, in lower case; k-character ones of anything else, without white space where CJK letters are many."""
    t = t or ""
    raw = t.encode("utf-8", "surrogatepass")
    cjk, latin = 0 if t.isascii() else len(_CJK.findall(t)), len(raw) - len(raw.translate(None, _LETTERS))
    if cjk + latin >= 5 and cjk / (cjk + latin) <= 0.1:
        return _grams(_LOWER_WORD.findall(t.lower()), k, " ")
    return _grams("".join(t.split()) if cjk + latin >= 5 else t.lower(), k, "")


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct shingles in order (see shingle_list).

    In Python because the JVM's slice() copies the whole array for every shingle, which is quadratic in long texts."""

    @pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: shingle_list(t, k))

    return run.asNondeterministic()(text)  # else filters on the result would run it again


_M61 = (1 << 61) - 1


def _mod61(v: np.ndarray) -> np.ndarray:
    """v modulo 2**61 - 1, for v below twice that: below zero wraps around, and so is the larger."""
    return np.minimum(v, v - np.uint64(_M61))


def _times61(x: np.ndarray, a: int) -> np.ndarray:
    """a x modulo 2**61 - 1, for x and a of at most 60 and 32 bits."""
    out = np.zeros_like(x)
    for n in (40, 20, 0):  # from the highest 20 bits: what there is, times 2**20, and the next times a
        high = out >> np.uint64(41)
        out = _mod61((out << np.uint64(20) & np.uint64(_M61)) + high)
        part = (x >> np.uint64(n) & np.uint64((1 << 20) - 1)) * np.uint64(a)
        out = _mod61(out + part)
    return out


def min_hashes(x: np.ndarray, permutations: int) -> np.ndarray:
    """The least (a x + b) mod 2**61 - 1 over 60-bit numbers x, for each of the permutations a = (i * 2654435761 + 1) | 1, b = i * 40503 + 17.

    a is i P + 1 for even i and i P + 2 for odd, so the permutations two on differ by the same number, and a table of
    n of them with n steps added has the next n: no product for each."""
    prime, best = np.uint64(_M61), np.empty((2, -(-permutations // 2)), np.uint64)
    y = _times61(x, 2_654_435_761)
    step = _mod61(_mod61(y + y) + np.uint64(2 * 40_503))
    first = np.stack([_mod61(x + np.uint64(17)), _mod61(_mod61(_mod61(y + x) + x) + np.uint64(40_503 + 17))])
    best[:] = prime
    size = best.shape[1]
    for at in range(0, len(x), 1024):  # small tables stay in cache
        by, made = step[at : at + 1024], 1
        table = np.empty((2, size, len(by)), np.uint64)
        table[:, 0] = first[:, at : at + 1024]
        while made < size:
            more = table[:, made : 2 * made]
            np.add(table[:, : more.shape[1]], by, out=more)
            np.minimum(more, more - prime, out=more)
            made, by = 2 * made, _mod61(by + by)
        np.minimum(best, table.min(axis=2), out=best)
    return best.T.ravel()[:permutations].astype(np.int64)


def minhash_of(text: Column, permutations: int = 64, k: int = 5) -> Column:
    """MinHash signature of a text's shingles, by MD5 and so the same in any engine; null where there are none."""

    md5 = hashlib.md5

    def one(t: str | None):
        found = shingle_list(t, k)
        if not found:
            return None
        digests = b"".join([md5(g.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for g in found])
        return min_hashes(np.frombuffer(digests, ">u8")[::2].astype(np.uint64) >> np.uint64(4), permutations)  # 15 hexadecimal digits

    @pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run.asNondeterministic()(text)  # else filters on the result would run it again


def word_grams(t: str | None, k: int, among: frozenset[int] | None = None) -> list[str]:
    """Distinct runs of k lower-case words of letters and digits; with among, those whose CRC is in it."""
    words = _LOWER_WORD.findall((t or "").lower())
    if among is None:
        return _grams(words, k, " ")
    runs = (" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))
    return list(dict.fromkeys(g for g in runs if g and zlib.crc32(g.encode()) in among))


_CJK, _LETTERS, _LOWER_WORD = re.compile("[一-鿿]"), string.ascii_letters.encode(), re.compile("[a-z0-9]+")
_RULES = [(kind, re.compile(pattern)) for kind, pattern in PII_PATTERNS]
LONG_NUMBERS = ("cn_mobile", "bank_card", "cn_id_card")


#: What a text must have for a rule to be worth trying.
_NEEDED = {
    "private_key": lambda t: "-----BEGIN " in t, "db_dsn": lambda t: "://" in t, "jwt": lambda t: "eyJ" in t, "api_key": re.compile("AKIA|sk-|ghp_|xox").search,
    "cn_id_card": re.compile(r"\d{17}").search, "bank_card": re.compile(r"\d{15}").search, "cn_mobile": re.compile(r"\d{11}").search, "email": lambda t: "@" in t, "ipv4": re.compile(r"\d\.\d").search,
}


_MANY_DIGITS = re.compile(r"\d{11}")  # that any of LONG_NUMBERS needs


def find_pii(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) in text order; where hits overlap, the earlier rule's stands."""
    import bisect

    starts: list[int] = []
    found: list[tuple[int, int, str]] = []
    digits = _MANY_DIGITS.search(text)
    for kind, rule in _RULES:
        if (kind in LONG_NUMBERS and not digits) or not _NEEDED[kind](text):
            continue
        for hit in rule.finditer(text):
            a, b = hit.span()
            at = bisect.bisect_left(starts, b)
            if at and found[at - 1][1] > a:
                continue
            starts.insert(at, a)
            found.insert(at, (a, b, kind))
    return found


def hidden(value: str, kind: str) -> str:
    if kind == "email":
        name, _, domain = value.partition("@")
        return name[:1] + "*" * max(3, len(name) - 1) + "@" + domain
    if kind in LONG_NUMBERS and len(value) > 7:
        return value[:3] + "*" * (len(value) - 7) + value[-4:]
    return "*" * len(value)


def redacted(text: str, how: str, kinds: tuple[str, ...] | None = None, found: list[tuple[int, int, str]] | None = None) -> str:
    """how: mask, hash or drop.  found: what find_pii() says, where that is known."""
    out, at = [], 0
    for a, b, kind in find_pii(text) if found is None else found:
        if kinds is not None and kind not in kinds:
            continue
        value = text[a:b]
        new = {"mask": lambda v=value, k=kind: hidden(v, k), "hash": lambda v=value, k=kind: f"<{k.upper()}:{hashlib.sha256(v.encode()).hexdigest()[:8]}>", "drop": lambda k=kind: f"<{k.upper()}>"}[how]()
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def redact(text: Column, how: str = "mask") -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redacted(t, how), na_action="ignore")

    return run(text)


@pandas_udf(StringType())
def redact_for_index(text: pd.Series) -> pd.Series:
    """Secrets dropped, then personal data masked."""

    def one(t: str) -> str:
        found = find_pii(t)
        if any(kind in SECRET_TYPES for _, _, kind in found):
            return redacted(redacted(t, "drop", SECRET_TYPES, found), "mask")
        return redacted(t, "mask", None, found)  # nothing was dropped, so the same is found

    return text.map(one, na_action="ignore")


def redact_for_trace(text: Column, max_len: int = 200) -> Column:
    return F.substring(redact(text, "hash"), 1, max_len)


@pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("type", StringType())])))
def _pii_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b, "type": k} for a, b, k in find_pii(t)] if t is not None else None)


pii_spans = _pii_spans.asNondeterministic()


@pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two strings."""

    def one(x, y):
        if x is None or y is None:
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(x):
            masks[c] = masks.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        s = full
        for c in y:
            u = s & masks.get(c, 0)
            s = (s + u | s - u) & full
        return len(x) - s.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


#: Tokens whose bucket a worker remembers.
BUCKETS_KEPT = 100_000


def hash_embedder(dim: int = 64):
    """A deterministic embedder: token counts in hash buckets, unit length.  Any `list[str] -> list[list[float]]` fits in its place."""

    class Buckets(dict):
        """Buckets of tokens met before, up to a number of them."""

        def __missing__(self, tok: str) -> int:
            if len(self) >= BUCKETS_KEPT:
                self.clear()
            n = self[tok] = int.from_bytes(hashlib.blake2b(tok.encode(), digest_size=4).digest(), "big") % dim
            return n

    bucket = Buckets()

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for tok in re.findall(r"[a-z]+|\d+|[一-鿿]", t.lower()):
                v[bucket[tok]] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def embed_with(embedder, text: Column, batch: int = 32, attempts: int = 3, wait: float = 0.5) -> Column:
    """An embedding column from a batch embedder, in batches, retried with doubling waits."""
    import time

    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        out: list = []
        values = s.fillna("").tolist()
        for at in range(0, len(values), batch):
            for n in range(attempts):
                try:
                    out += embedder(values[at : at + batch])
                    break
                except (ConnectionError, TimeoutError, OSError):
                    if n == attempts - 1:
                        raise
                    time.sleep(min(10.0, wait * 2**n))
        return pd.Series(out)

    return run(text)


def generate_with(model, prompt: Column, fallback: str = "") -> Column:
    """A text column from a `str -> str` model; a failing call gives the fallback."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(p):
            try:
                return model(p) or fallback
            except Exception:  # one failed call mustn't fail the batch
                return fallback

        return s.map(one, na_action="ignore")

    return run(prompt)
