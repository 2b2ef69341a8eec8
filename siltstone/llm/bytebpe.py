"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is split by the tokenizer's pattern; each piece is encoded on its own.
The tree's leaves are byte positions: the leaf of a live position holds the
rank of the pair it starts with its live right neighbour, inner nodes hold the
least rank below, and walking down from the root to the left finds the
leftmost least pair.  A merge updates two or three leaves in logarithmic time,
so a piece of n bytes takes O(n log n) even when it is a whole document.

Encoding is a map without any shuffle: bounded memory, and a lost task is
simply run again.  The vocabulary's ranks travel with the task (under 1 MB).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import given_back

#: Encoded pieces kept by a worker; beyond it the table is started anew.
CACHE_PIECES = 800_000
#: Pieces longer than this are not kept.
CACHE_LENGTH = 64
_NONE = 1 << 60


class ByteBPE:
    """ranks: token bytes -> id.  Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept_pieces: int = CACHE_PIECES):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.kept, self.kept_pieces = _Kept(self), kept_pieces

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 0:
            return []
        width = 1 << (n - 1).bit_length()
        get = ranks.get
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = get(piece[i : i + 2], _NONE)
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after = list(range(1, n + 1))  # start of the next live token
        before = list(range(-1, n - 1))

        while (least := tree[1]) != _NONE:
            node = 1
            while node < width:
                node *= 2
                if tree[node] != least:
                    node += 1
            i = node - width
            gone = after[i]
            end = after[gone]
            after[i] = end
            changes = [(gone, _NONE), (i, _NONE)]
            if end < n:
                before[end] = i
                changes[1] = (i, get(piece[i : after[end]], _NONE))
            left = before[i]
            if left >= 0:
                changes.append((left, get(piece[left:end], _NONE)))
            for at, rank in changes:
                node = width + at
                tree[node] = rank
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    low = a if a <= b else b
                    if tree[node] == low:
                        break
                    tree[node] = low
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(ranks[piece[i:end]])
            i = end
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        kept = self.kept
        out = b"".join(map(kept.__getitem__, self.split(text)))
        if len(kept) > self.kept_pieces:
            kept.clear()
        return out

    def encode(self, text: str) -> list[int]:
        return list(_unpack(self.packed(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Kept(dict):
    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.bpe.piece(piece.encode("utf-8")))
        if array("H", [1]).tobytes() != b"\x01\x00":
            ids.byteswap()
        packed = ids.tobytes()
        if len(piece) <= CACHE_LENGTH:
            self[piece] = packed
        return packed


def _unpack(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    if array("H", [1]).tobytes() != b"\x01\x00":
        ids.byteswap()
    return ids


def read_ranks(path: str) -> bytes:
    """The rank file, compressed, to be sent with tasks."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def parse_ranks(packed: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in zlib.decompress(packed).splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


_loaded: dict[tuple[bytes, str, int], ByteBPE] = {}


def _loaded_bpe(packed: bytes, pattern: str, kept_pieces: int) -> ByteBPE:
    key = (hashlib.sha256(packed).digest(), pattern, kept_pieces)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(parse_ranks(packed), pattern, kept_pieces)
    return _loaded[key]


_FIELDS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), kept_pieces: int = CACHE_PIECES, forget: bool = False) -> DataFrame:
    """One row per row of docs: doc_id and the outputs asked for.

    outputs: of n_tokens, ids, decoded (bytes made from the ids), ids_sha256 and decoded_sha256.
    kept_pieces bounds what a worker remembers, and with forget it remembers nothing beyond a task; neither changes a result.
    Null and empty texts have no tokens.  Texts are never cut.  Repeated rows give repeated
    results; other columns of docs are ignored.
    """
    packed = read_ranks(ranks_path)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    fields = [_FIELDS[x] for x in outputs]

    def run(batches):
        bpe = _loaded_bpe(packed, pattern, kept_pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made: list[list] = [[] for _ in outputs]
                for text in part.column("text").to_pylist():
                    ids = bpe.packed(text or "")
                    numbers = _unpack(ids)
                    decoded = bpe.decode(numbers)
                    for out, name in zip(made, outputs, strict=True):
                        if name == "n_tokens":
                            out.append(len(numbers))
                        elif name == "ids":
                            out.append(numbers.tolist())
                        elif name == "decoded":
                            out.append(decoded)
                        elif name == "ids_sha256":
                            out.append(hashlib.sha256(ids).hexdigest())
                        else:
                            out.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, f[1]) for x, f in zip(made, fields, strict=True))], ["doc_id", *outputs])

    def forgetful(batches):
        try:
            yield from run(batches)
        finally:
            _loaded.clear()

    return own.mapInArrow(given_back(forgetful) if forget else run, f"doc_id {id_type}, " + ", ".join(f"{n} {f[0]}" for n, f in zip(outputs, fields, strict=True)))
