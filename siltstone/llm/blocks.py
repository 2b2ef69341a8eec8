"""Blocks of documents that ask questions about hashed keys of the whole corpus.

Rows are dealt to blocks of bounded size.  A block sends each part of the key
space one packed row with its sorted distinct keys, a part sends each block
one packed row back, and the block reads the answers beside its texts.  Rows
are few and keys are folded within a block first, so a key that occurs in a
third of all rows costs at most one entry for each block.  The text moves
once: every step reads the same exchange.  Empty messages are not sent, so there are
never more rows than keys; sent keys are sorted, and only their differences move.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, on average: as many as make BLOCKS blocks, but no fewer than the first and no more than the second.
BLOCK_BYTES, LARGEST_BLOCK_BYTES, BLOCKS = 8 << 20, 64 << 20, 4096


def blocked(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, text, carried columns, block) dealt by block, and the number of blocks.

    Carried columns are renamed c0, c1 ... so that no name clashes.  Rows are dealt by id, text and the input partition they
    come from, so repeated ids, null ids and equal texts are spread, and a lost task deals its rows as before.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)) + 64 * F.count("*")).first()[0]
    size = block_bytes or min(max(BLOCK_BYTES, int(total) // BLOCKS), LARGEST_BLOCK_BYTES)
    n = max(1, -(-int(total) // size))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])),
    )
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int"))
    return rows.repartition(n, "block"), n


def packed(*values) -> bytes:
    return pickle.dumps(values, protocol=5)


def unpacked(blob) -> tuple:
    return pickle.loads(blob)


def part_cuts(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of the 64-bit key space begins in sorted_keys; parts + 1 places."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(sorted_keys, edges), len(sorted_keys)]


def narrow(keys: np.ndarray) -> tuple:
    """Sorted distinct keys as the first one and the differences, in as few bytes each as the largest needs."""
    if not len(keys):
        return 0, 0, 8, b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return len(keys), int(keys[0]), width, np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(form: tuple) -> np.ndarray:
    """The keys of narrow()."""
    n, first, width, raw = form
    if not n:
        return np.zeros(0, np.uint64)
    steps = np.zeros((n - 1, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = steps.view("<u8").ravel()
    return np.cumsum(out, dtype=np.uint64)


def by_part(messages: DataFrame, parts: int) -> DataFrame:
    """Messages dealt to as many tasks as there are parts, so that a task doesn't grow with the data."""
    return messages.repartition(parts, "part")


def by_block(messages: DataFrame, blocks: int) -> DataFrame:
    """Messages dealt as the blocks are: cogroups of texts with them, or with unions of them, read this exchange as it is."""
    return messages.repartition(blocks, "block")


def message_rows(block: list[int], part: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "part": pa.array(part, pa.int32()), "blob": pa.array(blob, pa.binary())})


MESSAGE = "block int, part int, blob binary"


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[starts[i]:ends[i]] for all i, laid end to end, and their offsets."""
    lengths = ends - starts
    offsets = np.r_[0, np.cumsum(lengths)]
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[at], offsets


def among(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether sorted_keys has it, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at
