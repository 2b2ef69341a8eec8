"""The corpus pipeline: language identification, near-duplicate removal, substring removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and its decisions take effect:
rejected rows go, removed words are gone from the text.  run() writes each stage's rows to the shared folder and
reads them back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bytebpe import encode_documents
from siltstone.llm.decontaminate import clean_documents
from siltstone.llm.langid import UNKNOWN, fit_languages, predict_languages
from siltstone.llm.nearcopies import near_copies
from siltstone.llm.shared import written
from siltstone.llm.suffixtrees import remove_repeats

#: Merged pieces a worker remembers in the last stage: fewer than elsewhere, since all stages share the executors' memory.
KEPT_PIECES = 200_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a known language; a text that is null or has no letter goes."""
    model = fit_languages(docs)
    return predict_languages(docs, model, keep=tuple(COLUMNS[:1] + COLUMNS[2:]) + ("text",)).filter(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more), the row with the smallest doc_id."""
    groups = near_copies(docs, similarity=0.8, width=5).filter("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    first = docs.join(groups, docs["doc_id"].eqNullSafe(groups["doc_id"]), "left_semi")
    return first.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has; rows left without a word go."""
    kept = remove_repeats(docs, carry=["lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    return kept.filter(~changed | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any item of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), kept_pieces=KEPT_PIECES, forget=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
