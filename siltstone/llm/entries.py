"""Queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def op1_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramlm import score_documents

    return score_documents(_docs(spark, sf_dir))


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmlextract import extract_pages

    return extract_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id"))


def op3_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixtrees import remove_repeats

    return remove_repeats(_docs(spark, sf_dir), output="sha256")


def op5_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_docs(spark, sf_dir))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op8_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwtmerge import remove_repeated_bytes

    return remove_repeated_bytes(_docs(spark, sf_dir), output="sha256")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bytebpe import encode_documents

    return encode_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_docs(spark, sf_dir), shards=24).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_backoff_automaton": op1_backoff_automaton, "op2_wrapper_induction": op2_wrapper_induction, "op3_latent_retrieval": op3_latent_retrieval, "op4_suffix_trees": op4_suffix_trees, "op5_string_kernels": op5_string_kernels, "op6_weak_supervision": op6_weak_supervision, "op7_simhash": op7_simhash, "op8_bwt_merge": op8_bwt_merge, "op9_byte_bpe": op9_byte_bpe, "op10_lpt_sharding": op10_lpt_sharding}


#: The words of texts, the least document of every 13-word window, the places covered by windows that an earlier document has.
OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i+12], ' '))) as k, unnest(generate_series(1, len(w) - 12)) as i from w where len(w) > 12),
m as (select k, min(doc_id) as d from x group by k),
b as (select distinct x.doc_id, x.i + o.o as p from x join m using (k) cross join (select unnest(generate_series(0, 12)) as o) o where m.d < x.doc_id),
t as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as p from w),
a as (select t.doc_id, count(*) as n_words, count(b.p) as n_removed, string_agg(t.word, ' ' order by t.p) filter (where b.p is null) as kept from t left join b on b.doc_id = t.doc_id and b.p = t.p group by t.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join a using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express exactly; the other operators' tests hold them against brute force."""
    return {"op4_suffix_trees": OP4_SQL}
