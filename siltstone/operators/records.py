"""Provenance and metadata of records, chunks and blocks, and small table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- Fixed values that results depend on.
PROVENANCE = ("source_id", "connector", "uri", "source_format", "etag", "mtime", "author", "acl_principals", "sensitivity", "version", "language", "content_sha256")
CHUNK_FIELDS = ("chunk_id", "source_id", "ordinal", "heading_path", "parent_id", "chunk_type")
CAPTION_CHARS = 200


def provenance(records: DataFrame, raw: str = "raw") -> DataFrame:
    """The twelve scalar columns of a record, its principals joined by a pipe."""
    made = records.withColumns({"acl_principals": F.array_join("acl_principals", "|"), "content_sha256": F.sha2(F.col(raw), 256)})
    return made.select(*PROVENANCE)


def merged_maps(*maps: Column) -> Column:
    """Maps merged, the later one's value where keys meet."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(F.map_filter(out, _not_in(m)), m)
    return out


def _not_in(m: Column):
    return lambda k, _: ~F.map_contains_key(m, k)


def as_strings(columns: tuple[str, ...]) -> Column:
    """A map of the columns that have a value, as strings."""
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def chunk_metadata(chunks: DataFrame, own: tuple[str, ...] = PROVENANCE, extra: str = "metadata", tenant: str = "tenant_id") -> Column:
    """One map: the chunk's fields, over them its document's provenance, over that its own metadata, and the tenant last."""
    fields, shared = as_strings(tuple(c for c in CHUNK_FIELDS if c in chunks.columns)), as_strings(tuple(c for c in own if c in chunks.columns))
    last = F.create_map(F.lit(tenant), F.col(tenant).cast("string"))
    return merged_maps(fields, shared, F.map_filter(F.col(extra), lambda _, v: v.isNotNull()), last)


def scalar_metadata(metadata: Column) -> Column:
    """Lists as pipe-joined strings, nulls dropped, an empty map as {_: ''}; metadata is map<string, array<string>>."""
    kept = F.transform_values(F.map_filter(metadata, lambda _, v: v.isNotNull()), lambda _, v: F.array_join(v, "|"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.create_map(F.lit("_"), F.lit("")))


def block_metadata(blocks: DataFrame) -> DataFrame:
    """Scalars of extracted blocks: headers joined by a pipe, captions cut."""
    return blocks.select("block_id", "source_path", "source_format", "block_type", F.col("page_or_sheet").cast("string").alias("page_or_sheet"), F.nullif(F.array_join("headers", "|"), F.lit("")).alias("headers"), F.nullif(F.substring("image_caption", 1, CAPTION_CHARS), F.lit("")).alias("image_caption"))


def of_type(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.filter(F.col("block_type") == kind)


def limited(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that only the seed and their keys decide."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n)


def numeric_sums(rows: DataFrame) -> DataFrame:
    """(column, total) of every column with numbers in it."""
    numeric = [c for c, t in rows.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    sums = rows.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in numeric])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("total")) for c in numeric])).alias("x")).select("x.*")


def with_texts_id(rows: DataFrame, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """rows with found_id, the least id of the document with exactly that text."""
    known = docs.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("_digest")).agg(F.min(id_col).alias("found_id"))
    return rows.withColumn("_digest", F.sha2(F.col(text), 256)).join(known, "_digest", "left").drop("_digest")


def build_stats(current: DataFrame, existing: DataFrame, source: str = "source_id", chunk: str = "chunk_id") -> DataFrame:
    """(source, total, new, stale): chunks of each re-indexed source, how many the index lacks, and how many of the index's are gone."""
    a = current.select(source, chunk).distinct().withColumn("now", F.lit(1))
    b = existing.join(current.select(source).distinct(), source, "left_semi").select(source, chunk).distinct().withColumn("was", F.lit(1))
    both = a.join(b, [source, chunk], "full_outer")
    return both.groupBy(source).agg(F.count("now").alias("total"), F.count(F.when(F.col("was").isNull(), 1)).alias("new"), F.count(F.when(F.col("now").isNull(), 1)).alias("stale"))


def latest(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The row of each group whose name is last in order."""
    return rows.groupBy(by).agg(F.max(name).alias(name))
