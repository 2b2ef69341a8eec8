"""File, object-store, table and page sources: listings first, bodies only for what changed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frontmatter
from ..operators.governance import label_sensitivity

RECORD = "source_id string, connector string, uri string, source_format string, etag string, mtime double, author string, acl_principals array<string>, sensitivity string, version string, language string, extra map<string,string>"
FORMATS = {"md": "markdown", "txt": "text", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "html": "html", "htm": "html"}
GOLDEN = "id string, question string, slice string, expected_doc_ids array<string>, expected_answer_contains array<string>, must_abstain boolean, difficulty string, language string, notes string"


def suffix_format(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("unknown"))


def list_files(spark: SparkSession, root: str, patterns: str = "*.{md,txt,pdf,docx,xlsx,html}", since: str | None = None) -> DataFrame:
    """(path, mtime, size): the body column is pruned, so no file is read.  since: an ISO time; older files are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", patterns)
    if since:
        reader = reader.option("modifiedAfter", since)
    return reader.load(root).select(F.col("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def _relative(path: Column, root: str) -> Column:
    clean = root.split(":", 1)[-1].lstrip("/").rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/*", ""), rf"^\Q{clean}\E/", "")


def file_records(spark: SparkSession, root: str, **options) -> DataFrame:
    """Envelopes with source_id fs:<relative path> and etag <microseconds>:<size>."""
    rel = _relative(F.col("path"), root)
    return list_files(spark, root, **options).select(
        F.concat(F.lit("fs:"), rel).alias("source_id"), F.lit("fs").alias("connector"), F.col("path").alias("uri"), suffix_format(F.col("path")).alias("source_format"),
        F.concat_ws(":", F.unix_micros("mtime").cast("string"), F.col("size").cast("string")).alias("etag"), (F.unix_micros("mtime") / 1e6).alias("mtime"),
    )


def file_bodies(spark: SparkSession, root: str, wanted: DataFrame, patterns: str = "*") -> DataFrame:
    """(uri, raw) of the wanted uris: a semi join on the listing; Spark reads the content column of those files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", patterns).load(root)
    return files.select(F.col("path").alias("uri"), F.col("content").alias("raw")).join(wanted.select("uri"), "uri", "left_semi")


def object_records(spark: SparkSession, root: str, bucket: str) -> DataFrame:
    """Envelopes of an object store's files with the MD5 of their bodies as etag; hidden files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = _relative(F.col("path"), root)
    return files.filter(~F.col("path").rlike(r"/\.")).select(
        F.concat(F.lit(f"objectstore:{bucket}/"), rel).alias("source_id"), F.lit("objectstore").alias("connector"), F.col("path").alias("uri"), suffix_format(F.col("path")).alias("source_format"), F.md5("content").alias("etag"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.lit("internal").alias("sensitivity"),
    )


def markdown_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, body, meta): one row a file, its frontmatter parsed; acl and others stay in meta."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc_id"), frontmatter(F.col("value")).alias("f"))
    return rows.select("doc_id", F.col("f.body").alias("body"), F.col("f.meta").alias("meta"))


def table_records(table: DataFrame, name: str, key: str, text_cols: list[str], watermark: str | None = None, cursor: str | None = None) -> DataFrame:
    """Rows as records: body joined from the non-empty text columns, etag the watermark; from the cursor on, that itself included."""
    rows = table.filter(F.col(watermark).cast("string") >= cursor) if watermark and cursor else table
    body = F.concat_ws("\n\n", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in text_cols])
    return rows.select(F.concat(F.lit(f"sql:{name}:"), F.col(key).cast("string")).alias("source_id"), F.lit("sql").alias("connector"), body.alias("body"), (F.col(watermark).cast("string") if watermark else F.lit("")).alias("etag"))


def jdbc_table(spark: SparkSession, url: str, table: str, watermark: str | None = None, cursor: str | None = None, **properties: str) -> DataFrame:
    """A JDBC table; the watermark filter is pushed down to the database."""
    df = spark.read.jdbc(url, table, properties=properties)
    return df.filter(F.col(watermark) >= cursor) if watermark and cursor else df


PAGE = "results array<struct<id:string,title:string,space:struct<key:string>,version:struct<number:long,by:struct<displayName:string>,whenEpoch:double>,metadata:struct<labels:struct<results:array<struct<name:string>>>>,body:struct<storage:struct<value:string>>>>"


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of exported wiki pages: etag v<version>, acl from labels acl-*, sensitivity from the other labels."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path).select(F.explode("results").alias("p"))
    labels = F.coalesce(F.transform(F.col("p.metadata.labels.results"), lambda x: x["name"]), F.array().cast("array<string>"))
    return pages.select(
        F.concat(F.lit("confluence:"), F.col("p.id")).alias("source_id"), F.lit("confluence").alias("connector"), F.col("p.title").alias("title"), F.concat(F.lit("v"), F.col("p.version.number")).alias("etag"), F.col("p.version.whenEpoch").alias("mtime"), F.col("p.version.by.displayName").alias("author"),
        F.filter(labels, lambda x: x.startswith("acl-")).alias("acl_principals"), label_sensitivity(labels).alias("sensitivity"), F.col("p.body.storage.value").alias("html"),
    )


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines give nulls, a missing path an empty table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def concatenated_json(text: str) -> list[dict]:
    """Objects written one after the other over any number of lines (small files)."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while (at := len(text) - len(text[at:].lstrip())) < len(text):
        value, at = decoder.raw_decode(text, at)
        out.append(value)
    return out


def question_bank(spark: SparkSession, path: str) -> DataFrame:
    """(slice, number, question, answer) of markdown with **Qn. ...** and A. ... lines under ## headings."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.split("value", r"(?m)^##\s+")).alias("part"))
    found = F.regexp_extract_all("part", F.lit(r"\*\*Q\d+\.\s*.*?\*\*\s*\n+A\.\s*[^\n]*"), F.lit(0))
    rows = parts.select(F.trim(F.substring_index("part", "\n", 1)).alias("slice"), F.explode(found).alias("qa"))
    return rows.select("slice", F.regexp_extract("qa", r"\*\*Q(\d+)\.", 1).cast("int").alias("number"), F.regexp_extract("qa", r"\*\*Q\d+\.\s*(.*?)\*\*", 1).alias("question"), F.regexp_extract("qa", r"\nA\.\s*([^\n]*)", 1).alias("answer"))


def tenant_registry(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, plan, custom limits) of a JSON object keyed by tenant."""
    limits = "max_queries_per_day: bigint, max_tokens_per_day: bigint, max_chunks_indexed: bigint"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<plan: string, custom_quota: struct<{limits}>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("tenant_id", "t"))
    return rows.select("tenant_id", F.coalesce("t.plan", F.lit("free")).alias("plan"), *[F.col(f"t.custom_quota.{c}").alias(f"custom_{c}") for c in ("max_queries_per_day", "max_tokens_per_day", "max_chunks_indexed")])
