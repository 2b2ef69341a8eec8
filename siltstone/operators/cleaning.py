"""Corpus cleaning: repeated lines, exact copies, MinHash near-duplicates, contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python import in_pieces, minhash_of, word_grams
from ..functions.text import lines, stripped
from ..functions.vectors import signature_similarity
from .lineage import cut

PERMUTATIONS, BANDS = 64, 16
#: Repeated lines, and checksums of word runs, that are sent to every task; more are met by joins.
LINES_AT_HAND, GRAMS_AT_HAND = 1_000, 1_000_000


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int = 3, max_len: int = 60, ratio: float = 0.5) -> DataFrame:
    """(line, n_docs): short lines found in many documents."""
    total = docs.agg(F.count("*").alias("total"))
    found = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.array_distinct(F.transform(lines(F.col(text_col)), stripped))).alias("line")).filter(F.char_length("line").between(1, max_len))
    counts = found.groupBy("line").agg(F.count("*").alias("n_docs"))
    least = F.greatest(F.lit(min_docs), F.floor(F.col("total") * ratio))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("n_docs") >= least).select("line", "n_docs")


def strip_lines(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' (id, text) without the repeated lines.

    Up to LINES_AT_HAND of them go to every task, and the texts stay where they are; more are met by a join on the
    distinct short lines of each text, and only what is found travels."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    longest = repeated.agg(F.coalesce(F.max(F.char_length("line")), F.lit(0)).alias("longest"), F.count("*").alias("n")).first()
    if longest["n"] <= LINES_AT_HAND:
        gone = repeated.agg(F.collect_list("line").alias("gone"))
        met = rows.crossJoin(F.broadcast(gone))  # one row
    else:
        short = F.filter(F.array_distinct(F.transform(lines(F.col("text")), stripped)), lambda x: F.char_length(x).between(0, longest["longest"]))
        found = rows.select("id", F.explode(short).alias("line")).join(repeated.select("line"), "line").groupBy("id").agg(F.collect_set("line").alias("gone"))
        met = rows.join(found, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    kept = F.filter(lines(F.col("text")), lambda x: ~F.array_contains("gone", stripped(x)))
    return met.select("id", F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("text"))


def exact_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, first_id, n): groups of equal texts."""
    return docs.groupBy(F.sha2(F.col(text_col), 256).alias("digest")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.85, bands: int = BANDS, permutations: int = PERMUTATIONS, k: int = 5) -> DataFrame:
    """(later, earlier, similarity): pairs of documents whose signatures are at least that similar, between first documents, and each
    other document with the first one of the same signature.

    Documents of equal signatures are folded to the first before bands meet, so a group of copies makes one bucket entry.
    Buckets carry ids alone; signatures are joined to the distinct candidates.  A text without a shingle is like no other.
    """
    signed = docs.select(F.col(id_col).alias("id"), minhash_of(F.col(text_col), permutations, k).alias("sig")).filter("sig is not null")
    signed = cut(signed.withColumn("fold", F.sha2(F.array_join("sig", ","), 256)))
    first = signed.groupBy("fold").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    width = permutations // bands
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * width + 1, F.lit(width))))
    banded = first.select("id", F.explode(band).alias("bucket"))
    a, b = banded.select(F.col("id").alias("later"), "bucket"), banded.select(F.col("id").alias("earlier"), "bucket")
    candidates = a.join(b, "bucket").filter("earlier < later").select("later", "earlier").distinct()
    sigs = first.select("id", "sig")
    met = candidates.join(sigs.select(F.col("id").alias("later"), F.col("sig").alias("a")), "later").join(sigs.select(F.col("id").alias("earlier"), F.col("sig").alias("b")), "earlier")
    near = met.select("later", "earlier", signature_similarity(F.col("a"), F.col("b")).alias("similarity")).filter(F.col("similarity") >= threshold)
    copies = signed.select("id", "fold").join(first.select("fold", F.col("id").alias("earlier")), "fold").filter("earlier < id").select(F.col("id").alias("later"), "earlier", F.lit(1.0).alias("similarity"))
    return near.unionByName(copies)


def band_table(signed: DataFrame, id_col: str, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, band, bucket) of signatures (a column sig): kept between runs, it lets new documents meet old ones."""
    width = permutations // bands
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.md5(F.array_join(F.slice("sig", i * width + 1, F.lit(width)), ",")))
    return signed.select(id_col, F.posexplode(keys).alias("band", "bucket"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, k: int = 8) -> DataFrame:
    """(id, item_id, shared): documents that share runs of k words with an item.

    Up to GRAMS_AT_HAND of the items' runs go to every task as checksums, and only runs that have one of those are made and shuffled."""

    def grams(df: DataFrame, own: str, text: str, name: str, among: frozenset[int] | None = None) -> DataFrame:
        made = lambda i, t: ((i, g) for g in word_grams(t, k, among))
        schema = f"{name} {df.schema[own].dataType.simpleString()}, gram string"
        return df.select(own, text).mapInArrow(in_pieces(made, schema), schema)

    b = cut(grams(items, item_id, item_text, "item_id"))
    known = b.select(F.crc32(F.col("gram").cast("binary")).alias("c")).distinct().limit(GRAMS_AT_HAND + 1).collect()
    among = frozenset(r["c"] for r in known) if len(known) <= GRAMS_AT_HAND else None
    a = grams(docs, id_col, text_col, "id", among)
    return a.join(b, "gram").groupBy("id", "item_id").agg(F.count("*").alias("shared"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
