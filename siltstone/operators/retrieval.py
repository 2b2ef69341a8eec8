"""Lexical, dense and hybrid retrieval for batches of queries.

Queries are a table like the documents: postings are joined on terms, scores are summed
per query and document, and the best k are kept with a ranked window that Spark
prunes before its shuffle.  Only the query side is ever broadcast, and only by
Catalyst's own size threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.python import in_pieces
from ..functions.text import tokens
from .lexical import best_by_terms, count_terms
from .lineage import cut
from .nearest import nearest, similar_pairs  # noqa: F401  (pairs are part of retrieval)

K1, B = 1.5, 0.75
OKAPI_EPSILON = 0.25
#: Bytes of query terms that are broadcast.
QUERY_BLOCK_BYTES = 32 << 20
#: Digits to which scores are rounded before they are ranked, so that equal texts tie.
RANKED_DIGITS = 6


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): case-sensitive tokens; dl counts all tokens of the document."""
    toks = tokens(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), toks.alias("toks")).select("id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))  # outer: no filter that tokenises again
    return rows.filter("term is not null").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def top_k(scored: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank, ties by the tie column."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", okapi: bool = False, digits: int = RANKED_DIGITS) -> DataFrame:
    """(query_id, id, rank, score): the k best of bm25_scores() for each query, rounded, ties by id.

    Nothing is kept for each pair of query and document: one pass counts the queries' terms in each text where it is, another adds
    up the scores of some documents at a time and keeps each query's best, and only those are shuffled.  Queries whose terms
    are measured over QUERY_BLOCK_BYTES are met by joins."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 56), F.lit(0))).first()[0]
    if size > QUERY_BLOCK_BYTES:
        return top_k(bm25_scores(docs, queries, id_col, text_col, query_id, query_text, okapi).withColumn("score", F.bround("score", digits)), ["query_id"], "score", "id", k).select("query_id", "id", "rank", "score")
    wanted = sorted((r["term"], r["query_id"], r["qtf"]) for r in asked.collect() if r["query_id"] is not None)
    wanted += [(r["term"], None, r["qtf"]) for r in asked.filter("query_id is null").collect()]
    codes = {t: n for n, t in enumerate(sorted({t for t, _, _ in wanted}))}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type, query_type = rows.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    made = cut(rows.mapInArrow(count_terms(codes), f"id {id_type}, dl int, codes array<int>, tfs array<int>"))
    n, avgdl, most = made.agg(F.count("*"), F.avg("dl"), F.max("dl")).first()
    repeated = not made.groupBy("id").count().filter("count > 1").isEmpty()
    if repeated:  # rows of one id are one document
        each = made.select("id", "dl", F.explode_outer(F.arrays_zip("codes", "tfs")).alias("x")).groupBy("id", "x.codes").agg(F.sum("x.tfs").cast("int").alias("tfs"), F.first("dl").alias("dl"))
        pairs = F.array_sort(F.collect_list(F.when(F.col("codes").isNotNull(), F.struct("codes", "tfs"))))
        made = each.groupBy("id").agg(F.first("dl").alias("dl"), pairs.alias("x")).select("id", "dl", F.col("x.codes").alias("codes"), F.col("x.tfs").alias("tfs"))
    df = {r["code"]: r["df"] for r in made.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect()}  # of the queries' terms alone
    raw = lambda d: math.log(n - d + 0.5) - math.log(d + 0.5)
    if okapi:
        d = F.col("df")
        every = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("term")).filter("term is not null")
        every = every.distinct() if repeated else every
        mean = every.groupBy("term").agg(F.count("*").alias("df")).agg(F.avg(F.log(F.lit(n) - d + 0.5) - F.log(d + 0.5))).first()[0]
        idf = {c: OKAPI_EPSILON * mean if raw(d) < 0 else raw(d) for c, d in df.items()}
    else:
        idf = {c: math.log((n - d + 0.5) / (d + 0.5) + 1) for c, d in df.items()}
    weights = [(codes[t], q, qtf, idf.get(codes[t], 0.0)) for t, q, qtf in wanted]
    found = made.sortWithinPartitions("id").mapInArrow(best_by_terms(weights, to_arrow_type(asked.schema["query_id"].dataType), len(codes), avgdl, k, digits), f"query_id {query_type}, id {id_type}, score double") if most else made.select(F.lit(None).cast(query_type).alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    return top_k(found, ["query_id"], "score", "id", k).select("query_id", "id", "rank", "score")


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", okapi: bool = False) -> DataFrame:
    """(query_id, id, score) of documents that share a term with the query; a query's repeated terms count again.

    Only the queries' terms leave the scan: their list is sent to every task if it is measured small, else joined.
    okapi: idf without the +1, where negative values become OKAPI_EPSILON times the average idf of all terms.
    """
    toks = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("toks"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 56), F.lit(0))).first()[0]
    small = F.broadcast if size <= QUERY_BLOCK_BYTES else lambda x: x
    rows = toks.select("id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    # dealt by document alone, so that neither counting nor summing needs another shuffle
    post = rows.repartition("id").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    stats = toks.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # stats: one row
    if okapi:
        raw = lambda d: F.log(F.col("n") - d + 0.5) - F.log(d + 0.5)
        every = toks.select(F.explode_outer(F.array_distinct("toks")).alias("term")).filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
        mean = every.crossJoin(F.broadcast(stats)).agg(F.avg(raw(F.col("df"))).alias("mean_idf"))
        idf = df.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(raw(F.col("df")) < 0, OKAPI_EPSILON * F.col("mean_idf")).otherwise(raw(F.col("df"))).alias("idf"))
    else:
        idf = df.select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    tf, dl = F.col("tf"), F.col("dl")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    scored = post.join(small(asked.join(idf, "term")), "term").select("query_id", "id", (F.col("qtf") * weight).alias("w"))
    return scored.groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def reciprocal_rank_fusion(*rankings: tuple[DataFrame, float], k: int = 60) -> DataFrame:
    """(query_id, id, score): sum of weight / (k + rank) over rankings with columns query_id, id, rank."""
    parts = [r.select("query_id", "id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("w")) for r, w in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, top: int = 5, dense_k: int = 64, sparse_k: int = 32, sparse_weight: float = 2.0) -> DataFrame:
    """(query_id, id, rank, score): dense and BM25 rankings fused.  chunks: id, text, v; queries: query_id, query, q."""
    dense = nearest(chunks.select("id", "v"), queries.select("query_id", "q"), dense_k, digits=RANKED_DIGITS)
    sparse = bm25_top(chunks, queries, sparse_k, "id", "text")
    return top_k(reciprocal_rank_fusion((dense, 1.0), (sparse, sparse_weight)).withColumn("score", F.bround("score", 9)), ["query_id"], "score", "id", top)


def keyword_top(docs: DataFrame, id_col: str, text_col: str, stops: tuple[str, ...], k: int = 5) -> DataFrame:
    """(id, term, n, rank): the most frequent words of three letters or more, ties by first place.

    Counted where a text is, so that no word is shuffled; only rows that share their id with others, which are one document, meet."""
    shared = docs.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("_id"))
    if shared.isEmpty():
        return _own_keywords(docs, id_col, text_col, stops, k)
    same = docs[id_col].eqNullSafe(F.col("_id"))
    return _own_keywords(docs.join(shared, same, "left_anti"), id_col, text_col, stops, k).unionByName(_met_keywords(docs.join(shared, same, "left_semi"), id_col, text_col, stops, k))


def _own_keywords(docs: DataFrame, id_col: str, text_col: str, stops: tuple[str, ...], k: int) -> DataFrame:
    word, gone = re.compile("[a-z]{3,}"), frozenset(stops)

    def make(own, text: str | None):
        counts = Counter(w for w in word.findall(text or "") if w not in gone)
        return ((own, term, n, rank) for rank, (term, n) in enumerate(counts.most_common(k), 1))  # of equal ones the first met

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, term string, n long, rank int"
    return docs.select(id_col, F.lower(F.col(text_col))).mapInArrow(in_pieces(make, schema), schema)


def _met_keywords(docs: DataFrame, id_col: str, text_col: str, stops: tuple[str, ...], k: int) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{3,}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(words).alias("pos", "term")).filter(~F.col("term").isin(*stops))
    counts = rows.groupBy("id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), F.asc("first"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "term", "n", "rank")


def planes(dim: int, bits: int, seed: int = 11) -> list[list[float]]:
    import random

    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)]


def sign_bucket(v: Column, normals: list[list[float]]) -> Column:
    """Which side of each random plane a vector is on, as a number: a partition column for approximate search."""
    out = F.lit(0)
    for i, plane in enumerate(normals):
        weights = F.array(*[F.lit(float(x)) for x in plane])
        side = F.aggregate(F.zip_with(v, weights, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x) >= 0
        out = out + F.when(side, 1 << i).otherwise(0)
    return out
