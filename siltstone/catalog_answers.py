"""More queries of the catalog: hybrid retrieval, judged answers, metadata, assistants and tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _COS, _POSTINGS, _REL, _SIGNED, _VEC, _nearest, _rankings, _snapshots, _table, _vectors, ab_compare, query
from .functions import ids, python
from .operators import assistant, cleaning, evaluation, governance, judging, records, retrieval, state
from .operators.lineage import cut

# ---------------------------------------------------------------- retrieval


@query(f"""with dv as (select * from documents where doc_id in (select vec_id from embeddings)), {_POSTINGS.replace("from documents", "from dv")}, v as (select vec_id as id, CAST(embedding as DOUBLE[]) as v from embeddings),
c as (select doc_id as id, v from documents join v on v.id = doc_id), qs as (select item_id as query_id, v from benchmark join v on v.id = item_id),
d as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select a.query_id, b.id, {_COS} as score from qs a, c b)),
b as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select item_id as query_id, doc_id as id, round_even(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from post join df using (term) join asked using (term) cross join stats where item_id in (select query_id from qs) group by item_id, doc_id)),
f as (select query_id, id, round_even(sum(w), 9) as score from (select query_id, id, 1.0 / (60 + rank) as w from d where rank <= 64 union all select query_id, id, 2.0 / (60 + rank) from b where rank <= 32) group by query_id, id)
select query_id, id, rank, score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank <= 5""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for every benchmark item: vectors and words, fused.  Vectors are those of equal number in embeddings."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("v"))
    docs = _table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("n")).select(F.col("doc_id").alias("id"), "text", "v")
    asked = _table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("n")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("v").alias("q"))
    return retrieval.hybrid_search(docs, asked).withColumn("rank", F.col("rank").cast("long"))


@query()
def hybrid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item asked of the documents as one tenant's index, by a model that quotes its first evidence (rows only: hashed embeddings)."""
    from .plans import jobs

    embed = python.hash_embedder()
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("source_id"), "text", F.lit("internal").alias("sensitivity"), F.lit("acme").alias("tenant_id"), python.embed_with(embed, F.col("text")).alias("embedding"))
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return jobs.answer(jobs.Session(spark, "acme", "employee"), cut(chunks), asked, _quoting)


def _quoting(prompt: str) -> str:
    import json

    found = prompt.split("[E1] ")
    return json.dumps({"answer": found[1][:80] if len(found) > 1 else "", "citations": ["E1"] if len(found) > 1 else [], "abstained": len(found) < 2})


@query(f"""with {_VEC} select a.id as a, b.id as b, {_COS} as score from v a join v b on a.id < b.id where {_COS} >= 0.4""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors that are at least that alike, by tiles."""
    df, key, vec = _vectors(spark, sf_dir)
    return retrieval.similar_pairs(df.select(F.col(key).alias("id"), F.col(vec).alias("v")), 0.4)


_DOT = "round_even(list_dot_product(a.v, b.v), 6)"


@query(f"""with {_VEC}, s as (select a.query_id, b.id, {_COS} as score, {_DOT} as d from q a, v b where b.id <> a.query_id),
t as (select *, row_number() over (partition by query_id order by score desc, id) as r from s)
select query_id, id, rank, score from (select query_id, id, d as score, row_number() over (partition by query_id order by d desc, id) as rank from t where r <= 10) where rank <= 5""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten nearest vectors the five best by a second score, the plain product."""
    df, key, vec = _vectors(spark, sf_dir)
    v = df.select(F.col(key).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    top = _nearest(spark, sf_dir, 10).select("query_id", "id")
    met = top.join(v, "id").join(v.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    product = F.bround(F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6)
    return judging.reranked(met, product).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "score")


@query(f"""with {_VEC}, l as (select vec_id as id, label from embeddings), s as (select a.query_id, b.id, {_COS} as score from q a, v b where b.id <> a.query_id),
n as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from s), f as (select query_id, id, row_number() over (partition by query_id order by score, id) as rank from s),
u as (select 'near' as retriever, * from n where rank <= 3 union all select 'far', * from f where rank <= 3)
select retriever, count(*) as n, sum(hit)::BIGINT as hits from (select retriever, query_id, max((x.label = y.label)::INTEGER) as hit from u join l x on x.id = u.query_id join l y on y.id = u.id group by all) group by retriever""")
def compare_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a vector of their own label among three, by the nearest and by the farthest."""
    df, key, _ = _vectors(spark, sf_dir)
    label = df.select(F.col(key).alias("id"), "label")
    ranked = cut(_nearest(spark, sf_dir, 3, 3))  # both from one pass over the vectors
    asked = label.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "label")
    met = ranked.select("query_id", "id").distinct().join(label.withColumnRenamed("label", "found"), "id").join(asked, "query_id")  # of what is retrieved only: all of a label would be a square
    return judging.retriever_hits({"near": ranked.filter("not far"), "far": ranked.filter("far")}, met.filter("found = label"), 3)


@query(f"""with {_SIGNED} select id as doc_id, b as band, md5(array_to_string(s[b * 4 + 1:b * 4 + 4], ',')) as bucket from (select id, s, unnest(generate_series(0, 15)) as b from sig)""")
def minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band table of all documents: what a later run meets its new documents with."""
    signed = _table(spark, sf_dir, "documents").select("doc_id", python.minhash_of(F.col("text")).alias("sig"))
    return cleaning.band_table(signed, "doc_id").withColumn("band", F.col("band").cast("long"))


# ---------------------------------------------------------------- judged answers

_CLAIM = "list_filter(list_transform(regexp_split_to_array({0}, '[。.!?！？\\n]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 2)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn's text as question, the turn after it as answer, and the turns of its conversation's two neighbours as contexts."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    other = lambda k: docs.select((F.col("id") + k).alias("id"), F.substring("text", 1, 900).alias(f"c{k}"))
    met = docs.join(other(1), "id", "left").join(other(2), "id", "left")
    return met.select("id", F.substring("text", 1, 30).alias("question"), F.substring("text", 1, 400).alias("answer"), F.substring("text", 100, 300).alias("ground_truth"), F.array_compact(F.array("c1", "c2")).alias("contexts"))


_HAS_WORD = "case when regexp_extract({0}, '[a-z]{{4,}}') <> '' and contains({1}, regexp_extract({0}, '[a-z]{{4,}}')) then 1 else 0 end"
_JUDGED = rf"""d as (select doc_id as id, coalesce(text, '') as text from documents),
r as (select d.id, substr(d.text, 1, 30) as question, substr(d.text, 1, 400) as answer, substr(d.text, 100, 300) as truth, list_filter([substr(a.text, 1, 900), substr(b.text, 1, 900)], lambda x: x is not null) as contexts from d left join d a on a.id = d.id - 1 left join d b on b.id = d.id - 2),
e as (select *, substr(trim(array_to_string(contexts, chr(10)), ' '), 1, 2000) as ev from r),
f as (select id, avg({_HAS_WORD.format("p", "ev")}) as v from (select id, ev, unnest({_CLAIM.format("answer")}) as p from e where ev <> '') group by id),
t as (select id, avg({_HAS_WORD.format("p", "ev")}) as v from (select id, ev, unnest({_CLAIM.format("truth")}) as p from e where ev <> '') group by id),
p as (select id, avg({_HAS_WORD.format("truth", "c")}) as v from (select id, truth, unnest(contexts) as c from e where truth <> '') group by id)"""


def _has_word(statement, evidence):
    word = F.regexp_extract(statement, "[a-z]{4,}", 0)
    return F.when((word != "") & F.contains(evidence, word), "1").otherwise("0")


@query(rf"""with {_JUDGED} select e.id, round_even(coalesce(f.v, 0), 6) as faithfulness, round_even(coalesce(t.v, 0), 6) as context_recall, round_even(coalesce(p.v, 0), 6) as context_precision, round_even(1 - coalesce(f.v, 0), 4) as hallucination from e left join f using (id) left join t using (id) left join p using (id)""")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made answers beside made contexts, by a judge that looks for a statement's first long word."""
    rows = _answers(spark, sf_dir)
    out = rows.select("id").join(judging.faithfulness(rows, _has_word), "id").join(judging.context_recall(rows, _has_word), "id").join(judging.context_precision(rows, _has_word), "id")
    return out.select("id", *[F.bround(c, 6).alias(c) for c in ("faithfulness", "context_recall", "context_precision")], judging.hallucination_rate(F.col("faithfulness")).alias("hallucination"))


@query(rf"""with {_JUDGED} select 'faithfulness' as metric, round_even(avg(coalesce(f.v, 0)), 4) as value from e left join f using (id) union all select 'context_recall', round_even(avg(coalesce(t.v, 0)), 4) from e left join t using (id)
union all select 'context_precision', round_even(avg(coalesce(p.v, 0)), 4) from e left join p using (id) union all select 'answer_relevancy', round_even(avg(case when question <> '' and answer <> '' then {_HAS_WORD.format("question", "answer")} else 0 end), 4) from e""")
def evaluated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the judged metrics, what can't be judged as 0."""
    return judging.evaluate_answers(_answers(spark, sf_dir), dict.fromkeys(judging.METRICS, _has_word))


@query("""with l as (select item_id as query_id, list_filter([trim(x) for x in string_split(replace(text, ' and ', chr(10)), chr(10))], lambda x: x <> '') as ls, text from benchmark),
m as (select query_id, case when len(ls) > 0 then ls else [text] end as ls from l)
select query_id, 'decomposition' as kind, unnest(generate_series(0, len(ls) - 1))::INTEGER as number, unnest(ls) as query from m""")
def query_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-questions of every benchmark item, by a stand-in for a model that cuts at `and`."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return judging.rewritten(asked, lambda p: p.removeprefix("Parts: ").replace(" and ", "\n"), "decomposition", "Parts: ")


@query(f"with {_REL} select query_id, round_even(r10, 6) as retrieval_recall, sum(hit) = any_value(total) as retrieval_correct, max(hit) = 1 as hit from m join h using (query_id) join n using (query_id) group by query_id, r10".replace("sum(hit) = any_value(total)", "r10 = 1.0"))
def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query: the share of what was expected that came, whether all did, whether any did."""
    out = evaluation.question_scores(_rankings(spark, sf_dir), total="n_relevant")
    return out.select("query_id", F.bround("retrieval_recall", 6).alias("retrieval_recall"), "retrieval_correct", "hit")


@query(f"""with {_REL}, x(metric, a, b) as (select 'mrr', avg(rr), avg(rr) from m union all select 'precision', avg(p10), avg(p10) + 0.1 from m union all select 'latency_ms', 9.0, 5.0)
select '# Runs' || chr(10) || chr(10) || '| metric | A | B | delta | better |' || chr(10) || '|---|---:|---:|---:|:--:|' || chr(10) || string_agg(format('| {{}} | {{:.4f}} | {{:.4f}} | {{:+.4f}} | {{}} |', metric, round_even(a, 4), round_even(b, 4), round_even(b, 4) - round_even(a, 4), case when metric = 'mrr' then 'tie' else 'b' end), chr(10) order by metric) as report from x""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side as a table in markdown."""
    rows = ab_compare(spark, sf_dir).filter("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))
    return assistant.markdown_report(rows, "Runs")


# ---------------------------------------------------------------- metadata and tables


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").filter("text is not null")
    return d.select(F.concat(F.lit("fs:"), F.col("doc_id")).alias("source_id"), F.lit("fs").alias("connector"), F.concat(F.lit("/x/"), F.col("doc_id")).alias("uri"), F.lit("text").alias("source_format"), F.md5("text").alias("etag"), F.col("doc_id").cast("double").alias("mtime"), F.col("source").alias("author"), F.array("source", "lang").alias("acl_principals"), F.lit("internal").alias("sensitivity"), F.lit("v1").alias("version"), F.col("lang").alias("language"), F.col("text").alias("raw"), (F.col("doc_id") % 3).alias("tenant_id"), "doc_id")


@query("""select 'fs:' || doc_id as source_id, 'fs' as connector, '/x/' || doc_id as uri, 'text' as source_format, md5(text) as etag, doc_id::DOUBLE as mtime, source as author, array_to_string(list_filter([source, lang], lambda x: x is not null), '|') as acl_principals, 'internal' as sensitivity, 'v1' as version, lang as language, sha256(text) as content_sha256 from documents where text is not null""")
def provenance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.provenance(_records(spark, sf_dir))


@query("""select doc_id, 'fs:' || doc_id as source_id, coalesce(lang, 'none') as language, '7' as ordinal, 'mine' as author, (doc_id % 3)::VARCHAR as tenant_id, (case when lang is null then 13 else 14 end)::INTEGER as n from documents where text is not null""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fields under provenance under the chunk's own entries, the tenant last."""
    rows = _records(spark, sf_dir).withColumns({"ordinal": F.lit(7), "acl_principals": F.lit("p"), "content_sha256": F.lit("c"), "metadata": F.create_map(F.lit("author"), F.lit("mine"), F.lit("tenant_id"), F.lit("forged"), F.lit("none"), F.lit(None).cast("string"))})
    m = rows.withColumn("m", records.chunk_metadata(rows))
    get = lambda k: F.col("m")[k]
    return m.select("doc_id", get("source_id").alias("source_id"), F.coalesce(get("language"), F.lit("none")).alias("language"), get("ordinal").alias("ordinal"), get("author").alias("author"), get("tenant_id").alias("tenant_id"), F.size("m").alias("n"))


@query("""select doc_id, case when lang is null and source is null then '_=' else array_to_string(list_filter([case when lang is not null then 'lang=' || lang || '|x' end, case when source is not null then 'source=' || source end], lambda x: x is not null), ';') end as entries from documents""")
def scalar_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("lang"), F.when(F.col("lang").isNotNull(), F.array("lang", F.lit("x"))), F.lit("source"), F.when(F.col("source").isNotNull(), F.array("source")))
    flat = F.array_sort(F.transform(F.map_entries(records.scalar_metadata(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(flat, ";").alias("entries"))


@query("""select 'page::' || page_id as block_id, url as source_path, 'html' as source_format, case page_id % 3 when 0 then 'table' when 1 then 'text' else 'image' end as block_type, page_id::VARCHAR as page_or_sheet, case when page_id % 3 = 0 then 'a|b' end as headers, case when page_id % 3 = 2 then nullif(substr(html, 1, 200), '') end as image_caption from pages where page_id % 3 <> 1""")
def block_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and images among made blocks, flattened."""
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'text' ELSE 'image' END")
    b = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page::"), F.col("page_id")).alias("block_id"), F.col("url").alias("source_path"), F.lit("html").alias("source_format"), kind.alias("block_type"), F.col("page_id").alias("page_or_sheet"), F.when(F.col("page_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("headers"), F.when(F.col("page_id") % 3 == 2, F.col("html")).alias("image_caption"))
    return records.block_metadata(records.of_type(b, "table").unionByName(records.of_type(b, "image")))


@query("select doc_id, source from (select *, row_number() over (partition by source order by doc_id) as r from documents) where r <= 5")
def limit_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.limited(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("select doc_id from documents order by md5('42:' || doc_id), doc_id limit 20")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.seeded_sample(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20, 42)


@query("select 'l_quantity' as column, round_even(sum(l_quantity), 2)::DOUBLE as total from lineitem union all select 'l_linenumber', sum(l_linenumber)::DOUBLE from lineitem")
def numeric_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the numeric ones of some columns."""
    return records.numeric_sums(_table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", "l_returnflag")).withColumn("total", F.bround("total", 2))


@query("select d.doc_id, f.found_id from documents d left join (select text, min(doc_id) as found_id from documents where text is not null group by text) f using (text)")
def text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.with_texts_id(docs, docs).select("doc_id", "found_id")


_STATS = "with e as (select doc_id % 50 as s, doc_id as c from documents where doc_id % 4 <> 0), n as (select doc_id % 50 as s, doc_id as c from documents where doc_id % 50 < 20 and doc_id % 3 <> 0)"


@query(f"{_STATS} select s as source_id, count(nc) as total, count(*) filter (where ec is null) as new, count(*) filter (where nc is null) as stale from (select coalesce(n.s, e.s) as s, n.c as nc, e.c as ec from n full join (select * from e where s in (select s from n)) e on n.s = e.s and n.c = e.c) group by s")
def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("source_id"), F.col("doc_id").alias("chunk_id"))
    return records.build_stats(rows.filter("source_id < 20 and chunk_id % 3 <> 0"), rows.filter("chunk_id % 4 <> 0"))


@query("select event_type, max(event_id || '-run') as name from events group by event_type")
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest(_table(spark, sf_dir, "events").select("event_type", F.concat(F.col("event_id"), F.lit("-run")).alias("name")), "event_type", "name")


@query("with o as (select distinct md5(text) as h from documents where doc_id % 3 <> 0) select lang, count(distinct md5(text)) as added from documents where text is not null and md5(text) not in (select h from o where h is not null) group by lang")
def added_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct texts of each language a store of two thirds of the documents lacks."""
    docs = _table(spark, sf_dir, "documents").filter("text is not null").select("lang", "doc_id", F.md5("text").alias("chunk_id"))
    new = docs.join(docs.filter("doc_id % 3 <> 0").select("chunk_id").distinct(), "chunk_id", "left_anti")
    return new.dropDuplicates(["lang", "chunk_id"]).groupBy("lang").agg(F.count("*").alias("added"))


@query("with o as (select doc_id as source_id, md5(text) as k from documents where doc_id % 3 <> 0) select count(*) as documents, sum(source_id % 5)::BIGINT as chunks from o")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _snapshots(spark, sf_dir)
    return state.manifest_stats(old.withColumn("chunk_count", F.col("source_id") % 5))


# ---------------------------------------------------------------- tenants, assistants, identities


@query("select sensitivity, count(*) as n from (select doc_id % 3 as t, case doc_id % 4 when 0 then 'public' when 1 then 'internal' else 'restricted' end as sensitivity from documents) where t = 1 and sensitivity in ('public', 'internal') group by sensitivity")
def tenant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).cast("string").alias("tenant_id"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END").alias("sensitivity"))
    return governance.tenant_scan(chunks, "1", ["public", "internal"]).groupBy("sensitivity").agg(F.count("*").alias("n"))


@query("select doc_id from documents where lang = 'en' and source = (select min(source) from documents)")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    first = docs.agg(F.min("source")).first()[0]
    rows = docs.select("doc_id", F.col("source").alias("source_id"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    return governance.metadata_filter(rows, {"source_id": first, "lang": "en"}).select("doc_id")


def _hmac_sql(key: str, message: str) -> str:
    raw = key.encode().ljust(64, b"\0")
    blob = lambda n: "unhex('" + bytes(b ^ n for b in raw).hex() + "')"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({message}))))"


@query(f"select event_id, substr({_hmac_sql('salt', 'user_id::VARCHAR')}, 1, 16) as user_id_hash, 'sha256=' || {_hmac_sql('key', 'event_type')} as signature from events")
def keyed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' keyed hashes and webhook signatures, by the definition of HMAC in both engines."""
    return _table(spark, sf_dir, "events").select("event_id", ids.user_hash("salt", F.col("user_id").cast("string")).alias("user_id_hash"), ids.webhook_signature("key", F.col("event_type")).alias("signature"))


@query(f"""select tenant_id, user_id_hash, status, day, count(*) as n from (select conv_id % 3 as tenant_id, substr({_hmac_sql('salt', 'conv_id::VARCHAR')}, 1, 16) as user_id_hash, role as status, date '2024-01-01' + (turn % 5)::INTEGER as day from conversations) group by all""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as audit rows, counted by tenant, hashed user, status and day."""
    calls = _table(spark, sf_dir, "conversations").select((F.col("conv_id") % 3).alias("tenant_id"), F.col("conv_id").cast("string").alias("user_id"), F.col("text").alias("question"), F.col("text").alias("answer"), F.col("role").alias("status"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(turn % 5 as int), 1)").alias("ts"))
    return governance.audit_events(calls, "salt").groupBy("tenant_id", "user_id_hash", "status", "day").agg(F.count("*").alias("n"))


@query(r"select page_id, regexp_matches(url, '^(?:.*/en/.*|https://m\..*)') as excluded, (list_contains(string_split(url, '/'), '..') or starts_with(url, '/etc/') or contains(url, '~/')) as traverses from pages")
def path_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", assistant.excluded(u, (r".*/en/.*", r"https://m\..*")).alias("excluded"), assistant.traverses(u).alias("traverses"))


@query("select event_type, count(*) as n from events where ts::DATE <= date '2024-01-10' group by event_type")
def until_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter(F.to_date("ts") <= F.lit("2024-01-10").cast("date")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(r"""with f as (select item_id as id, text as question, item_id % 3 as intent from benchmark), q as (select conv_id as query_id, min(text) as query, conv_id % 4 as intent from conversations where role = 'user' group by conv_id),
w as (select query_id, intent, list_distinct(regexp_extract_all(query, '[\p{L}\p{M}\p{N}_]+')) as ws from q), m as (select query_id, f.id, len(list_filter(ws, lambda x: contains(f.question, x))) as score from w join f on f.intent = w.intent or w.intent not in (select intent from f))
select query_id, id, rank, score::INTEGER as score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from m) where rank <= 2""")
def faq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries for each conversation's first text in order: benchmark items as entries, those of its intent or else all."""
    faq = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 3).cast("string").alias("intent"))
    asked = _table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min("text").alias("query")).select(F.col("conv_id").alias("query_id"), "query", (F.col("conv_id") % 4).cast("string").alias("intent"))
    return assistant.faq_top(asked, faq).withColumn("rank", F.col("rank").cast("long"))


@query("""select conv_id, turn, 'TCK-' || conv_id || '-' || lpad((('0x' || substr(md5(text), 1, 8))::BIGINT % 10000)::VARCHAR, 4, '0') as ticket_id, case when contains(text, '紧急') or contains(text, '投诉') then 'P0' else 'P2' end as severity from conversations where text is not null""")
def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assistant.tickets(_table(spark, sf_dir, "conversations").filter("text is not null"), "conv_id").select("conv_id", "turn", "ticket_id", "severity")


@query("""with t(tenant_id, api_key) as (values ('a', 'k1'), ('b', 'k2')), r as (select doc_id, case doc_id % 4 when 0 then 'k1' when 1 then 'k2' when 2 then 'k9' end as api_key, case doc_id % 3 when 0 then 'a' when 1 then 'zz' end as want from documents),
m as (select doc_id, r.api_key, t.tenant_id as own, coalesce(want, t.tenant_id) as tenant_id from r left join t on t.api_key = r.api_key)
select status, count(*) as n from (select case when api_key is not null and own is null then 401 when tenant_id is null then 400 when tenant_id not in (select tenant_id from t) then 404 else 200 end as status from m) group by status""")
def tenant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = spark.createDataFrame([("a", "k1"), ("b", "k2")], "tenant_id string, api_key string")
    asked = _table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN 'k1' WHEN 1 THEN 'k2' WHEN 2 THEN 'k9' END").alias("api_key"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'zz' END").alias("tenant_id"))
    return assistant.resolved_tenants(asked, tenants).groupBy("status").agg(F.count("*").alias("n"))


@query("""select user_id, round_even(greatest(sum(case when event_type = 'error' then -value else value end), 0), 6) as used from events group by user_id""")
def refunded_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user used, failed calls given back."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("amount"))
    out = assistant.refunded_usage(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), "user_id")
    return out.withColumn("used", F.bround("used", 6))
