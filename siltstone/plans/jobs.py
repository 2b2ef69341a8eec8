"""End-to-end plans: ingestion, question answering, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python import embed_with, hash_embedder, normalize, redact_for_index
from ..functions.security import output_verdict, parse_answer
from ..functions.text import approx_tokens, quality_verdict, title_only
from ..operators import chunking, cleaning, context, evaluation, retrieval, state
from ..operators.governance import ROLE_LEVELS, SENSITIVITY_LEVELS, level_of
from ..operators.lineage import cut


#: Ranked rows (ids and numbers) that are sent to every task.
RANKED_AT_HAND = 100_000


@dataclass(frozen=True)
class Session:
    """What a caller may see; every read of the index goes through it."""

    spark: SparkSession
    tenant: str
    role: str = "intern"

    def visible(self, chunks: DataFrame) -> DataFrame:
        if not self.tenant:
            raise ValueError("a tenant is required")
        return chunks.filter((F.col("tenant_id") == self.tenant) & (level_of(F.col("sensitivity"), SENSITIVITY_LEVELS) <= ROLE_LEVELS.get(self.role, 1)))


@dataclass(frozen=True)
class IngestResult:
    index: DataFrame
    manifest: DataFrame
    dead_letters: DataFrame
    counts: DataFrame


def ingest(listed: DataFrame, manifest: DataFrame, index: DataFrame, tenant: str, run_id: str, full_scan: bool = True, strategy: str = "layout", embedder: Callable | None = None, near_duplicates: float | None = 0.85) -> IngestResult:
    """One ingestion run over listed (source_id, change_key, text, sensitivity).

    Only new and changed rows are parsed, cleaned and embedded.  Rejected and near-duplicate documents are reconciled to no
    chunks; chunks whose id the index has are not embedded again; deletions follow only a full scan.
    """
    diff = state.manifest_diff(listed, manifest, full_scan)
    work = cut(state.to_fetch(listed, diff).withColumn("clean", normalize(F.col("text"))).drop("text"))
    repeated = cleaning.repeated_lines(work, "source_id", "clean")
    stripped = cleaning.strip_lines(work, repeated, "source_id", "clean").select(F.col("id").alias("source_id"), F.col("text").alias("body"))
    judged = cut(stripped.withColumn("reason", quality_verdict(F.col("body"))))
    dead = judged.filter("reason <> 'ok'").select("source_id", F.lit("quality").alias("stage"), F.col("reason").alias("error"))
    good = judged.filter("reason = 'ok'").select("source_id", "body")
    if near_duplicates is not None:
        later = cleaning.near_duplicate_pairs(good, "source_id", "body", near_duplicates).select(F.col("later").alias("source_id")).distinct()
        good = good.join(later, "source_id", "left_anti")
    safe = good.withColumn("body", redact_for_index(F.col("body")))
    pieces = chunking.split(safe, strategy, "source_id", "body").filter(quality_verdict(F.col("text"), 15) == "ok")
    chunks = cut(chunking.with_identity(pieces).join(work.select("source_id", "sensitivity"), "source_id").withColumn("tenant_id", F.lit(tenant)))
    fresh = state.new_only(chunks, index)
    made = fresh.withColumn("embedding", embed_with(embedder or hash_embedder(), F.col("text"))).select(*index.columns)
    touched = work.select("source_id").union(diff.filter("change_type = 'deleted'").select("source_id"))
    kept = index.join(touched, "source_id", "left_anti").unionByName(index.join(chunks.select("source_id", "chunk_id"), ["source_id", "chunk_id"], "left_semi"))
    counted = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    rows = work.select("source_id", "change_key").join(counted, "source_id", "left").select("source_id", "change_key", F.lit(run_id).alias("last_seen_run"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(tenant).alias("tenant_id"))
    gone = diff.filter("change_type = 'deleted'").select("source_id")
    after = state.upsert(state.touch_seen(manifest, listed, run_id).join(gone, "source_id", "left_anti").select(*rows.columns), rows, ["source_id"])
    return IngestResult(kept.unionByName(made), after, dead, state.change_counts(diff))


def write_run(result: IngestResult, path: str, run_id: str) -> None:
    """Append a run's dead letters and its report (counts of changes, dead letters, chunks) as JSON lines, by run."""
    result.dead_letters.withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{path}/dead_letters")
    changes = result.counts.agg(*[F.coalesce(F.sum(F.when(F.col("change_type") == c, F.col("n"))), F.lit(0)).alias(c) for c in (state.NEW, state.CHANGED, state.UNCHANGED, state.DELETED)])
    lost, chunks = result.dead_letters.agg(F.count("*").alias("dead_letters")), result.index.agg(F.count("*").alias("chunks"))
    changes.crossJoin(lost).crossJoin(chunks).withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{path}/reports")  # one row each


def answer(session: Session, chunks: DataFrame, questions: DataFrame, model: Callable, embedder: Callable | None = None, top: int = 5, budget: int = 2000, cap: int = 3) -> DataFrame:
    """One row per question (query_id, query): answer, citations, abstained, reason, retrieved chunk ids.

    Hybrid retrieval over what the session may see, evidence capped by source and packed, one model call, and a check of
    its output: whatever is not grounded turns into an abstention."""
    from ..functions.python import generate_with

    embed = embedder or hash_embedder()
    seen = session.visible(chunks).filter(~title_only(F.col("text")))
    asked = questions.withColumn("q", embed_with(embed, F.col("query")))
    table = seen.select(F.col("chunk_id").alias("id"), "text", F.col("embedding").alias("v"), "source_id")
    ranked = cut(retrieval.hybrid_search(table.select("id", "text", "v"), asked, top * 3))
    small = F.broadcast if ranked.count() <= RANKED_AT_HAND else lambda x: x  # then the index stays where it is
    ranked = table.select("id", "text", "source_id").join(small(ranked), "id")
    capped = context.per_source_cap(ranked, cap).filter(F.col("rank") <= top * 3)
    items = capped.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text", approx_tokens(F.col("text")).alias("tokens")))).alias("items"))
    packed = items.withColumn("items", F.slice(context.greedy_pack(F.col("items"), budget), 1, top))
    evidence = context.wrapped_evidence(F.transform("items", lambda x: x["text"]))
    ready = asked.drop("q").join(packed, "query_id", "left").withColumn("evidence", F.coalesce(evidence, F.lit("")))
    allowed = F.transform(F.sequence(F.lit(1), F.greatest(F.size("items"), F.lit(1))), lambda i: F.concat(F.lit("E"), i.cast("string")))
    replied = ready.withColumn("raw", generate_with(model, F.concat(F.lit("Question: "), "query", F.lit("\nEvidence:\n"), "evidence")))
    checked = replied.withColumn("reason", F.when(F.col("items").isNull(), "no_evidence").otherwise(output_verdict(F.col("raw"), allowed))).withColumn("got", parse_answer(F.col("raw")))
    fine = F.col("reason") == "ok"
    return checked.select("query_id", "query", F.when(fine, F.col("got.answer")).otherwise("").alias("answer"), F.when(fine, F.col("got.citations")).otherwise(F.array().cast("array<string>")).alias("citations"), (~fine | F.col("got.abstained")).alias("abstained"), "reason", F.coalesce(F.transform("items", lambda x: x["id"]), F.array().cast("array<string>")).alias("retrieved"))


def answer_with_retries(session: Session, chunks: DataFrame, questions: DataFrame, model: Callable, rewrite: Callable, retries: int = 2, **options) -> DataFrame:
    """Questions graded poor are rewritten and asked again, at most `retries` times; the best attempt of each is kept."""
    attempts, todo = None, questions
    for n in range(retries + 1):
        got = answer(session, chunks, todo, model, **options).withColumn("attempt", F.lit(n))
        got = cut(got)
        attempts = got if attempts is None else attempts.unionByName(got)
        poor = got.filter(evaluation.heuristic_grade(F.col("citations"), F.col("abstained")) == "poor")
        if n == retries or poor.isEmpty():
            break
        todo = poor.select("query_id", rewrite(F.col("query")).alias("query"))
    return context.best_attempt(attempts)


def evaluate(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Metrics by slice and overall of answers (query_id, answer, citations, abstained, retrieved) against a golden set."""
    rows = results.join(golden.select(F.col("id").alias("query_id"), "slice", F.col("expected_doc_ids").alias("relevant"), F.col("expected_answer_contains").alias("keywords"), "must_abstain"), "query_id")
    scored = evaluation.answer_flags(evaluation.retrieval_metrics(rows))
    return evaluation.by_slice(scored, "slice", ["citation_ok", "abstention_ok", "contains_ok", "recall_10", "rr", "ndcg_10"])
