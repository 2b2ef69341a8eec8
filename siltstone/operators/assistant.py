"""Frequent questions, tickets, tenants at the door, looser redaction rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k

# ---- Fixed values that results depend on.
URGENT = ("紧急", "投诉")
LOOSE_PATTERNS = (
    ("CN_MOBILE", r"(?<!\d)1[3-9]\d{9}(?!\d)", "tail"),
    ("CN_ID_CARD", r"(?<!\d)[1-9]\d{16}[\dXx](?!\d)", "tail"),
    ("BANK_CARD", r"(?<!\d)\d{16,19}(?!\d)", "tail"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("IPV4", r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)", "[EMAIL]"),
    ("JWT", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED]"),
    ("API_KEY", r"(?i)(?:api[_-]?key|secret|token)[\"':= ]+([A-Za-z0-9_-]{20,})", "[REDACTED]"),
    ("DB_DSN", r"(?i)(?:postgres|mysql|mongodb)://[^\s]+:[^\s]+@[^\s]+", "[REDACTED]"),
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
)
LOOSE_RESTRICTED = ("CN_ID_CARD", "BANK_CARD", "JWT", "API_KEY", "DB_DSN", "PRIVATE_KEY")


def loosely_redacted(text: Column) -> Column:
    """Rule by rule: long numbers keep their last four digits, the rest a word in its place."""
    for _, pattern, how in LOOSE_PATTERNS:
        text = F.regexp_replace(text, pattern, how) if how != "tail" else _tails(text, pattern)
    return text


def _tails(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hidden = lambda v: F.concat(F.repeat(F.lit("*"), F.char_length(v) - 4), F.substring(v, -4, 4))
    return F.aggregate(F.array_distinct(hits), text, lambda acc, v: F.replace(acc, v, hidden(v)))


def loose_sensitivity(text: Column, base: Column) -> Column:
    """base raised to internal by personal data and to restricted by secrets and numbers of documents, never lowered."""
    out = base
    for name, pattern, _ in LOOSE_PATTERNS:
        level = F.lit("restricted") if name in LOOSE_RESTRICTED else F.when(out == "restricted", out).otherwise("internal")
        out = F.when(text.rlike(pattern), level).otherwise(out)
    return out


def faq_top(questions: DataFrame, faq: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, id, rank, score): of the entries of a question's intent, or of all where the intent has none, those with the most of its words.

    questions: query_id, query, intent; faq: id, question, intent."""
    known = faq.select("intent").distinct().withColumn("known", F.lit(True))
    asked = questions.join(F.broadcast(known), "intent", "left").withColumn("words", F.array_distinct(F.regexp_extract_all("query", F.lit(r"(?U)\w+"), F.lit(0))))
    entries = faq.select("id", "question", F.explode(F.array("intent", F.lit("*"))).alias("of"))
    met = asked.withColumn("of", F.when(F.col("known"), F.col("intent")).otherwise("*")).join(entries, "of")
    score = F.size(F.filter("words", lambda w: F.contains(F.col("question"), w)))
    return top_k(met.select("query_id", "id", score.alias("score")), ["query_id"], "score", "id", k)


def tickets(rows: DataFrame, user: str = "user_id", text: str = "text", intent: str = "intent") -> DataFrame:
    """A ticket for each row: its number from a portable hash of the text, urgent ones first class."""
    number = F.lpad((F.conv(F.substring(F.md5(F.col(text)), 1, 8), 16, 10).cast("long") % 10_000).cast("string"), 4, "0")
    urgent = F.lit(False)
    for word in URGENT:
        urgent = urgent | F.contains(F.col(text), F.lit(word))
    return rows.withColumns({"ticket_id": F.concat(F.lit("TCK-"), F.col(user).cast("string"), F.lit("-"), number), "severity": F.when(urgent, "P0").otherwise("P2")})


def resolved_tenants(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests (api_key, tenant_id) with their status: 401 for an unknown key, 400 without a tenant, 404 for an unknown tenant, else 200.

    tenants: tenant_id, api_key.  A key stands for its own tenant where none is asked for."""
    by_key = tenants.select("api_key", F.col("tenant_id").alias("key_tenant"))
    known = tenants.select("tenant_id").distinct().withColumn("known", F.lit(True))
    met = requests.join(by_key, "api_key", "left").withColumn("tenant_id", F.coalesce(F.nullif("tenant_id", F.lit("")), "key_tenant")).join(known, "tenant_id", "left")
    status = F.when(F.col("api_key").isNotNull() & F.col("key_tenant").isNull(), 401).when(F.col("tenant_id").isNull(), 400).when(F.col("known").isNull(), 404).otherwise(200)
    return met.withColumn("status", status).drop("key_tenant", "known")


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path matches any pattern from its beginning."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(f"^(?:{p})")
    return out


def traverses(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "..") | path.startswith("/etc/") | F.contains(path, F.lit("~/"))


def refunded_usage(charges: DataFrame, refunds: DataFrame, key: str, amount: str = "amount") -> DataFrame:
    """(key, used): what was charged less what was given back, never below zero."""
    signed = charges.select(key, F.col(amount).alias("a")).unionByName(refunds.select(key, (-F.col(amount)).alias("a")))
    return signed.groupBy(key).agg(F.greatest(F.sum("a"), F.lit(0.0)).alias("used"))


def markdown_report(deltas: DataFrame, title: str) -> DataFrame:
    """One row: a table of (metric, a, b, delta, winner) by metric."""
    line = F.format_string("| %s | %s | %s | %s | %s |", F.col("metric"), F.format_string("%.4f", "a"), F.format_string("%.4f", "b"), F.format_string("%+.4f", "delta"), F.coalesce("winner", F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"])
    head = F.array(F.lit(f"# {title}"), F.lit(""), F.lit("| metric | A | B | delta | better |"), F.lit("|---|---:|---:|---:|:--:|"))
    return deltas.agg(F.array_join(F.concat(head, rows), "\n").alias("report"))
