"""Tenancy, access levels, quotas, audit, webhooks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import user_hash
from ..functions.security import drop_pii

# ---- Fixed values that results depend on.
ROLE_LEVELS = {"intern": 1, "employee": 2, "manager": 2, "executive": 3, "admin": 3}
SENSITIVITY_LEVELS = {"public": 1, "internal": 2, "restricted": 3}
PLAN_QUOTAS = {"free": (500, 200_000, 10_000), "team": (5_000, 2_000_000, 100_000), "enterprise": (50_000, 20_000_000, 1_000_000)}
LATENCY_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
STATUSES = ("ok", "abstained", "quota_exceeded", "blocked", "error", "timeout")


def level_of(value: Column, levels: dict[str, int]) -> Column:
    """The level of a name; 1 for unknown, empty and null ones."""
    out = F.lit(None).cast("int")
    for name, level in levels.items():
        out = F.when(value == name, level).otherwise(out)
    return F.coalesce(out, F.lit(1))


def visible_to(docs: DataFrame, role: str, sensitivity: str = "sensitivity") -> DataFrame:
    return docs.filter(level_of(F.col(sensitivity), SENSITIVITY_LEVELS) <= ROLE_LEVELS.get(role, 1))


def tenant_scan(chunks: DataFrame, tenant: str, allowed: list[str]) -> DataFrame:
    """One tenant's chunks of allowed sensitivities; prunes partitions by tenant_id."""
    if not tenant:
        raise ValueError("a tenant is required")
    return chunks.filter((F.col("tenant_id") == tenant) & F.col("sensitivity").isin(*allowed)) if allowed else chunks.filter(F.lit(False))


def metadata_filter(chunks: DataFrame, equal: dict[str, str], promoted: tuple[str, ...] = ("source_id", "sensitivity", "doc_version")) -> DataFrame:
    for key, value in equal.items():
        chunks = chunks.filter((F.col(key) if key in promoted else F.col("metadata")[key]) == value)
    return chunks


def label_sensitivity(labels: Column) -> Column:
    low = F.transform(labels, F.lower)
    return F.when(F.arrays_overlap(low, F.array(F.lit("restricted"), F.lit("confidential"))), "restricted").when(F.array_contains(low, "public"), "public").otherwise("internal")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PLAN_QUOTAS.items()], "plan string, max_queries_per_day long, max_tokens_per_day long, max_chunks_indexed long")


def tenant_quotas(tenants: DataFrame, plan_table: DataFrame) -> DataFrame:
    """Tenants with their plan's limits; a custom_<limit> column overrides one limit."""
    out = tenants.join(F.broadcast(plan_table), "plan", "left")  # one row a plan
    for c in ("max_queries_per_day", "max_tokens_per_day", "max_chunks_indexed"):
        if f"custom_{c}" in tenants.columns:
            out = out.withColumn(c, F.coalesce(f"custom_{c}", c)).drop(f"custom_{c}")
    return out


def usage_last_day(events: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Each event with its key's sum over the 24 hours up to it, itself included."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-86_400_000_000, 0)
    return events.withColumn("used_24h", F.sum(amount).over(w))


def folded(rows: DataFrame, order: list[Column], start: Callable[[], Callable], flag: str) -> DataFrame:
    """rows with a boolean from a fold over each key's rows in order.

    start() gives a key's step: it takes a row's values besides the key and returns the flag.  Sorted partitions stream
    through, so memory holds a batch and one key's state, however many rows a key has; null keys are one key."""
    inputs = [c for c in rows.columns if c != "key"]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + f", {flag} boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for frame in frames:
            out = []
            for k, *x in zip(frame["key"], *(frame[c] for c in inputs), strict=True):
                if step is None or k != last:
                    last, step = k, start()
                out.append(step(*x))
            yield frame.assign(**{flag: pd.array(out, dtype="boolean")})

    return rows.repartition("key").sortWithinPartitions("key", *order).mapInPandas(run, schema)


def admit(events: DataFrame, limit: float, key: str = "key", ts: str = "ts", amount: str = "amount") -> DataFrame:
    """Events with `admitted`: rejected events don't count against later ones, so admission is a fold over each key's events.

    A key's state is its admitted events of the last day.  Without an amount an event isn't admitted; without a time it comes last."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(amount).cast("double").alias("amount"))
    day = pd.Timedelta(days=1)

    def start() -> Callable:
        window, used = deque(), 0.0

        def step(at: pd.Timestamp, x: float) -> bool:
            nonlocal used
            while window and window[0][0] < at - day:
                used -= window.popleft()[1]
            ok = bool(used + x <= limit)
            if ok:
                window.append((at, x))
                used += x
            return ok

        return step

    return folded(rows, [F.asc_nulls_last("ts"), F.asc_nulls_last("amount")], start, "admitted")


def audit_events(calls: DataFrame, salt: str) -> DataFrame:
    """Calls as audit rows: the user hashed, question and answer redacted and cut, partitioned by day."""
    return calls.select(
        "tenant_id",
        user_hash(salt, F.col("user_id")).alias("user_id_hash"),
        F.substring(drop_pii(F.col("question")), 1, 200).alias("question"),
        F.substring(drop_pii(F.col("answer")), 1, 500).alias("answer"),
        "status",
        "ts",
        F.to_date("ts").alias("day"),
    )


def append_audit(events: DataFrame, path: str) -> None:
    events.write.partitionBy("day").mode("append").json(path)


def webhook_routes(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Active hooks of an event's tenant that want its type (an empty list wants all)."""
    wants = (F.size("events") == 0) | F.array_contains("events", F.col("event_type"))
    return events.join(hooks.filter("active"), "tenant_id").filter(wants)


def webhook_public(hooks: DataFrame, allowed: list[str]) -> DataFrame:
    """Valid hooks without their secrets, their events distinct and in order."""
    known = F.size(F.array_except("events", F.array(*[F.lit(x) for x in allowed]))) == 0
    return hooks.filter(F.col("url").rlike(r"^https?://\S+$") & (F.char_length("url") <= 500) & known).withColumn("events", F.array_distinct("events")).drop("secret")


def latency_histogram(events: DataFrame, value: str, by: list[str], buckets: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts, count and sum for each group, in one aggregation."""
    cols = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{str(b).replace('.', '_')}") for b in buckets]
    return events.groupBy(*by).agg(*cols, F.count(value).alias("n"), F.sum(value).alias("total"))
