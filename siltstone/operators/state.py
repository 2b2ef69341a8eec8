"""Index and manifest maintenance: change detection, upserts, deletions, retention.

Parquet has no MERGE, so each change gives a new snapshot: anti-join the rows that are
replaced, add the new ones, write a new version, and move a small pointer last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEW, CHANGED, UNCHANGED, DELETED = "new", "changed", "unchanged", "deleted"


def manifest_diff(listed: DataFrame, known: DataFrame, full_scan: bool, key: str = "source_id", change: str = "change_key") -> DataFrame:
    """(key, change_type): one full outer join; deletions are inferred only from a full scan."""
    a = listed.select(F.col(key), F.col(change).alias("now"), F.lit(True).alias("is_listed"))
    b = known.select(F.col(key), F.col(change).alias("was"), F.lit(True).alias("is_known"))
    kind = (
        F.when(F.col("is_known").isNull(), NEW)
        .when(F.col("is_listed").isNull(), DELETED if full_scan else None)
        .when((F.col("now") == "") | F.col("now").isNull() | ~F.col("now").eqNullSafe(F.col("was")), CHANGED)
        .otherwise(UNCHANGED)
    )
    return a.join(b, key, "full_outer").select(key, kind.alias("change_type")).filter("change_type is not null")


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count("*").alias("n"))


def to_fetch(listed: DataFrame, diff: DataFrame, key: str = "source_id") -> DataFrame:
    """Listed rows that are new or changed."""
    return listed.join(diff.filter(F.col("change_type").isin(NEW, CHANGED)).select(key), key, "left_semi")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true (nulls stay)."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def reconcile(existing: DataFrame, current: DataFrame, source: str = "source_id", chunk: str = "chunk_id") -> DataFrame:
    """Rows of re-indexed sources that their current chunks don't have: the stale ones."""
    touched = current.select(source).distinct()
    return existing.join(touched, source, "left_semi").join(current.select(source, chunk), [source, chunk], "left_anti")


def touch_seen(manifest: DataFrame, listed: DataFrame, run_id: str, key: str = "source_id") -> DataFrame:
    seen = listed.select(key).distinct().withColumn("_seen", F.lit(True))
    return manifest.join(seen, key, "left").withColumn("last_seen_run", F.when(F.col("_seen"), run_id).otherwise(F.col("last_seen_run"))).drop("_seen")


def next_cursor(listed: DataFrame, connector: str, watermark: str) -> DataFrame:
    return listed.groupBy(F.col(connector).alias("connector")).agg(F.max(watermark).alias("cursor"))


def manifest_stats(manifest: DataFrame, chunks: str = "chunk_count") -> DataFrame:
    return manifest.agg(F.count("*").alias("documents"), F.coalesce(F.sum(chunks), F.lit(0)).alias("chunks"))


def expired(events: DataFrame, day: str, today: str, keep_days: int = 90) -> DataFrame:
    """Rows of day partitions that are past retention."""
    return events.filter(F.col(day) < F.date_sub(F.lit(today).cast("date"), keep_days))


def erase_subject(events: DataFrame, tenant: str, user_hash: str) -> DataFrame:
    """Events without one subject's within one tenant."""
    return delete_where(events, (F.col("tenant_id") == tenant) & (F.col("user_id_hash") == user_hash))


def new_only(batch: DataFrame, store: DataFrame, key: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    """First-seen rows of a batch that the store doesn't have: the ones to embed."""
    from .cleaning import first_of

    return first_of(batch.join(store.select(key), key, "left_anti"), [key], [order])


class VersionedTable:
    """Parquet snapshots under one folder and a pointer row that is moved after a snapshot is complete."""

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        jvm, fs = self._fs()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/published")
        if not fs.exists(where):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(where))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/data/{versions[-1]}") if versions else None

    def publish(self, df: DataFrame) -> None:
        version = f"{len(self._versions()):08d}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(*self.partition_by) if self.partition_by else df.write
        writer.parquet(f"{self.path}/data/{version}")
        jvm, fs = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/published/{version}"), False).close()

    def upsert(self, df: DataFrame, keys: list[str]) -> None:
        now = self.read()
        self.publish(df if now is None else upsert(now, df, keys))
