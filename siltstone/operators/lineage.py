"""Cutting lineage, so that a lost executor costs a reread and no recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the cluster's shared folder, spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local master; on a cluster executors couldn't share it, so that is an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt to all cores if it has fewer partitions than those: work that is heavy for each row isn't left to the few tasks
    that one small file makes.  Tables of more partitions, and so all large ones, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
