"""Shared-folder tables, used to cut lineage so that a lost executor costs a reread, not a recomputation."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of this machine for a local master, else an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        jvm = sc._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        sc.setCheckpointDir(folder)
        return sc._jsc.sc().getCheckpointDir().get()
    return folder


def given_back(run):
    """run over batches, after which the worker gives its freed memory back: the stages that follow in it share the executor's."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return wrapped


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; removed when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/siltstone-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the tables that df alone was read from, when no later plan needs them."""
    spark = df.sparkSession
    mine = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for item in [x for x in _written if x[1] in mine or any(m.endswith(x[1].split(":", 1)[-1]) for m in mine)]:
        _written.remove(item)
        _delete(spark, item[1])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone by now; its shared folder is swept by the cluster
            return
