"""Lineage cuts in the cluster's shared folder, and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python tasks work through their rows in slices of about this many bytes of text.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (spark.checkpoint.dir). Where that is unset, a local session gets one of our own; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path


@lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="chronolane-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the shuffles and broadcasts behind it are of no more use; Spark drops them once the driver has collected its garbage
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch between Spark and a Python task; each lives a few times over on both sides.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a query; its session is held to batches that leave an executor room."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:  # what somebody has set stays
        spark.conf.set(limit, f"{BATCH_BYTES}b")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about `limit` bytes of `column`; one longer text is a batch of its own."""
    for batch in batches:
        col = batch.column(column)
        width = 4 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else 8
        if not len(col):
            continue
        offsets = np.frombuffer(col.buffers()[1], np.int32 if width == 4 else np.int64)[col.offset : col.offset + len(col) + 1]
        start = 0
        while start < len(col):
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), len(col))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Returns what the allocators hold free to the system; idle workers of an executor share its memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def most_counted(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys with the highest counts, at most `most`: all those above a count that a histogram of counts gives. Sorted by key."""
    level = F.when(F.col("c") < 1000, F.col("c")).otherwise(1000 + F.floor(20 * F.log(F.col("c") / 1000)))
    histogram = counts.groupBy(level.alias("level")).count().collect()  # under 2000 rows
    least, total = None, 0
    for r in sorted(histogram, key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(level >= least).select("k", "c").toArrow()
    k, c = found.column("k").to_numpy(), found.column("c").to_numpy()
    order = np.argsort(k)
    return k[order], c[order]
