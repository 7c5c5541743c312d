"""Small helpers that the operators share: sizes, schemas, shared folders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import join_by_key
from ..session import stored as written

__all__ = ["documents", "group_sample", "join_by_key", "parts_for", "plan_bytes", "sampled", "shuffle_partitions", "spread", "written"]

#: Input bytes that one task of a shuffle sized by the input takes.
TASK_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plan_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Catalyst's estimate of a frame's bytes (file sizes, for a scan); measured where it has none."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 55 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, size: float, each: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of so many bytes, ``each`` a task; no fewer than there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 20, int(size) // each + 1))


def _partition(labels: np.ndarray, parts: int) -> np.ndarray:
    """Where Spark's hash partitioning puts int keys (Murmur3 of four bytes, seed 42)."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = turn(labels.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
    h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts


def spread(n: int, parts: int) -> np.ndarray:
    """``n`` int keys of which the i-th is hashed to partition i % parts, so that no partition gets two of few keys."""
    want = np.arange(n) // parts  # how many earlier keys go to the same partition
    size = 16 * n + 64 * parts
    while True:
        at = _partition(np.arange(size), parts)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(parts + 1))
        place = first[np.arange(n) % parts] + want
        if (place < first[np.arange(n) % parts + 1]).all():
            return order[place].astype(np.int32)
        size *= 2


def _share(size: Column, max_bytes: float) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.lit(float(max_bytes)) / F.greatest(F.sum(size), F.lit(1))), F.lit(1.0))


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) / float(1 << 20)


def sampled(df: DataFrame, size: Column, key: str, max_bytes: int) -> DataFrame:
    """Rows that stand for about ``max_bytes`` by their ``size``, chosen by a hash of ``key``.

    The choice depends on the rows alone, so a rerun or a retried task takes the
    same rows.  Only classifiers are fitted on such samples.
    """
    return df.where(_place(key) < df.agg(_share(size, max_bytes).alias("s")).first()["s"])


def group_sample(df: DataFrame, text: str, key: str, max_bytes: int, by: str, full: int) -> DataFrame:
    """As ``sampled``, rows of about ``max_bytes`` of text of each ``by`` group, none of which is null or left out.

    Above ``full`` groups they share the bytes that so many would get.
    """
    sizes = df.groupBy(by).agg(F.sum(F.octet_length(text)).alias("size")).collect()
    each = max_bytes * min(1.0, full / max(1, len(sizes)))
    shares = [(r[by], min(1.0, each / max(r["size"] or 0, 1))) for r in sizes]
    table = df.sparkSession.createDataFrame(shares, "__by string, __share double")
    return df.join(F.broadcast(table), F.col(by) == F.col("__by")).where(_place(key) < F.col("__share")).select(*df.columns)
