"""Helpers shared by the operators: lineage cuts, fixed-size filters, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lingua_spark.session import cut_lineage, ensure_checkpoint_dir, table_path

#: Bits of a membership filter: 4 MB, whatever the number of members. A full filter lets everything pass.
FILTER_BITS = 1 << 25


#: Bytes of an Arrow batch that a Python worker is given, where the session has Spark's own bound of 64 MB. A scan holds a
#: batch and copies of its parts, so its memory follows this, not the length of the texts.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def read(spark, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH_KEY).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return spark.read.parquet(table_path(sf_dir, name))


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir."""
    return ensure_checkpoint_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its size is then known to the planner."""
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote below `scratch_folder`."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written and no longer referred to; it does so
    when the driver collects its garbage, which may otherwise be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return this process's freed memory to the system: a Python worker lives on in other stages, and its executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has this call
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def membership(df: DataFrame, hash_column: str, bits: int = FILTER_BITS) -> Broadcast:
    """One-hash Bloom filter of a long hash column, as a broadcast bitmap of fixed size.

    Only a pre-filter: what passes is joined exactly afterwards.
    """
    h = F.pmod(F.col(hash_column), F.lit(bits))
    words = (df.select(F.floor(h / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(`{hash_column}`, 64) as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(bits // 64, np.int64)
    if len(words):
        out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return df.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def member(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which int64 hashes the bitmap of `membership` may hold."""
    bits = np.uint64(len(bitmap) * 64 - 1)
    at = hashes.view(np.uint64) & bits
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node reachable.

    Alternating large-star and small-star steps over an edge table, each one map-side-combined
    minimum and one join; every step is checkpointed, and it stops when a step changes nothing.
    Nulls never link. An empty table gives an empty result.
    """
    edges = cut_lineage(links.where("a is not null and b is not null and a <> b")
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
    state = edges.agg(*digest).first()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut_lineage(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(*digest).first()
        if state == now:
            break
        state = now
        release(links.sparkSession)
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = labels.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    return labels.union(roots)
