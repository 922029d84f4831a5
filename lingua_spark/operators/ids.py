"""Dense sequential numbering without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark.session import cut_lineage


def range_sorted(df: DataFrame, order: list, bucket: str) -> DataFrame:
    """`df` range-sorted by `order`, with the range bucket of each row, written once.

    The bucket is the physical range partition. Its bounds come from a sample that another
    evaluation may draw differently, so the sorted rows and their buckets are checkpointed:
    whatever reads the result later sees the same buckets."""
    return cut_lineage(df.sort(*order).withColumn(bucket, F.spark_partition_id()))


def sequential_ids(df: DataFrame, order_cols: list, id_col: str, start: int | Column = 1) -> DataFrame:
    """Number rows 0.. in `order_cols` order, plus `start`, like zipWithIndex.

    Each range bucket of the sorted rows numbers its own rows, and a table of bucket counts
    (one row per bucket) supplies the offsets.
    """
    ordered = range_sorted(df, order_cols, "_pid")
    local = ordered.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)) - 1)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    start_col = start if not isinstance(start, int) else F.lit(start)
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(id_col, (F.col("_off") + F.col("_rn") + start_col).cast("long"))
            .drop("_pid", "_rn", "_off"))
