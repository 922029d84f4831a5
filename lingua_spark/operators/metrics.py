"""Usage analytics over the call log: AG-1..AG-6.

Every metric is a grouped aggregate with map-side partial aggregation; no window and no
per-row Python. call_log columns: ts, tool, provider, key_hash, ok, cached, latency_s,
input_text, output_text, error (+ a unique call_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.functions.text import estimate_tokens, normalize_text


def request_counts(log: DataFrame, by: str = "tool") -> DataFrame:
    """AG-1: requests per tool."""
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("requests"))


def _le_label(b: float) -> str:
    return repr(b) if b != int(b) else f"{b:.1f}"


def latency_histogram(log: DataFrame, buckets: list[float] = K.LATENCY_BUCKETS, by: str = "tool") -> DataFrame:
    """AG-2: cumulative `le` buckets (+Inf last), sum and count per tool.

    One pass: one conditional count per bucket inside the aggregate, then the aggregated
    row (not the log) is exploded into one row per bucket.
    """
    aggs = [F.count_if(F.col("latency_s") <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(buckets)]
    agg = log.groupBy(by).agg(*aggs, F.count(F.lit(1)).alias("_n"), F.sum("latency_s").alias("latency_sum"))
    labels = [_le_label(b) for b in buckets] + ["+Inf"]
    pairs = F.array(*[F.struct(F.lit(lbl).alias("le"), F.col(f"_b{i}").alias("c")) for i, lbl in enumerate(labels[:-1])],
                    F.struct(F.lit("+Inf").alias("le"), F.col("_n").alias("c")))
    return agg.select(by, F.explode(pairs).alias("_p"), "latency_sum", F.col("_n").alias("latency_count")).select(
        by, F.col("_p.le").alias("le"), F.col("_p.c").cast("long").alias("cumulative_count"), "latency_sum",
        "latency_count")


def cache_hits(log: DataFrame, by: str = "tool") -> DataFrame:
    """AG-3: cache hits, calls and hit ratio per group."""
    return log.groupBy(by).agg(F.count_if("cached").alias("hits"), F.count(F.lit(1)).alias("calls")).withColumn(
        "hit_ratio", F.col("hits") / F.col("calls"))


def provider_calls(log: DataFrame) -> DataFrame:
    """AG-4: successful uncached calls and errors per provider."""
    return log.groupBy("provider").agg(F.count_if(F.col("ok") & ~F.col("cached")).alias("calls"),
                                       F.count_if(~F.col("ok")).alias("errors"))


def token_totals(log: DataFrame) -> DataFrame:
    """AG-5: estimated input (normalized) and output tokens of successful, uncached calls."""
    paid = log.filter(F.col("ok") & ~F.col("cached"))
    return paid.groupBy("provider").agg(
        F.sum(estimate_tokens(normalize_text(F.coalesce("input_text", F.lit(""))))).alias("input_tokens"),
        F.sum(estimate_tokens(F.coalesce("output_text", F.lit("")))).alias("output_tokens"))


def provider_status(log: DataFrame, id_col: str = "call_id") -> DataFrame:
    """AG-6: latest outcome per provider: healthy / unhealthy: <error>."""
    last = log.groupBy("provider").agg(
        F.max_by(F.struct("ok", "error"), F.struct("ts", id_col)).alias("_l"))
    return last.select("provider", F.when(F.col("_l.ok"), F.lit("healthy"))
                       .otherwise(F.concat(F.lit("unhealthy: "), F.coalesce(F.col("_l.error"), F.lit(""))))
                       .alias("status"))
