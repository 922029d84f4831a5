"""Ordered analytics over the call log: WN-4 failure runs, WN-5 over-rate calls, SO-1 ranking.

Running scans (sums / maxima in time order per provider) are computed per
(provider, range bucket) window plus a carry from a small per-bucket summary. Buckets are of
even size, so one provider that holds all calls of a day is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark.operators.ids import range_sorted


def order_buckets(df: DataFrame, part: str, order: list, bucket: str) -> DataFrame:
    """`df` with buckets that are monotone in `order` within each `part` and of even size, whatever
    share of the rows one `part` holds: the range buckets of a sort by (part, order)."""
    return range_sorted(df, [F.col(part), *order], bucket)


def bucketed_scan(df: DataFrame, part: str, bucket: str, order: list, value: Column, out: str,
                  how: str = "sum", peers: bool = False) -> DataFrame:
    """Running sum / max of `value` per `part` in `order`, inclusive of the current row.

    `bucket` must be monotone in `order`. peers=True: `order` is one numeric column and
    rows with equal order values are included (RANGE frame).
    """
    agg = F.sum if how == "sum" else F.max
    v = "_scan_v"
    d = df.withColumn(v, value)
    w = Window.partitionBy(part, bucket).orderBy(*order)
    w = w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_local", agg(v).over(w))
    summary = d.groupBy(part, bucket).agg(agg(v).alias("_b"))
    carry = summary.withColumn("_carry", agg("_b").over(
        Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).drop("_b")
    j = local.join(carry, [part, bucket], "left")
    if how == "sum":
        res = F.coalesce(F.col("_carry"), F.lit(0)) + F.col("_local")
    else:
        res = F.greatest(F.col("_carry"), F.col("_local"))
    return j.withColumn(out, res).drop(v, "_local", "_carry")


def failure_runs(log: DataFrame, threshold: int, part: str = "provider", id_col: str = "call_id",
                 start: DataFrame | None = None) -> DataFrame:
    """WN-4: consecutive failures per provider in (ts, id) order, reset by a success;
    `run_len` = failures so far in the current run (0 on success rows); `tripped` marks the
    row where the run reaches `threshold` (the breaker opens there). `start`: (provider, run)
    carried in from before, for the rows up to a provider's first success."""
    order = [F.col("ts"), F.col(id_col)]
    d = order_buckets(log, part, order, "_bk")
    d = bucketed_scan(d, part, "_bk", order, F.when(F.col("ok"), 0).otherwise(1), "_fails", "sum")
    d = bucketed_scan(d, part, "_bk", order, F.when(F.col("ok"), F.col("_fails")), "_at_ok", "max")
    before = F.lit(0)
    if start is not None:
        d = d.join(start.select(part, F.col("run").alias("_run")), part, "left")
        before = F.coalesce("_run", F.lit(0))
    run = F.when(F.col("_at_ok").isNotNull(), F.col("_fails") - F.col("_at_ok")).otherwise(F.col("_fails") + before).cast("long")
    return (d.withColumn("run_len", run)
            .withColumn("tripped", ~F.col("ok") & (F.col("run_len") == threshold))
            .drop("_bk", "_fails", "_at_ok", "_run"))


def over_rate(log: DataFrame, rate_per_s: float, burst: int, seconds: float, part: str = "provider",
              t_us: str = "t_us") -> DataFrame:
    """WN-5: calls whose trailing window (t - seconds, t] holds more than
    burst + rate * seconds calls of the same provider (a token bucket would have delayed them).

    count(t) = #calls at or before t - #calls at or before t - seconds, written as a running
    sum over the calls (+1) and their expiry markers (-1 at t + seconds), ties included.
    """
    w_us = int(round(seconds * 1_000_000))
    calls = log.withColumn("_d", F.lit(1)).withColumn("_ord", F.col(t_us))
    marks = (log.select(part, (F.col(t_us) + F.lit(w_us)).alias("_ord"))
             .withColumn("_d", F.lit(-1)))
    both = order_buckets(calls.unionByName(marks, allowMissingColumns=True), part, [F.col("_ord")], "_bk")
    scanned = bucketed_scan(both, part, "_bk", [F.col("_ord")], F.col("_d"), "in_window", "sum", peers=True)
    limit = burst + rate_per_s * seconds
    return (scanned.filter(F.col("_d") == 1).withColumn("in_window", F.col("in_window").cast("long"))
            .withColumn("over", F.col("in_window") > F.lit(limit)).drop("_d", "_ord", "_bk"))


def rank_results(df: DataFrame, k: int | None = None, part: str = "query_id", score: str = "score",
                 id_col: str = "id", salts: int = 64) -> DataFrame:
    """SO-1: result_rank by score desc, id asc within each query; optional top-k per query.

    No query is ranked by a single task: the full ranking is a range-partitioned global
    sort (written once, see ids.range_sorted), local row numbers per (range bucket, query)
    and per-query offsets from a small count table; top-k first keeps the k best per (query, id salt), then ranks the
    at most salts * k survivors of each query.
    """
    if k is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
        w1 = Window.partitionBy(part, "_salt").orderBy(F.col(score).desc(), F.col(id_col).asc())
        pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
        w2 = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(id_col).asc())
        return (pre.withColumn("result_rank", F.row_number().over(w2).cast("long"))
                .filter(F.col("result_rank") <= k))
    ordered = range_sorted(df, [F.col(part).asc(), F.col(score).desc(), F.col(id_col).asc()], "_pid")
    local = ordered.withColumn("_rn", F.row_number().over(
        Window.partitionBy("_pid", part).orderBy(F.col(score).desc(), F.col(id_col).asc())))
    counts = local.groupBy(part, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return (local.join(offsets, [part, "_pid"])
            .withColumn("result_rank", (F.col("_off") + F.col("_rn")).cast("long")).drop("_pid", "_rn", "_off"))
