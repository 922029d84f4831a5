"""Structured Streaming forms of the batch operators: ST-1..ST-5.

Each stream runs its micro-batches through the batch operators (foreachBatch) and writes outputs
and carried state per batch id into its own folder: a replayed batch reads the state of the batch
before it and overwrites its own output, so results are exactly-once. `base` names that folder.
Given again, it resumes where the stream stopped (checkpoint, state and outputs live in it); without
it a new folder below the shared checkpoint folder is taken.

ST-3 and ST-5 depend on event order: see `ordered`, whose state Spark keeps in the checkpoint.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingua_spark.session import cut_lineage, ensure_checkpoint_dir, list_dir, spread
from lingua_spark.streaming.cache_log import CacheLog
from lingua_spark.streaming.ordered import BUCKETS, NO_TIME, RunsPerSlice, WritesByTtl, rocksdb_state, started, state, with_watermark


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over one parquet table (glob form, so a single file is accepted)."""
    schema = spark.read.parquet(path).schema
    glob = path[:-1] + "[" + path[-1] + "]"
    return spark.readStream.schema(schema).parquet(glob)


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "lingua_streams", f"{name}-{uuid.uuid4().hex}")


def drain(writer, base: str) -> None:
    """Run a stream over everything available; it ends by itself, however long it takes."""
    q = writer.option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _write(df: DataFrame, *path: str) -> None:
    df.write.mode("overwrite").parquet(os.path.join(*path))


def _batches(spark: SparkSession, folder: str, kind: str = "batch") -> list[int]:
    """Ids of the finished outputs in a folder."""
    ids = [int(n.split("=")[1]) for n in list_dir(spark, folder) if n.startswith(f"{kind}=")]
    return sorted(i for i in ids if "_SUCCESS" in list_dir(spark, os.path.join(folder, f"{kind}={i}")))


def _outputs(spark: SparkSession, base: str, schema) -> DataFrame:
    """All batch outputs of a stream, with their batch id; empty before the first batch."""
    out = os.path.join(base, "out")
    ids = _batches(spark, out)
    if not ids:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema).option("basePath", out).parquet(*[os.path.join(out, f"batch={i}") for i in ids])


def stream_translate(stream: DataFrame, to_requests, translate_kwargs: dict, name: str = "translate",
                     base: str | None = None) -> DataFrame:
    """ST-1: translate every micro-batch; returns one row per request, refused ones with their error. With a cache
    in `translate_kwargs`, the answers of a batch are in the cache of the next one, so a text is translated once.
    The cache is a `CacheLog`: a batch looks its keys up in the log's runs without shuffling them."""
    from lingua_spark.plans.translate import translate
    from lingua_spark.schemas import CACHE
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    kwargs = dict(translate_kwargs)
    cache = kwargs.pop("cache", None)
    log = CacheLog(spark, os.path.join(base, "cache"), cache.select(*CACHE.names)) if cache is not None else None

    def run(bdf: DataFrame, bid: int) -> None:
        more = {"cache": log.runs(bid)} if log else {}
        result = translate(to_requests(spread(bdf)), **kwargs, **more, answers_once=log is not None)
        _write(result.results, base, "out", f"batch={bid}")
        if log:
            log.write(result.cache_updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in log.schema.fields]), bid)
    drain(stream.writeStream.foreachBatch(run), base)
    return spark.read.parquet(os.path.join(base, "out")).drop("batch")


def stream_cache_upsert(stream: DataFrame, initial_cache: DataFrame, to_rows, name: str = "cache",
                        base: str | None = None) -> DataFrame:
    """ST-2: keyed upsert of every micro-batch into a cache log (latest batch wins); returns the cache."""
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    log = CacheLog(spark, os.path.join(base, "cache"), initial_cache)
    drain(stream.writeStream.foreachBatch(lambda bdf, bid: log.write(to_rows(spread(bdf)), bid)), base)
    return log.table()


def _ordered(stream: DataFrame, keys: list, processor, t_us: str, delay_seconds: float, base: str) -> None:
    """Drain a stream through a processor of `ordered`, writing every batch once."""
    spark = stream.sparkSession
    timed = with_watermark(stream, t_us, int(delay_seconds * 1_000_000))
    out = timed.groupBy(*keys).transformWithStateInPandas(processor, processor.output, "Append", "EventTime")
    with rocksdb_state(spark):
        drain(out.writeStream.foreachBatch(lambda b, bid: _write(b, base, "out", f"batch={bid}")), base)


def stream_dedup(stream: DataFrame, key: str, time_us: str, id_col: str, ttl_seconds: float, delay_seconds: float,
                 name: str = "dedup", base: str | None = None, close: bool = True, late: bool = False) -> DataFrame:
    """ST-3: WN-3 over a stream: (key, id, time, action), 'write' when no write of the key happened within the
    ttl before, else 'hit'. With `late`, late rows come too, with that action. With `close`, rows still held are
    answered as if nothing came any more; they stay held, so a stream started again answers them anew."""
    from lingua_spark.operators.cache import ttl_dedup
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(time_us).cast("long").alias("t_us"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    _ordered(rows, ["bucket"], WritesByTtl(int(round(ttl_seconds * 1_000_000))), "t_us", delay_seconds, base)
    done = _outputs(spark, base, WritesByTtl.output).drop("batch")
    if close and started(spark, base):
        marker = -(1 << 62)  # the key's last write opens the fold of what is held
        with rocksdb_state(spark):
            held = (state(spark, base, "held").select(F.explode(F.arrays_zip("list_element.key", "list_element.id", "list_element.t_us")).alias("row"))
                    .select("row.*"))
            last = (state(spark, base, "last").select(F.explode(F.arrays_zip("value.key", "value.t_us")).alias("row"))
                    .select("row.key", F.lit(marker).alias("id"), "row.t_us"))
            both = cut_lineage(held.unionByName(last.join(held.select("key").distinct(), "key", "left_semi")))
        rest = ttl_dedup(both, ttl_seconds, key="key", ts_micros="t_us", id_col="id").filter(F.col("id") != marker)
        done = done.unionByName(rest.select("key", "id", "t_us", "action"))
    done = done if late else done.filter("action <> 'late'")
    return done.select(F.col("key").alias(key), F.col("id").alias(id_col), F.when(F.col("t_us") != NO_TIME, F.col("t_us")).alias(time_us), "action")


def stream_counts(stream: DataFrame, ts_col: str, by: str, window: str, delay: str, name: str = "counts",
                  base: str | None = None) -> DataFrame:
    """ST-4: calls per tumbling window and group. Update mode: a batch writes the windows it changed, rows later
    than the watermark are dropped and windows beyond it leave the state. Returns the newest count per window."""
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    agg = (stream.withWatermark(ts_col, delay).groupBy(F.window(ts_col, window).alias("w"), by)
           .agg(F.count(F.lit(1)).alias("calls")))
    drain(agg.writeStream.outputMode("update").foreachBatch(lambda b, bid: _write(b, base, "out", f"batch={bid}")), base)
    kind = stream.schema[by].dataType.simpleString()
    rows = _outputs(spark, base, f"w struct<start: timestamp, end: timestamp>, {by} {kind}, calls long")
    return rows.groupBy("w", by).agg(F.max_by("calls", "batch").alias("calls"))


def stream_failure_runs(stream: DataFrame, threshold: int, delay_seconds: float = 0.0, name: str = "runs",
                        base: str | None = None, close: bool = True, slice_seconds: float = 3600.0, late: bool = False) -> DataFrame:
    """ST-5: WN-4 over a stream of (call_id, provider, ok, t_us).

    The state is kept per (provider, time slice), so a provider that makes all calls is spread over its slices; the
    run that goes on from one slice to the next is added when the result is read, from one summary row per slice.
    `close` and `late` as in ST-3; late rows have no run."""
    from lingua_spark.operators.windows import failure_runs
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    width = int(slice_seconds * 1_000_000)
    rows = stream.select("provider", F.floor(F.coalesce("t_us", F.lit(NO_TIME)) / F.lit(width)).cast("long").alias("slice"),
                         F.col("t_us").cast("long"), F.col("call_id").cast("long"), "ok")
    _ordered(rows, ["provider", "slice"], RunsPerSlice(width), "t_us", delay_seconds, base)
    out = _outputs(spark, base, RunsPerSlice.output).drop("batch")
    done = out.filter("not late")
    per = done.groupBy("provider", "slice").agg(F.coalesce(F.max("ok"), F.lit(False)).alias("any_ok"), F.max_by("run", F.struct("t_us", "call_id")).alias("tail"))
    so_far = Window.partitionBy("provider").orderBy("slice")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("total", F.sum("tail").over(so_far)).withColumn("at_ok", F.when(F.col("any_ok"), F.col("total") - F.col("tail")))
           .withColumn("carry", F.coalesce(F.max("total").over(before), F.lit(0)) - F.coalesce(F.max("at_ok").over(before), F.lit(0))))
    carries = per.select(F.col("provider").alias("_p"), F.col("slice").alias("_s"), "carry")
    runs = (done.join(carries, F.col("provider").eqNullSafe(F.col("_p")) & (F.col("slice") == F.col("_s")))
            .withColumn("run_len", F.when(F.col("ok"), 0).otherwise(F.col("run") + F.when(F.col("head"), F.col("carry")).otherwise(0)).cast("long"))
            .withColumn("tripped", ~F.col("ok") & (F.col("run_len") == threshold)).select("call_id", "provider", "run_len", "tripped"))
    if close and started(spark, base):
        with rocksdb_state(spark):
            held = cut_lineage(state(spark, base, "held").select("key.provider", "list_element.*"))
        now = per.groupBy("provider").agg(F.max_by(F.col("tail") + F.when(F.col("any_ok"), 0).otherwise(F.col("carry")), "slice").alias("run"))
        rest = failure_runs(held.withColumn("ts", F.timestamp_micros("t_us")), threshold, start=now)
        runs = runs.unionByName(rest.select("call_id", "provider", "run_len", "tripped"))
    if late:
        runs = runs.unionByName(out.filter("late").select("call_id", "provider", F.lit(None).cast("long").alias("run_len"), F.lit(None).cast("boolean").alias("tripped")))
    return runs
