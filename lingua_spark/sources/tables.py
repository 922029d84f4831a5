"""Inputs derived from the provided parquet tables (FIXTURES.md part A).

Each derivation has a twin CTE in plans/oracle.py; both must stay identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark.session import spread, table_path

EPOCH_DAY = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
AS_OF = "TIMESTAMP_NTZ'2024-01-01 06:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str, task_bytes: int | None = None) -> DataFrame:
    return spread(spark.read.parquet(table_path(sf_dir, name)), task_bytes)


def requests_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One translate request per document: target es (fr for Spanish documents)."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("request_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("source_lang"),
        F.when(F.col("lang") == "es", "fr").otherwise("es").alias("target_lang"),
        F.lit("").alias("provider"), F.lit("").alias("model"), F.lit("").alias("context"),
        F.lit("neutral").alias("tone"), F.lit(True).alias("use_cache"), F.lit(0).alias("alternatives"))


def glossary_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names (global), nation names (es / fr by region), first words of benchmark passages (es).

    Benchmark passages that start with a non-ASCII letter give an empty term (rejected by SRC-2).
    """
    r = read(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).cast("long").alias("entry_no"), F.col("r_name").alias("source_term"),
        F.lit("").alias("target_lang"), F.lower("r_name").alias("translation"), F.lit("region").alias("context"),
        F.lit(False).alias("case_sensitive"))
    n = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 6).cast("long").alias("entry_no"), F.col("n_name").alias("source_term"),
        F.when(F.col("n_regionkey") % 2 == 0, "es").otherwise("fr").alias("target_lang"),
        F.lower("n_name").alias("translation"), F.lit("nation").alias("context"),
        (F.col("n_nationkey") % 3 == 0).alias("case_sensitive"))
    b = (read(spark, sf_dir, "benchmark")
         .select("item_id", F.regexp_extract("text", r"^([A-Za-z]*)", 1).alias("w"))
         .groupBy("w").agg(F.min("item_id").alias("item_id"))
         .select((F.col("item_id") + 100).cast("long").alias("entry_no"), F.col("w").alias("source_term"),
                 F.lit("es").alias("target_lang"),
                 F.when(F.col("w") == "", "").otherwise(F.concat(F.lit("{"), F.lower("w"), F.lit("}")))
                 .alias("translation"),
                 F.lit("benchmark").alias("context"), F.lit(False).alias("case_sensitive")))
    return (r.unionByName(n).unionByName(b)
            .withColumn("added_at", F.lit(None).cast("timestamp_ntz")))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary used by the translate jobs: every derived entry with a term and a
    translation; region entries stay global (target_lang '')."""
    g = glossary_raw(spark, sf_dir)
    return g.filter((F.col("source_term") != "") & (F.col("translation") != ""))


def tm_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        (F.col("item_id") + 1).cast("long").alias("id"), F.col("text").alias("source_text"),
        F.concat(F.lit("translated:"), F.col("text")).alias("target_text"), F.lit("en").alias("source_lang"),
        F.lit("es").alias("target_lang"), F.lit("").alias("domain"), F.lit("").alias("project"),
        F.lit("").alias("client"), F.array().cast("array<string>").alias("tags"),
        F.expr(EPOCH_DAY).alias("created_at"))


def call_log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("tool"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        F.sha2(F.concat_ws("\u0000", F.col("user_id").cast("string"), F.col("event_type")), 256).alias("key_hash"),
        (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("cached"),
        (F.col("value") / 100).alias("latency_s"), F.col("props").alias("input_text"),
        F.col("event_type").alias("output_text"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("HTTP "), (F.lit(400) + F.floor("value").cast("long") % 100).cast("string")))
        .alias("error"), "user_id", "value")


def cache_from_labels(spark: SparkSession, sf_dir: str, glossary_df: DataFrame | None) -> DataFrame:
    """A cache written before the run: one answer per labelled document, keyed like the
    translate job keys it, written request_id seconds after the epoch day. Fresh for 24h when quality = 1, else only 1h (expired at AS_OF).
    Tier 1 + toxic (for the tiered lookup)."""
    from lingua_spark.plans.translate import keyed_requests
    labels = read(spark, sf_dir, "labels")
    reqs = requests_from_documents(spark, sf_dir).join(
        labels.withColumnRenamed("doc_id", "request_id"), "request_id")
    keyed, _ = keyed_requests(reqs, glossary_df)
    created = F.expr(EPOCH_DAY) + F.make_dt_interval(secs=F.col("request_id").cast("int"))
    hours = F.when(F.col("quality") == 1, F.lit(24)).otherwise(F.lit(1))
    return keyed.select(
        "key_hash",
        F.struct(F.concat(F.lit("cached:"), F.col("request_id").cast("string")).alias("translation"),
                 F.col("source_lang").alias("source_language"), F.col("target_lang").alias("target_language"),
                 F.col("provider_name").alias("provider"), F.col("model").alias("model"),
                 F.lit(False).alias("cached"), F.lit(1.0).alias("confidence"),
                 F.lit(None).cast("array<string>").alias("alternatives"),
                 F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
        .alias("response"),
        created.alias("created_at"), (created + F.make_dt_interval(hours=hours)).alias("expires_at"),
        (F.lit(1) + F.col("toxic")).cast("int").alias("tier"), "request_id")


def timed_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived glossary with add times: entry n added n hours after the epoch day."""
    return glossary(spark, sf_dir).withColumn(
        "added_at", F.expr(EPOCH_DAY) + F.make_dt_interval(hours=F.col("entry_no").cast("int")))


def timed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document requests stamped ten minutes apart by doc_id."""
    return requests_from_documents(spark, sf_dir).withColumn(
        "ts", F.expr(EPOCH_DAY) + F.make_dt_interval(mins=(F.col("request_id") * 10).cast("int")))
