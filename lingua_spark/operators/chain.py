"""Provider chain and batch expansion: BT-1..BT-4, FN-13, JN-7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.functions.text import first_nonempty


def providers_table(spark: SparkSession, providers=None) -> DataFrame:
    """Provider catalogue: (provider, default_model, uses_glossary). A small dimension table."""
    rows = providers if providers is not None else K.PROVIDERS
    return spark.createDataFrame(rows, "provider string, default_model string, uses_glossary boolean")


def languages_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.LANGUAGES, "code string, name string")


def language_names(df: DataFrame, code_col: str, out_col: str = "language_name") -> DataFrame:
    """JN-7: code -> display name, or the code itself when unknown (broadcast of 30 rows)."""
    langs = languages_table(df.sparkSession).withColumnRenamed("code", "_code").withColumnRenamed("name", "_name")
    return (df.join(F.broadcast(langs), F.col(code_col) == F.col("_code"), "left")
            .withColumn(out_col, F.coalesce(F.col("_name"), F.col(code_col))).drop("_code", "_name"))


def supported_languages(spark: SparkSession) -> DataFrame:
    """JN-7: the static language list sorted by code."""
    return languages_table(spark).orderBy("code")


def resolve_model(df: DataFrame, providers: DataFrame, provider_col: str = "provider_name",
                  model_col: str = "model") -> DataFrame:
    """FN-13: request model, else the provider's default model ('' for unknown providers)."""
    p = providers.select(F.col("provider").alias("_p"), F.col("default_model").alias("_dm"))
    return (df.join(F.broadcast(p), F.col(provider_col) == F.col("_p"), "left")
            .withColumn(model_col, first_nonempty(F.col(model_col), F.col("_dm"))).drop("_p", "_dm"))


def chain_array(requested: Column, known: list[str], fallback: list[str]) -> Column:
    """BT-3 as an array: requested provider first when known, then the fallback order without
    it, unknown names skipped. Duplicates inside `fallback` are kept, as in the reference."""
    knownc = F.lit(known) if known else F.array().cast("array<string>")
    fb = F.lit(fallback) if fallback else F.array().cast("array<string>")
    head = F.filter(F.array(requested), lambda p: F.array_contains(knownc, p))
    tail = F.filter(fb, lambda p: F.array_contains(knownc, p) & (p != requested))
    return F.concat(head, tail)


def resolve_chain(requests: DataFrame, known: list[str], fallback: list[str],
                  default_provider: str = K.DEFAULT_PROVIDER, provider_col: str = "provider") -> DataFrame:
    """BT-3: one row per (request, rank, chain_provider); provider_name = requested or default."""
    req = requests.withColumn("provider_name", first_nonempty(F.col(provider_col), F.lit(default_provider)))
    return req.select("*", F.posexplode(chain_array(F.col("provider_name"), known, fallback))
                      .alias("rank", "chain_provider"))


def first_success(chain: DataFrame, outcomes: DataFrame, key: str = "request_id") -> DataFrame:
    """BT-4: the lowest-rank successful answer per key; otherwise the error of the highest
    rank tried; no chain at all -> 'provider unavailable'.

    chain: (key, rank, chain_provider); outcomes: (key, chain_provider, ok, translation, error).
    """
    j = chain.select(key, "rank", "chain_provider").join(outcomes, [key, "chain_provider"], "left")
    agg = j.groupBy(key).agg(
        F.min_by(F.struct("chain_provider", "translation"), F.when(F.col("ok"), F.col("rank"))).alias("_ok"),
        F.max_by(F.col("error"), F.when(~F.col("ok"), F.col("rank"))).alias("_err"),
        F.max(F.col("ok").cast("int")).alias("_any"))
    return agg.select(
        key,
        F.when(F.col("_any") == 1, F.col("_ok.chain_provider")).alias("provider"),
        F.when(F.col("_any") == 1, F.col("_ok.translation")).alias("translation"),
        F.when(F.coalesce(F.col("_any"), F.lit(0)) == 0,
               F.coalesce(F.col("_err"), F.lit(f"{K.ERR_PROVIDER_UNAVAILABLE}: no provider available")))
        .alias("error"))


def batch_one_to_many(df: DataFrame, targets_col: str = "targets", max_items: int = K.MAX_BATCH_ITEMS,
                      id_col: str = "batch_id") -> DataFrame:
    """BT-1: one text x target array -> one request per target (position kept).
    Empty target list or more than max_items -> one rejected row with `error`."""
    n = F.coalesce(F.size(F.col(targets_col)), F.lit(0))
    err = (F.when(n <= 0, F.lit(f"{K.ERR_INVALID_INPUT}: targets required"))
           .when(n > max_items, F.lit(f"{K.ERR_INVALID_INPUT}: too many targets")))
    base = df.withColumn("error", err)
    ok = (base.filter(F.col("error").isNull())
          .select("*", F.posexplode(targets_col).alias("item_pos", "target_lang")).drop(targets_col))
    bad = (base.filter(F.col("error").isNotNull()).drop(targets_col)
           .withColumn("item_pos", F.lit(None).cast("int")).withColumn("target_lang", F.lit(None).cast("string")))
    return ok.unionByName(bad)


def batch_many_to_one(df: DataFrame, items_col: str = "items", default_target_col: str = "target_lang",
                      max_items: int = K.MAX_BATCH_ITEMS) -> DataFrame:
    """BT-2: items array<struct<text, target_lang>> -> one request per item; the item's
    target, else the batch default. Empty or too many items -> one rejected row."""
    n = F.coalesce(F.size(F.col(items_col)), F.lit(0))
    err = (F.when(n <= 0, F.lit(f"{K.ERR_INVALID_INPUT}: items required"))
           .when(n > max_items, F.lit(f"{K.ERR_INVALID_INPUT}: too many items")))
    base = df.withColumn("error", err)
    ok = (base.filter(F.col("error").isNull())
          .select("*", F.posexplode(items_col).alias("item_pos", "_it"))
          .withColumn("text", F.coalesce(F.col("_it.text"), F.lit("")))
          .withColumn(default_target_col, first_nonempty(F.col("_it.target_lang"), F.col(default_target_col)))
          .drop("_it", items_col))
    bad = (base.filter(F.col("error").isNotNull()).drop(items_col)
           .withColumn("item_pos", F.lit(None).cast("int")).withColumn("text", F.lit(None).cast("string")))
    return ok.unionByName(bad, allowMissingColumns=True)


def list_languages(requests: DataFrame, known: list[str], provider_col: str = "provider",
                   default_provider: str = K.DEFAULT_PROVIDER) -> DataFrame:
    """JN-7 list_languages per request: a configured provider lists the static languages
    (n_languages); an unknown one gives 'not found: provider <name>' (the anti-join rows)."""
    p = first_nonempty(F.col(provider_col), F.lit(default_provider))
    knownc = F.lit(known) if known else F.array().cast("array<string>")
    ok = F.array_contains(knownc, p)
    return requests.withColumn("provider_name", p).withColumn(
        "n_languages", F.when(ok, F.lit(len(K.LANGUAGES)).cast("long"))).withColumn(
        "error", F.when(~ok, F.concat(F.lit(f"{K.ERR_NOT_FOUND}: provider "), p)))
