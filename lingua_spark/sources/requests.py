"""SRC-1 / SRC-4: typed loaders with the reference's defaults and required-field checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark import schemas as S


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    r = spark.read.schema(schema)
    if fmt == "json":
        return r.json(path)
    if fmt == "parquet":
        return r.parquet(path)
    return r.format(fmt).load(path)


def apply_request_defaults(df: DataFrame) -> DataFrame:
    """Strings '' when null; source auto, tone neutral, use_cache true, alternatives 0 when missing."""
    out = df
    for c in S.REQUEST_STRING_COLS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = (out.withColumn("source_lang", F.when(F.col("source_lang") == "", "auto").otherwise(F.col("source_lang")))
              .withColumn("tone", F.when(F.col("tone") == "", "neutral").otherwise(F.col("tone"))))
    if "use_cache" not in out.columns:
        out = out.withColumn("use_cache", F.lit(True))
    out = out.withColumn("use_cache", F.coalesce(F.col("use_cache"), F.lit(True)))
    if "alternatives" not in out.columns:
        out = out.withColumn("alternatives", F.lit(0))
    out = out.withColumn("alternatives", F.coalesce(F.col("alternatives").cast("int"), F.lit(0)))
    if "ts" not in out.columns:
        out = out.withColumn("ts", F.lit(None).cast("timestamp"))
    return out


def load_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-1: typed read (no inference) plus defaults."""
    return apply_request_defaults(_read(spark, path, fmt, S.REQUESTS))


def documents_with_status(df: DataFrame) -> DataFrame:
    """SRC-4: adds `error`: missing content/format/target, or an unsupported format."""
    content, fmt, target = (F.coalesce(F.col(c), F.lit("")) for c in ("content", "format", "target_lang"))
    err = (F.when((content == "") | (fmt == "") | (target == ""),
                  F.lit(f"{K.ERR_INVALID_INPUT}: content, format and target_language required"))
           .when(~fmt.isin(*K.DOCUMENT_FORMATS), F.concat(F.lit(f"{K.ERR_INVALID_INPUT}: unsupported format "), fmt)))
    out = df
    if "source_lang" not in out.columns:
        out = out.withColumn("source_lang", F.lit("auto"))
    out = out.withColumn("source_lang", F.when(F.coalesce(F.col("source_lang"), F.lit("")) == "", "auto")
                         .otherwise(F.col("source_lang")))
    return out.withColumn("error", err)


def load_documents(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """SRC-4: (accepted, rejected) split of a document table."""
    df = documents_with_status(_read(spark, path, fmt, S.DOCUMENTS))
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())
