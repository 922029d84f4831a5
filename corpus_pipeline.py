"""Corpus cleaning pipeline over documents: toxic documents go, later near-duplicate lines go, one document of each
near-duplicate group stays, documents with benchmark passages go, and what is left is encoded.

`run` writes every stage's result as Parquet in the shared folder and gives it, read again, to the next stage, so a
lost executor costs work of the running stage alone. Every stage but the last returns the columns of documents, extra
ones included; the last one returns the encoding.

Defined cases: a null or empty text is not toxic, has no lines, links with nothing, holds no passage and encodes to no token;
line dedup drops a document that it leaves without any line, and keeps one whose text it does not change, null included.
Rows without doc_id are not compared with others and stay. Of rows with one doc_id, near-dedup keeps the smallest text. Repeated
rows are near copies of each other. Extra columns may have any name, those used inside the stages included. An empty table goes
through all stages; labels without either class fail no stage (see `toxicity`). Texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lingua_spark.llm.bpe import encode
from lingua_spark.llm.common import read, stored
from lingua_spark.llm.decontamination import drop_contaminated
from lingua_spark.llm.line_dedup import drop_later_lines
from lingua_spark.llm.near_dup import keep_one_of_each
from lingua_spark.llm.queries import word_tokenizer
from lingua_spark.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_later_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the ids decoded again."""
    return encode(docs, word_tokenizer()).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("bpe", bpe)]

#: A fitted classifier and a tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
