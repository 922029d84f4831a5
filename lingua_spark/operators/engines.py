"""Translation engines: UD-1 registry / runner, UD-2 mock engine, UD-3 detectors.

An engine maps a DataFrame of distinct work rows
    (key_hash, text, source_lang, target_lang, provider, model, context, tone, alternatives)
to answers
    (key_hash, translation, source_language, confidence, alternative_texts, input_tokens, output_tokens, error).
`error` is null on success; alternative_texts (array of strings) may be left out. Native engines are DataFrame -> DataFrame functions; Python
engines receive pandas batches through mapInPandas (Arrow), never single rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.session import small_batches

ENGINE_OUTPUT = ("key_hash string, translation string, source_language string, confidence double, "
                 "alternative_texts array<string>, input_tokens long, output_tokens long, error string")
ENGINE_COLUMNS = ["key_hash", "translation", "source_language", "confidence", "alternative_texts", "input_tokens",
                  "output_tokens", "error"]
#: About so many bytes of texts make one frame of a detector: pandas holds a text and what is derived from it several times.
DETECTOR_BYTES = 2 << 20
DETECTOR_OUTPUT = "row_key string, language string, confidence double"
WORK_COLUMNS = ["key_hash", "text", "source_lang", "target_lang", "provider", "model", "context", "tone",
                "alternatives"]

_ENGINES: dict[str, tuple[str, Callable]] = {}
_DETECTORS: dict[str, Callable] = {}


def register_engine(name: str, fn: Callable, kind: str = "pandas") -> None:
    """UD-1: kind 'pandas' -> fn(pandas.DataFrame) -> pandas.DataFrame per batch;
    kind 'native' -> fn(DataFrame) -> DataFrame."""
    if kind not in ("pandas", "native"):
        raise ValueError(f"unknown engine kind {kind}")
    _ENGINES[name] = (kind, fn)


def has_engine(name: str) -> bool:
    return name in _ENGINES


class EngineUnavailable(Exception):
    """Raised by a pandas engine that can't answer at all: every row of the batch gets the error at once."""


def answer_rows(fn: Callable, rows: "pd.DataFrame", answer_cols: list[str]) -> "pd.DataFrame":
    """A pandas engine's answers for a batch, one per row and in order.

    A call that raises, or that returns another number of rows than it was given, is made again for each half of its
    rows, down to single ones: so only the rows that the engine can't answer get an error (and go on along the
    provider chain), all others keep their answers. k such rows among n cost about k * log2(n) more calls."""
    import pandas as pd
    if not len(rows):
        return pd.DataFrame({c: pd.Series(dtype=object) for c in answer_cols})
    try:
        ans = fn(rows.copy())
        if len(ans) == len(rows):
            return ans.reset_index(drop=True).assign(**{c: None for c in answer_cols if c not in ans.columns})[answer_cols]
        problem, whole = f"engine returned {len(ans)} rows for {len(rows)}", False
    except EngineUnavailable as e:
        problem, whole = str(e) or K.ERR_PROVIDER_UNAVAILABLE, True
    except Exception as e:  # noqa: BLE001 - whatever a user's engine raises is an error of its rows
        problem, whole = f"{type(e).__name__}: {e}", False
    if whole or len(rows) == 1:
        out = pd.DataFrame({c: [None] * len(rows) for c in answer_cols}, dtype=object)
        return out.assign(error=problem)
    half = len(rows) // 2
    parts = [answer_rows(fn, part.reset_index(drop=True), answer_cols) for part in (rows[:half], rows[half:])]
    return pd.concat([p.astype(object).where(p.notna(), None) for p in parts], ignore_index=True)


def run_engine(work: DataFrame, name: str) -> DataFrame:
    """UD-1: run a registered engine over (already deduplicated) work rows.

    The result keeps every input column and adds the answer columns, so callers never
    join the engine output back to its input (no second evaluation of the input).
    Native engines must keep unknown columns; pandas engines return one row per input
    row, in input order; rows that a pandas engine can't answer get an error (see answer_rows).
    """
    if name not in _ENGINES:
        raise KeyError(f"{K.ERR_NOT_FOUND}: engine {name}")
    kind, fn = _ENGINES[name]
    answer_cols = [c for c in ENGINE_COLUMNS if c != "key_hash"]
    base = work.drop(*[c for c in answer_cols if c in work.columns])
    if kind == "native":
        out = fn(base)
        if "alternative_texts" not in out.columns:
            out = out.withColumn("alternative_texts", F.lit(None).cast("array<string>"))
        return out.select(*base.columns, *answer_cols)
    from pyspark.sql.types import StructType
    out_schema = StructType(list(base.schema.fields) + [
        f for f in StructType.fromDDL(ENGINE_OUTPUT).fields if f.name != "key_hash"])
    cols = base.columns

    def batches(it):
        import pandas as pd
        for pdf in it:
            pdf = pdf.reset_index(drop=True)
            ans = answer_rows(fn, pdf[[c for c in WORK_COLUMNS if c in pdf.columns]], answer_cols)
            yield pd.concat([pdf[cols], ans], axis=1)
    return base.mapInPandas(batches, out_schema)


def mock_engine(dictionary: DataFrame | None = None, fails: bool = False) -> Callable[[DataFrame], DataFrame]:
    """UD-2: deterministic engine. Dictionary hit -> its translation, else 'translated:' + text;
    confidence 0.9; source language echoed. `fails` makes every call fail ('mock failure').

    Pure DataFrame: the dictionary is an equi join on the text (Spark picks broadcast from
    its size statistics, else a shuffle join).
    """
    def run(work: DataFrame) -> DataFrame:
        if fails:
            return (work.withColumn("translation", F.lit(None).cast("string"))
                    .withColumn("source_language", F.col("source_lang"))
                    .withColumn("confidence", F.lit(None).cast("double"))
                    .withColumn("input_tokens", F.lit(0).cast("long"))
                    .withColumn("output_tokens", F.lit(0).cast("long"))
                    .withColumn("error", F.lit("mock failure")))
        w = work
        if dictionary is not None:
            d = dictionary.select(F.col("source_text").alias("_src"), F.col("translation").alias("_dict"))
            w = w.join(d, w["text"] == d["_src"], "left").drop("_src")
        else:
            w = w.withColumn("_dict", F.lit(None).cast("string"))
        return (w.withColumn("translation", F.coalesce(F.col("_dict"), F.concat(F.lit("translated:"), F.col("text"))))
                .withColumn("source_language", F.col("source_lang"))
                .withColumn("confidence", F.lit(K.MOCK_CONFIDENCE))
                .withColumn("input_tokens", F.lit(0).cast("long"))
                .withColumn("output_tokens", F.lit(0).cast("long"))
                .withColumn("error", F.lit(None).cast("string")).drop("_dict"))
    return run


def register_detector(name: str, fn: Callable) -> None:
    """UD-3: fn(pandas.DataFrame[row_key, text]) -> pandas.DataFrame[row_key, language, confidence]."""
    _DETECTORS[name] = fn


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about DETECTOR_BYTES, a row at least."""
    rows = max(1, batch.num_rows * DETECTOR_BYTES // max(1, batch.get_total_buffer_size()))
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def run_detector(df: DataFrame, name: str, key: str = "row_key", text: str = "text") -> DataFrame:
    """UD-3: run a registered detector on pandas frames of about DETECTOR_BYTES, from Arrow batches of a few MB;
    language is normalized afterwards."""
    from lingua_spark.functions.text import normalize_language
    if name not in _DETECTORS:
        raise KeyError(f"{K.ERR_NOT_FOUND}: detector {name}")
    fn = _DETECTORS[name]
    small_batches(df.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in _slices(batch):
                out = fn(part.to_pandas())
                yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(out[c], type=t) for c, t in (("row_key", pa.string()), ("language", pa.string()), ("confidence", pa.float64()))],
                                                 ["row_key", "language", "confidence"])
    out = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).mapInArrow(batches, DETECTOR_OUTPUT)
    return out.withColumn("language", normalize_language("language"))
