"""SRC-7: turn landed raw provider bodies into responses, detections and errors (batch jobs).

landed: (key_hash, provider, model, status, body, source_lang, target_lang).
Each body is parsed once, to a Variant, and every field is read from it by path and type: a field of another type than
its provider sends counts as missing. LLM outputs of translations then go through the model-output rules: fenced
```json {...}``` block, else the outermost {...}, parsed once as well; unparseable
or mistyped -> the raw text with confidence 0.5; parsed but empty translation -> error;
confidence clamped to [0, 1]. LLM outputs of detections must be the JSON object itself. HTTP 429 -> 'rate limited',
other status >= 400 -> 'HTTP n'. Objects with a repeated key are unparseable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.functions.text import first_nonempty, normalize_language

OPENAI_LIKE = ("openai", "openrouter", "custom")
NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"


def _kind(v: Column, path: str) -> Column:
    """Type of a Variant's field: null without the field, VOID for JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str, kind: str) -> Column:
    return F.when(_kind(v, path).rlike(NUMBER), F.try_variant_get(v, path, kind))


def _mistyped(v: Column, path: str, types: str) -> Column:
    """Whether a field is there, not null, and of another type."""
    kind = F.coalesce(_kind(v, path), F.lit("VOID"))
    return (kind != "VOID") & ~kind.rlike(types)


def _content(provider: Column, v: Column) -> Column:
    return (F.when(provider.isin(*OPENAI_LIKE), _text(v, "$.choices[0].message.content"))
            .when(provider == "anthropic", _text(v, "$.content[0].text"))
            .when(provider == "google", _text(v, "$.candidates[0].content.parts[0].text"))
            .when(provider == "ollama", _text(v, "$.message.content"))
            .when(provider == "deepl", _text(v, "$.translations[0].text"))
            .when(provider == "libretranslate", _text(v, "$.translatedText")))


def extract_json(c: Column) -> Column:
    """The fenced JSON block, else the span from the first '{' to the last '}', else null."""
    fenced = F.regexp_extract(c, K.JSON_BLOCK_RE, 1)
    first = F.instr(c, "{")
    last = F.length(c) - F.instr(F.reverse(c), "}") + 1
    span = F.when((first > 0) & (F.instr(F.reverse(c), "}") > 0) & (last >= first), F.substring(c, first, last - first + 1))
    return F.when(fenced != "", fenced).otherwise(span)


def ingest_responses(landed: DataFrame) -> DataFrame:
    """Responses with an `error` column (null on success)."""
    p, status, v, r = F.col("provider"), F.col("status"), F.col("_v"), F.col("_r")
    src_in = F.coalesce(F.col("source_lang"), F.lit(""))
    d = landed.withColumn("_v", F.try_parse_json(F.col("body")))
    d = d.withColumn("_content", _content(p, v))
    llm = ~p.isin("deepl", "libretranslate")
    d = d.withColumn("_r", F.when(llm, F.try_parse_json(extract_json(F.col("_content")))))
    bad = _mistyped(r, "$.translation", "^STRING$") | _mistyped(r, "$.source_language", "^STRING$") | \
        _mistyped(r, "$.confidence", NUMBER) | _mistyped(r, "$.alternatives", r"^ARRAY<(STRING|VOID)>$")
    d = d.withColumn("_parsed", r.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    parsed = F.col("_parsed")
    tr_llm = F.when(parsed, _text(r, "$.translation")).otherwise(F.col("_content"))
    conf_llm = F.when(parsed, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_number(r, "$.confidence", "double"), F.lit(0.0))))) \
        .otherwise(F.lit(K.UNPARSED_CONFIDENCE))
    src_llm = F.when(parsed, normalize_language(first_nonempty(_text(r, "$.source_language"), src_in))).otherwise(src_in)
    detected = (F.when(p == "deepl", F.lower(_text(v, "$.translations[0].detected_source_language")))
                .otherwise(_text(v, "$.detectedLanguage.language")))
    src_fixed = normalize_language(F.when(src_in.isin("", "auto"), F.coalesce(detected, F.lit("auto"))).otherwise(src_in))
    alts = F.when(p == "libretranslate", F.try_variant_get(v, "$.alternatives", "array<string>")) \
        .otherwise(F.when(parsed, F.try_variant_get(r, "$.alternatives", "array<string>")))
    tokens_in = (F.when(p.isin(*OPENAI_LIKE), _number(v, "$.usage.prompt_tokens", "bigint"))
                 .when(p == "anthropic", _number(v, "$.usage.input_tokens", "bigint")))
    tokens_out = (F.when(p.isin(*OPENAI_LIKE), _number(v, "$.usage.completion_tokens", "bigint"))
                  .when(p == "anthropic", _number(v, "$.usage.output_tokens", "bigint")))
    err = (F.when(status == 429, F.concat(F.lit(K.ERR_RATE_LIMITED + ": "), p, F.lit(" rate limited")))
           .when(status >= 400, F.concat(p, F.lit(" translate failed: HTTP "), status.cast("string"), F.lit(": "), F.col("body")))
           .when(F.col("_content").isNull(), F.concat(p, F.lit(" returned no content")))
           .when(llm & parsed & (F.coalesce(_text(r, "$.translation"), F.lit("")) == ""), F.lit(K.ERR_EMPTY_TRANSLATION)))
    fixed_conf = F.when(p == "deepl", F.lit(K.FIXED_CONFIDENCE["deepl"])).otherwise(F.lit(K.FIXED_CONFIDENCE["libretranslate"]))
    ok = F.col("error").isNull()
    return d.withColumn("error", err).select(
        "key_hash", "provider",
        F.when(ok, F.when(llm, tr_llm).otherwise(F.col("_content"))).alias("translation"),
        F.when(ok, F.when(llm, src_llm).otherwise(src_fixed)).alias("source_language"),
        F.col("target_lang").alias("target_language"),
        F.when(p.isin("deepl", "libretranslate"), p).otherwise(F.col("model")).alias("model"),
        F.when(ok, F.when(llm, conf_llm).otherwise(fixed_conf)).alias("confidence"),
        F.when(ok, alts).alias("alternatives"),
        F.when(ok, F.coalesce(tokens_in, F.lit(0))).alias("input_tokens"),
        F.when(ok, F.coalesce(tokens_out, F.lit(0))).alias("output_tokens"),
        "error")


def ingest_detections(landed: DataFrame) -> DataFrame:
    """(key_hash, provider, language, confidence, error) of landed language detections.

    LLM providers answer {"language": ..., "confidence": ...} as their content, libretranslate a list of such
    objects, best first; deepl's language is the one it detected while translating, with a fixed confidence."""
    p, status, v, r = F.col("provider"), F.col("status"), F.col("_v"), F.col("_r")
    d = landed.withColumn("_v", F.try_parse_json(F.col("body")))
    llm = ~p.isin("deepl", "libretranslate")
    d = d.withColumn("_content", F.when(llm, _content(p, v)))
    first = F.when(p == "libretranslate", F.try_variant_get(v, "$[0]", "variant"))
    d = d.withColumn("_r", F.when(llm, F.try_parse_json(F.col("_content"))).otherwise(first))
    bad = _mistyped(r, "$.language", "^STRING$") | _mistyped(r, "$.confidence", NUMBER) | ~F.schema_of_variant(r).startswith("OBJECT")
    failed = F.concat(p, F.lit(" detect failed: "))
    deepl = _text(v, "$.translations[0].detected_source_language")
    err = (F.when(status == 429, F.concat(F.lit(K.ERR_RATE_LIMITED + ": "), p, F.lit(" rate limited")))
           .when(status >= 400, F.concat(failed, F.lit("HTTP "), status.cast("string")))
           .when(v.isNull(), F.concat(failed, F.lit("invalid json")))
           .when(p == "deepl", F.when(F.try_variant_get(v, "$.translations[0]", "variant").isNull(), F.lit("no translation returned")))
           .when((p == "libretranslate") & r.isNull(), F.lit("no detection result"))
           .when(llm & F.col("_content").isNull(), F.lit("no response"))
           .when(r.isNull(), F.concat(failed, F.lit("invalid json")))
           .when(F.coalesce(bad, F.lit(True)), F.concat(failed, F.lit("mistyped field"))))
    language = F.when(p == "deepl", F.lower(deepl)).otherwise(_text(r, "$.language"))
    confidence = F.when(p == "deepl", F.lit(K.DEEPL_DETECT_CONFIDENCE)).otherwise(F.coalesce(_number(r, "$.confidence", "double"), F.lit(0.0)))
    ok = F.col("error").isNull()
    return d.withColumn("error", err).select(
        "key_hash", "provider", F.when(ok, normalize_language(F.coalesce(language, F.lit("")))).alias("language"),
        F.when(ok, confidence).alias("confidence"), "error")


def split_responses(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())
