"""FN-11 request validation and FN-12 prompt preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.functions.text import normalize_text
from lingua_spark.session import cut_lineage, written_once


def validate_requests(df: DataFrame, max_len: int = K.MAX_TEXT_LENGTH, text_col: str = "text") -> DataFrame:
    """FN-11: normalize the text in place and add `error` (null when the row is valid)."""
    t = normalize_text(text_col)
    out = df.withColumn(text_col, t)
    err = (F.when(F.col(text_col) == "", F.lit(K.ERR_EMPTY_TEXT))
           .when(F.char_length(F.col(text_col)) > max_len, F.lit(K.ERR_TOO_LONG)))
    return out.withColumn("error", err)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())


def output_budget(masked: Column) -> Column:
    """Output-token budget: max(512, 4 * code points + 256)."""
    return F.greatest(F.lit(512), F.char_length(masked) * 4 + 256).cast("long")


def build_prompt(language_name: Column, context: Column, tone: Column, listing: Column, alternatives: Column,
                 masked: Column) -> Column:
    """FN-12 prompt text; `listing`: the target's glossary placeholders in rank order, null without any."""
    ctx = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(K.PROMPT_CONTEXT), context, F.lit(". "))) \
        .otherwise(F.lit(""))
    tn = F.when(~F.coalesce(tone, F.lit("")).isin("", "neutral"), F.concat(F.lit(K.PROMPT_TONE), tone, F.lit(". "))) \
        .otherwise(F.lit(""))
    ph = F.when(listing.isNotNull(), F.concat(F.lit(K.PROMPT_PLACEHOLDERS), listing, F.lit(". "))).otherwise(F.lit(""))
    alt = F.when(F.coalesce(alternatives, F.lit(0)) > 0, F.lit(K.PROMPT_ALTERNATIVES)).otherwise(F.lit(""))
    return F.concat(F.lit(K.PROMPT_INTRO), language_name, F.lit(". "), ctx, tn, ph, F.lit(K.PROMPT_RETURN), alt,
                    F.lit(K.PROMPT_TEXT), masked)


def prepare_prompts(df: DataFrame, glossary: DataFrame | None = None, text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """FN-12: mask (when a glossary is given), build the prompt and the output budget.

    `n_entries`: entries listed in the prompt, all of the target. The listing is one text per
    target, joined by it; the masks need the entries that occur in the text only (see JN-1).
    Both come from one ranking of the glossary. `row_id`: see glossary_for."""
    from lingua_spark.operators.chain import language_names
    from lingua_spark.operators.glossary import GLOSS_TYPE, glossary_for, glossary_mask, ranked_entries
    if glossary is not None:
        df = written_once(df)
        ranked = cut_lineage(ranked_entries(df, glossary))
        d = glossary_for(df, glossary, row_id=row_id, text_col=text_col, ranked=ranked)
        pair = F.struct("rank", F.concat("placeholder", F.lit(" -> "), "translation").alias("t"))
        listing = (ranked.groupBy("target_lang").agg(F.array_sort(F.collect_list(pair)).alias("_l"))
                   .select("target_lang", F.array_join("_l.t", "; ").alias("_listing"), F.size("_l").cast("long").alias("n_entries")))
        d = d.join(listing, "target_lang", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0).cast("long")))
    else:
        d = (df.withColumn("_listing", F.lit(None).cast("string")).withColumn("n_entries", F.lit(0).cast("long"))
             .withColumn("gloss", F.array().cast(GLOSS_TYPE)))
    d = glossary_mask(d, text_col, "gloss", "masked")
    d = language_names(d, "target_lang", "_lname")
    alts = F.col("alternatives") if "alternatives" in d.columns else F.lit(0)
    ctx = F.col("context") if "context" in d.columns else F.lit("")
    tone = F.col("tone") if "tone" in d.columns else F.lit("neutral")
    return (d.withColumn("prompt", build_prompt(F.col("_lname"), ctx, tone, F.col("_listing"), alts, F.col("masked")))
            .withColumn("max_tokens", output_budget(F.col("masked"))).drop("_lname", "_listing"))
