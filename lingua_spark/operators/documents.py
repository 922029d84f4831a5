"""Structured documents: DC-1 markdown, DC-2 html/xml, DC-3 JSON segmentation, DC-4
reassembly, DC-5 translate_documents.

Segment rows: (doc_id, pos, kind, segment). kind 'text' = to translate, 'keep' = verbatim
(fences, tags, empty or tag-like pieces, JSON structure and keys). pos orders the pieces.
Segments of all documents form one table: translation runs once per distinct text and
the answers come back by key before the per-document reassembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.constants import FENCE_RE, TAG_RE
from lingua_spark.functions.text import utrim
from lingua_spark.operators.skew import hot_keys, join_per_key
from lingua_spark.session import cut_lineage, written_once

# A JSON string literal (possessive, no backtracking), optionally followed by ':' (a key).
JSON_STRING_RE = r"(\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"(?:\s*:)?)"


MARKDOWN, TAGGED, JSON = ("markdown", "plain"), ("html", "xml"), ("json",)


def _split(content: Column, pattern: str) -> Column:
    """p0, s0, p1, s1, ... of a text split by `pattern`. The two lists meet in zip_with, outside of its lambda: a text
    is split and searched once, not once per piece."""
    parts, seps = F.split(content, pattern, -1), F.regexp_extract_all(content, F.lit(pattern), 1)
    return F.flatten(F.zip_with(parts, seps, lambda p, s: F.array(p, s)))


def segment_by_format(df: DataFrame, content: str, fmt: Column, *keep: str, refused: Column | None = None) -> DataFrame:
    """DC-1 to DC-3 in one pass over documents of several formats: rows (*keep, pos, kind, segment). A document with
    `refused`, and one of invalid JSON, has one row of kind 'error' with the message."""
    text, seg, is_sep = F.col(content), F.col("segment"), F.col("pos") % 2 == 1
    refused = refused if refused is not None else F.lit(None).cast("string")
    message = F.coalesce(refused, F.when(fmt.isin(*JSON) & F.try_parse_json(text).isNull(), F.lit(K.ERR_INVALID_JSON)))
    pieces = (F.when(F.col("_message").isNotNull(), F.array(F.col("_message"))).when(fmt.isin(*MARKDOWN), _split(text, FENCE_RE))
              .when(fmt.isin(*TAGGED), _split(text, TAG_RE)).when(fmt.isin(*JSON), _split(text, JSON_STRING_RE)))
    rows = (df.withColumn("_message", message)
            .select(*keep, fmt.alias("_fmt"), F.col("_message").isNotNull().alias("_error"), F.posexplode(pieces).alias("pos", "segment")))
    unquoted = F.from_json(F.concat(F.lit("["), seg, F.lit("]")), "array<string>")[0]
    value = F.when(F.col("_fmt").isin(*JSON) & ~F.col("_error") & is_sep & ~F.endswith(seg, F.lit(":")), F.nullif(unquoted, F.lit("")))
    kind = (F.when(F.col("_error"), F.lit("error"))
            .when(F.col("_fmt").isin(*MARKDOWN), F.when(is_sep, F.lit("keep")).when(seg != "", F.lit("text")))
            .when(F.col("_fmt").isin(*TAGGED), F.when(~is_sep & (seg != "") & ~F.startswith(seg, F.lit("<")), F.lit("text")).otherwise(F.lit("keep")))
            .otherwise(F.when(F.col("_value").isNotNull(), F.lit("text")).otherwise(F.lit("keep"))))
    return (rows.filter(seg.isNotNull()).withColumn("_value", value)
            .select(*keep, "pos", kind.alias("kind"), F.coalesce("_value", "segment").alias("segment")).filter(F.col("kind").isNotNull()))


def segment_markdown(df: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """DC-1: prose between code fences -> 'text' (empty prose pieces dropped), fences -> 'keep'."""
    return segment_by_format(df, content, F.lit("markdown"), id_col)


def segment_tagged(df: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """DC-2: text between tags -> 'text' unless empty or starting with '<'; tags -> 'keep'."""
    return segment_by_format(df, content, F.lit("html"), id_col)


def segment_json(df: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """DC-3: every JSON string value (not keys) -> 'text' (unescaped); everything else 'keep'.
    Invalid JSON -> one row with kind 'error'."""
    return segment_by_format(df, content, F.lit("json"), id_col)


def requote_json(c: Column) -> Column:
    """A string as a JSON string literal (to_json of a one-element array minus brackets)."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def reassemble(segments: DataFrame, id_col: str | list[str] = "doc_id", sep: str = "", text_col: str = "out",
               sep_col: str | None = None) -> DataFrame:
    """DC-4: concatenate pieces in pos order per document with `sep` ('\\n\\n' for markdown),
    or with the per-row separator in `sep_col`. A document with any failed piece (error not
    null) fails with the error of its first failed piece."""
    has_err = "error" in segments.columns
    ids = [id_col] if isinstance(id_col, str) else id_col
    seps = [F.first(sep_col).alias("_sep")] if sep_col else []
    agg = segments.groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(text_col).alias("t")))).alias("_ps"), *seps,
        *([F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error")] if has_err else []))
    texts = F.transform("_ps", lambda x: x["t"])
    joined = (F.when(F.col("_sep") == "\n\n", F.array_join(texts, "\n\n")).otherwise(F.array_join(texts, ""))
              if sep_col else F.array_join(texts, sep))
    out = agg.select(*ids, joined.alias("output"), *(["error"] if has_err else []))
    if has_err:
        out = out.withColumn("output", F.when(F.col("error").isNull(), F.col("output")))
    return out


def translate_segments(segments: DataFrame, translate_fn) -> DataFrame:
    """The pieces with `out` and `error`: text segments translated, all others as they are.

    translate_fn(DataFrame[segment]) -> DataFrame[segment, translation, error] runs once per distinct segment, and the
    answers are joined back; segments that very many documents share (menus, footers) are answered by a broadcast of
    their few answers. A function with a true attribute `keeps_rows` shares answers between equal texts by itself: it
    is given all text segments with their other columns and returns these columns but `segment`, translation
    and error; `segment` is then left out of the result, so that no text travels beside its translation."""
    # structure and whitespace-only pieces (they would normalize to '') pass through verbatim; the table feeds the
    # translation and the pieces that are kept: written once to the shared checkpoint folder rather than split twice
    segments = written_once(segments.withColumn("_work", F.coalesce((F.col("kind") == "text") & (utrim("segment") != ""), F.lit(False))), "zstd")
    texts = segments.filter("_work").drop("_work")
    kept = (segments.filter("not _work").drop("_work").withColumn("out", F.col("segment"))
            .withColumn("error", F.when(F.col("kind") == "error", F.col("segment"))))
    if getattr(translate_fn, "keeps_rows", False):
        return translate_fn(texts).withColumnRenamed("translation", "out").unionByName(kept.drop("segment"))
    hashed = texts.withColumn("_h", F.xxhash64("segment"))
    answers = translate_fn(texts.select("segment").distinct()).withColumnRenamed("segment", "_s").withColumn("_h", F.xxhash64("_s"))
    hot = hot_keys(hashed, "_h")
    if hot:
        answers = cut_lineage(answers)  # read by two joins, translated once
    done = join_per_key(hashed, answers, "_h", hot, "left").filter(F.col("_s").isNull() | (F.col("_s") == F.col("segment")))
    return done.select(*texts.columns, F.col("translation").alias("out"), "error").unionByName(kept)


def translate_documents(docs: DataFrame, translate_fn, id_col: str = "doc_id") -> DataFrame:
    """DC-5: dispatch by format, translate the segments of all documents in one job (see translate_segments),
    reassemble per document. docs: (doc_id, content, format, maybe target_lang); returns (doc_id, output, error), one row
    per row of docs, also where ids repeat or are null. A document without content, format or target language and one of
    an unsupported format fail with 'invalid input: ...'."""
    blank = F.coalesce("content", F.lit("")).eqNullSafe("") | F.coalesce("format", F.lit("")).eqNullSafe("")
    if "target_lang" in docs.columns:
        blank = blank | F.coalesce("target_lang", F.lit("")).eqNullSafe("")
    refused = (F.when(blank, F.lit(K.ERR_DOCUMENT_FIELDS))
               .when(~F.col("format").isin(*K.DOCUMENT_FORMATS), F.concat(F.lit(f"{K.ERR_INVALID_INPUT}: unsupported format "), F.col("format"))))
    # rows are numbered, as ids may repeat, and split in one pass; the numbers stay with the pieces, which are written once
    rows = (docs.select(id_col, "content", "format", refused.alias("_refused")).withColumn("_row", F.monotonically_increasing_id())
            .withColumn("_sep", F.when(F.col("format").isin(*MARKDOWN), F.lit("\n\n")).otherwise(F.lit("")))
            .withColumn("_json", F.coalesce(F.col("format").isin(*JSON), F.lit(False))))
    segs = segment_by_format(rows, "content", F.col("format"), id_col, "_row", "_sep", "_json", refused=F.col("_refused"))
    tr = translate_segments(segs, translate_fn)
    tr = tr.withColumn("out", F.when(F.col("_json") & (F.col("kind") == "text"), requote_json(F.col("out")))
                       .otherwise(F.col("out")))
    return reassemble(tr, ["_row", id_col], text_col="out", sep_col="_sep").select(id_col, "output", "error")
