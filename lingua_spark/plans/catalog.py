"""Registered queries: one per operator of SURVEY §2, each (spark, sf_dir) -> DataFrame.

Every query reads the provided tables (or tables derived from them by Spark) in full.
Column names match the oracle SQL in plans/oracle.py; doubles are rounded to 6 digits.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.functions import keys as FK
from lingua_spark.functions import text as FT
from lingua_spark.session import written_once
from lingua_spark.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _docs(spark, sf):
    return T.read(spark, sf, "documents")


# ---------------------------------------------------------------- FN: scalar functions
@query("fn1_normalize_text")
def fn1(spark, sf):
    d = _docs(spark, sf).withColumn("n", FT.normalize_text("text"))
    return d.select("doc_id", FT.char_len("n").alias("norm_len"), F.sha2("n", 256).alias("norm_hash"))


@query("fn2_truncate_text")
def fn2(spark, sf):
    d = _docs(spark, sf).withColumn("t", FT.truncate_text("text", 100))
    return d.select("doc_id", FT.char_len("t").alias("trunc_len"), F.sha2("t", 256).alias("trunc_hash"))


@query("fn3_estimate_tokens")
def fn3(spark, sf):
    c = T.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", FT.estimate_tokens("text").alias("tokens"))


@query("fn4_split_paragraphs")
def fn4(spark, sf):
    # documents hold single newlines only: widen each into a blank line with stray spaces
    d = _docs(spark, sf).withColumn("p", FT.split_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n \n\n"))))
    return d.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"),
                    F.sha2(F.array_join("p", "|"), 256).alias("paragraphs_hash"))


@query("fn5_is_mostly_latin")
def fn5(spark, sf):
    return _docs(spark, sf).select("doc_id", FT.is_mostly_latin("text").alias("mostly_latin"))


@query("fn6_normalize_language")
def fn6(spark, sf):
    d = _docs(spark, sf)
    raw = F.concat(F.lit("  "), F.upper("lang"), F.when(F.col("doc_id") % 3 == 0, F.lit(""))
                   .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), F.upper("source")))
                   .otherwise(F.lit("-br ")))
    return d.select("doc_id", raw.alias("raw_code"), FT.normalize_language(raw).alias("code"))


@query("fn7_cache_key")
def fn7(spark, sf):
    from lingua_spark.plans.translate import keyed_requests
    keyed, _ = keyed_requests(T.requests_from_documents(spark, sf), T.glossary(spark, sf))
    return keyed.select("request_id", "key_hash")


@query("fn8_mask_for_log")
def fn8(spark, sf):
    c = T.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", FT.mask_for_log(FT.normalize_text("text")).alias("masked"),
                    FT.mask_for_log(F.col("role")).alias("masked_role"))


def _durations(spark, sf):
    e = T.read(spark, sf, "events")
    whole = F.floor("value").cast("long").cast("string")
    cents = F.lpad((F.round(F.col("value") * 100).cast("long") % 100).cast("string"), 2, "0")
    d = (F.when(F.col("event_type") == "click", F.concat(F.col("user_id").cast("string"), F.lit("h"), whole, F.lit("m")))
         .when(F.col("event_type") == "view", F.concat(whole, F.lit("."), cents, F.lit("s")))
         .when(F.col("event_type") == "purchase", F.concat(F.lit("-"), whole, F.lit("ms"), cents, F.lit("us")))
         .when(F.col("event_type") == "signup", F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(F.lit("0")))
         .otherwise(F.concat(whole, F.lit("x"))))
    return e.select("event_id", d.alias("duration"))


@query("fn9_ttl_seconds")
def fn9(spark, sf):
    d = _durations(spark, sf)
    return d.select("event_id", "duration", F.round(FK.ttl_seconds("duration", 60.0), 6).alias("ttl_s"))


@query("fn10_first_nonempty")
def fn10(spark, sf):
    d = _docs(spark, sf)
    a = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    b = F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("source"))
    return d.select("doc_id", FT.first_nonempty(a, b, F.lit("none")).alias("pick"),
                    FT.first_nonempty(F.lit(""), F.lit(None).cast("string")).alias("empty_pick"))


@query("fn11_validate_requests")
def fn11(spark, sf):
    from lingua_spark.operators.validate import validate_requests
    v = validate_requests(T.requests_from_documents(spark, sf))
    return v.select("request_id", FT.char_len("text").alias("norm_len"), "error")


# ---------------------------------------------------------------- BT-5 flagship
def flagship(spark, sf):
    """BT-5 over every document: key, dedup, cache (derived from labels), glossary, mock engine."""
    from lingua_spark.operators.engines import has_engine, mock_engine, register_engine
    from lingua_spark.plans.translate import translate
    if not has_engine("mock"):
        register_engine("mock", mock_engine(), kind="native")
    reqs = T.requests_from_documents(spark, sf)
    gl = T.glossary(spark, sf)
    cache = T.cache_from_labels(spark, sf, gl)
    res = translate(reqs, engine="mock", glossary=gl, cache=cache, as_of=F.expr(T.AS_OF))
    a = res.results
    return a.select("request_id", "key_hash", F.sha2("translation", 256).alias("translation_hash"),
                    "source_language", "target_language", "provider", "model", "cached",
                    F.round("confidence", 6).alias("confidence"),
                    FT.estimate_tokens("translation").alias("est_output_tokens"), "error")


QUERIES["bt5_translate"] = flagship


# ---------------------------------------------------------------- glossary
def _valid_requests(spark, sf):
    from lingua_spark.operators.validate import split_valid, validate_requests
    ok, _ = split_valid(validate_requests(T.requests_from_documents(spark, sf)))
    return ok.withColumn("target_lang", FT.normalize_language("target_lang"))


@query("jn1_glossary_for")
def jn1(spark, sf):
    from lingua_spark.operators.glossary import ranked_entries
    targets = T.requests_from_documents(spark, sf).select(FT.normalize_language("target_lang").alias("target_lang"))
    r = ranked_entries(targets, T.glossary(spark, sf))
    return r.select("target_lang", F.col("rank").cast("long").alias("rank"), "placeholder", "term", "translation")


@query("jn2_glossary_mask")
def jn2(spark, sf):
    from lingua_spark.operators.glossary import glossary_for, glossary_mask, restore_terms
    g = glossary_for(written_once(_valid_requests(spark, sf)), T.glossary(spark, sf), row_id="request_id")
    g = glossary_mask(g, "text", "gloss", "masked")
    return g.select("request_id", F.sha2("masked", 256).alias("masked_hash"),
                    F.regexp_count("masked", F.lit("__TERM_[0-9]+__")).cast("long").alias("n_placeholders"),
                    F.sha2(restore_terms(F.col("masked"), F.col("gloss")), 256).alias("restored_hash"))


@query("se1_glossary_get")
def se1(spark, sf):
    from lingua_spark.operators.glossary import glossary_get
    g = T.glossary(spark, sf)
    outs = [glossary_get(g, t).select(F.lit(t).alias("query_target"), "entry_no", "source_term", "translation")
            for t in ("es", "fr", "")]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("ag7_glossary_version_at")
def ag7(spark, sf):
    from lingua_spark.operators.glossary import glossary_version_at
    r = glossary_version_at(T.timed_requests(spark, sf), T.timed_glossary(spark, sf), "ts", "glossary_version")
    return r.select("request_id", "glossary_version")


def _prompt_requests(spark, sf):
    r = _valid_requests(spark, sf)
    return (r.withColumn("context", F.when(F.col("request_id") % 4 == 0, F.lit("medical")).otherwise(F.lit("")))
            .withColumn("tone", F.when(F.col("request_id") % 5 == 0, F.lit("formal")).otherwise(F.lit("neutral")))
            .withColumn("alternatives", (F.col("request_id") % 2).cast("int")))


@query("fn12_prepare_prompts")
def fn12(spark, sf):
    from lingua_spark.operators.validate import prepare_prompts
    p = prepare_prompts(_prompt_requests(spark, sf), T.glossary(spark, sf), row_id="request_id")
    return p.select("request_id", F.sha2("prompt", 256).alias("prompt_hash"), "max_tokens",
                    "n_entries")


PROVIDER_CYCLE = ["openai", "anthropic", "deepl", "google", "ollama", "libretranslate", "custom", "openrouter",
                  "nosuch"]


@query("fn13_resolve_model")
def fn13(spark, sf):
    from lingua_spark.operators.chain import providers_table, resolve_model
    d = _docs(spark, sf).select(
        F.col("doc_id").alias("request_id"),
        F.element_at(F.lit(PROVIDER_CYCLE), (F.col("doc_id") % 9 + 1).cast("int")).alias("provider_name"),
        F.when(F.col("lang") == "de", F.lit("my-model")).otherwise(F.lit("")).alias("model"))
    return resolve_model(d, providers_table(spark)).select("request_id", "provider_name", "model")


# ---------------------------------------------------------------- sources
@query("src1_load_requests")
def src1(spark, sf):
    from lingua_spark.sources.requests import apply_request_defaults
    d = _docs(spark, sf).select(
        F.col("doc_id").alias("request_id"), F.col("text"),
        F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("lang")).alias("source_lang"),
        F.lit("es").alias("target_lang"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("formal")).alias("tone"))
    r = apply_request_defaults(d)
    return r.select("request_id", "source_lang", "target_lang", "tone", "use_cache",
                    F.col("alternatives").cast("long").alias("alternatives"), "provider", "model", "context")


@query("src2_load_glossary")
def src2(spark, sf):
    from lingua_spark.operators.glossary import load_glossary
    # added latest entry_no first, so the numbering differs from entry_no and from the alphabet
    raw = T.glossary_raw(spark, sf).withColumn("added_at", F.expr(T.EPOCH_DAY) - F.make_dt_interval(mins=F.col("entry_no").cast("int")))
    ok, bad = load_glossary(raw.drop("entry_no"))
    return (ok.select("entry_no", "source_term", "target_lang", "translation", F.lit(None).cast("string").alias("error"))
            .unionByName(bad.select(F.lit(None).cast("long").alias("entry_no"), "source_term", "target_lang",
                                    "translation", "error")))


DOC_FORMATS = ["markdown", "plain", "html", "xml", "json", "rst"]


@query("src4_load_documents")
def src4(spark, sf):
    from lingua_spark.sources.requests import documents_with_status
    d = _docs(spark, sf).select(
        "doc_id", F.when(F.col("n_chars") < 100, F.lit("")).otherwise(F.col("text")).alias("content"),
        F.element_at(F.lit(DOC_FORMATS), (F.col("doc_id") % 6 + 1).cast("int")).alias("format"),
        F.lit("es").alias("target_lang"), F.lit(None).cast("string").alias("source_lang"))
    return documents_with_status(d).select("doc_id", "format", "source_lang", "error")


def _keyed(spark, sf):
    from lingua_spark.plans.translate import keyed_requests
    k, _ = keyed_requests(T.requests_from_documents(spark, sf), T.glossary(spark, sf))
    return k


@query("src5_cache_upsert")
def src5(spark, sf):
    from lingua_spark.operators.cache import cache_upsert
    gl = T.glossary(spark, sf)
    cache = T.cache_from_labels(spark, sf, gl).drop("request_id")
    k = _keyed(spark, sf).filter(F.col("source_lang") != "en")
    new = k.select(
        "key_hash",
        F.struct(F.concat(F.lit("new:"), F.col("request_id").cast("string")).alias("translation"),
                 F.col("source_lang").alias("source_language"), F.col("target_lang").alias("target_language"),
                 F.col("provider_name").alias("provider"), "model", F.lit(False).alias("cached"),
                 F.lit(0.9).alias("confidence"), F.lit(None).cast("array<string>").alias("alternatives"),
                 F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
        .alias("response"),
        (F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'") + F.make_dt_interval(secs=F.col("request_id").cast("int")))
        .alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.lit(1).alias("tier"))
    u = cache_upsert(cache, new)
    return u.select("key_hash", F.col("response.translation").alias("translation"),
                    F.when(F.col("expires_at").isNull(), "new").otherwise("old").alias("generation"))


@query("src6_write_responses")
def src6(spark, sf):
    from lingua_spark.operators.cache import response_to_json
    c = T.cache_from_labels(spark, sf, T.glossary(spark, sf))
    resp = c.select("key_hash", F.col("response").withField("alternatives", F.array(F.col("response.target_language")))
                    .alias("r"))
    return resp.select("key_hash", response_to_json(F.col("r")).alias("json"))


# ---------------------------------------------------------------- cache joins
@query("jn3_cache_lookup")
def jn3(spark, sf):
    from lingua_spark.operators.cache import cache_lookup
    from lingua_spark.operators.cache import write_bucketed
    from lingua_spark.streaming.streams import scratch
    cache = T.cache_from_labels(spark, sf, T.glossary(spark, sf)).drop("request_id")
    stored = write_bucketed(cache, scratch(spark, "cache"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits, misses = cache_lookup(_keyed(spark, sf), stored, F.expr(T.AS_OF))
    return (hits.select("request_id", F.lit(True).alias("hit"), F.col("cached_response.translation").alias("translation"))
            .unionByName(misses.select("request_id", F.lit(False).alias("hit"),
                                       F.lit(None).cast("string").alias("translation"))))


def _tiers(spark, sf):
    """The derived cache as tiers 1-2 plus a durable tier-3 copy that never expires (one pass)."""
    c = T.cache_from_labels(spark, sf, T.glossary(spark, sf)).drop("request_id")
    both = c.withColumn("_t", F.explode(F.array(F.col("tier"), F.lit(3))))
    return (both.withColumn("expires_at", F.when(F.col("_t") == 3, F.lit(None).cast("timestamp_ntz"))
                            .otherwise(F.col("expires_at")))
            .withColumn("tier", F.col("_t").cast("int")).drop("_t"))


@query("jn4_tiered_lookup")
def jn4(spark, sf):
    from lingua_spark.operators.cache import tiered_lookup
    hits, backfill = tiered_lookup(_keyed(spark, sf), _tiers(spark, sf), F.expr(T.AS_OF))
    return (hits.select(F.lit("hit").alias("kind"), "request_id", "key_hash", F.col("hit_tier").cast("long").alias("tier"),
                        F.col("cached_response.translation").alias("answer"))
            .unionByName(backfill.select(F.lit("backfill").alias("kind"), F.lit(None).cast("long").alias("request_id"),
                                         "key_hash", F.col("tier").cast("long").alias("tier"),
                                         F.col("response.translation").alias("answer"))))


@query("jn7_language_names")
def jn7(spark, sf):
    from lingua_spark.operators.chain import language_names
    r = _docs(spark, sf).select(F.col("doc_id").alias("request_id"), FT.normalize_language("lang").alias("src"),
                                 F.concat(F.col("lang"), F.lit("-x")).alias("raw"))
    r = language_names(r, "src", "source_name")
    r = language_names(r, "raw", "raw_name")
    return r.select("request_id", "source_name", "raw_name")


@query("jn8_dedup_then_join")
def jn8(spark, sf):
    from lingua_spark.operators.cache import dedup_first
    d = dedup_first(_keyed(spark, sf))
    return d.select("request_id", "key_hash", (~F.col("is_first")).alias("cached"))


# ---------------------------------------------------------------- metrics (call log from events)
def _log(spark, sf):
    return T.call_log_from_events(spark, sf)


@query("ag1_request_counts")
def ag1(spark, sf):
    from lingua_spark.operators.metrics import request_counts
    return request_counts(_log(spark, sf))


@query("ag2_latency_histogram")
def ag2(spark, sf):
    from lingua_spark.operators.metrics import latency_histogram
    h = latency_histogram(_log(spark, sf))
    return h.withColumn("latency_sum", F.round("latency_sum", 6))


@query("ag3_cache_hits")
def ag3(spark, sf):
    from lingua_spark.operators.metrics import cache_hits
    return cache_hits(_log(spark, sf)).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query("ag4_provider_calls")
def ag4(spark, sf):
    from lingua_spark.operators.metrics import provider_calls
    return provider_calls(_log(spark, sf))


@query("ag5_token_totals")
def ag5(spark, sf):
    from lingua_spark.operators.metrics import token_totals
    return token_totals(_log(spark, sf))


@query("ag6_provider_status")
def ag6(spark, sf):
    from lingua_spark.operators.metrics import provider_status
    return provider_status(_log(spark, sf))


# ---------------------------------------------------------------- windows
@query("wn1_latest_by_key")
def wn1(spark, sf):
    from lingua_spark.operators.cache import latest_by_key
    l = latest_by_key(_log(spark, sf), "key_hash", ["ts", "call_id"])
    return l.select("key_hash", "call_id", "tool")


@query("wn2_cap_entries")
def wn2(spark, sf):
    from lingua_spark.operators.cache import cap_entries, latest_by_key
    l = latest_by_key(_log(spark, sf), "key_hash", ["ts", "call_id"])
    c = l.select("key_hash", "call_id", F.col("ts").alias("created_at"),
                 (F.col("ts") + F.when(F.col("ok"), F.expr("INTERVAL 24 HOURS")).otherwise(F.expr("INTERVAL 1 HOURS")))
                 .alias("expires_at"))
    return cap_entries(c, 25, F.expr("TIMESTAMP_NTZ'2024-01-29 00:00:00'")).select("key_hash", "call_id")


@query("wn3_ttl_dedup")
def wn3(spark, sf):
    from pyspark.sql.types import TimestampNTZType
    from lingua_spark.operators.cache import ttl_dedup
    l = _log(spark, sf).withColumn("ts_us", FK.epoch_micros("ts", TimestampNTZType()))
    return ttl_dedup(l, 86400.0, key="key_hash", ts_micros="ts_us", id_col="call_id").select("call_id", "action")


@query("wn4_failure_runs")
def wn4(spark, sf):
    from lingua_spark.operators.windows import failure_runs
    return failure_runs(_log(spark, sf), 3).select("call_id", "provider", "run_len", "tripped")


@query("wn5_over_rate")
def wn5(spark, sf):
    from pyspark.sql.types import TimestampNTZType
    from lingua_spark.operators.windows import over_rate
    l = _log(spark, sf).withColumn("t_us", FK.epoch_micros("ts", TimestampNTZType()))
    return over_rate(l, 1 / 3600, 2, 3600.0).select("call_id", "in_window", "over")


# ---------------------------------------------------------------- translation memory
ASCII_FOLD = "[^ -~]"


def _fold(c):
    return F.regexp_replace(c, ASCII_FOLD, "?")


def tm_queries(spark, sf):
    """Queries for the TM search: every conversation turn, and per benchmark passage one
    copy with a single substituted character, its first half and its first word."""
    c = T.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                                                  F.col("text"))
    b = T.read(spark, sf, "benchmark")
    half = (F.char_length("text") / 2).cast("int")
    edited = b.select((F.lit(1000000) + F.col("item_id")).alias("query_id"),
                      F.concat(F.substring("text", 1, half), F.lit("x"),
                               F.expr("substring(text, CAST(char_length(text) / 2 AS INT) + 2)")).alias("text"))
    head = b.select((F.lit(2000000) + F.col("item_id")).alias("query_id"), F.substring("text", 1, half).alias("text"))
    word = b.select((F.lit(3000000) + F.col("item_id")).alias("query_id"),
                    F.regexp_extract("text", r"^(\S*)", 1).alias("text"))
    return c.unionByName(edited).unionByName(head).unionByName(word).withColumn("text", _fold(F.col("text")))


def _tm_folded(spark, sf):
    return T.tm_from_benchmark(spark, sf).withColumn("source_text", _fold(F.col("source_text")))


@query("jn5_tm_search")
def jn5(spark, sf):
    from lingua_spark.operators.memory import tm_search
    r = tm_search(tm_queries(spark, sf), _tm_folded(spark, sf), 0.8, with_entries=False)
    return r.select("query_id", "id", F.round("score", 6).alias("score"))


@query("so1_rank_results")
def so1(spark, sf):
    from lingua_spark.operators.memory import tm_search
    from lingua_spark.operators.windows import rank_results
    r = tm_search(tm_queries(spark, sf), _tm_folded(spark, sf), 0.5, with_entries=True)
    return rank_results(r).select("query_id", "id", "result_rank", F.sha2("target_text", 256).alias("target_hash"))


@query("jn6_tm_exact")
def jn6(spark, sf):
    from lingua_spark.operators.memory import tm_exact
    b = T.read(spark, sf, "benchmark").select(
        (F.lit(1000000) + F.col("item_id")).alias("query_id"),
        F.concat(F.lit("  "), F.col("text"), F.lit("\t")).alias("text"),
        F.when(F.col("item_id") % 3 == 0, "").otherwise("en").alias("source_lang"),
        F.when(F.col("item_id") % 4 == 0, "").when(F.col("item_id") % 4 == 1, "de").otherwise("es").alias("target_lang"))
    c = T.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text",
                                                  F.lit("en").alias("source_lang"), F.lit("es").alias("target_lang"))
    q = b.unionByName(c)
    r = tm_exact(q, T.tm_from_benchmark(spark, sf))
    return r.select("query_id", "tm_id", F.sha2("target_text", 256).alias("target_hash"))


@query("src3_append_tm")
def src3(spark, sf):
    from lingua_spark.operators.memory import append_tm
    tm = T.tm_from_benchmark(spark, sf)
    c = T.read(spark, sf, "conversations")
    new = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("source_text"),
                   F.when(F.col("role") == "user", F.concat(F.lit("translated:"), F.col("text"))).otherwise(F.lit(""))
                   .alias("target_text"), F.lit("en").alias("source_lang"), F.lit("es").alias("target_lang"))
    tm2, rejected = append_tm(tm, new, created_at=F.expr(T.EPOCH_DAY))
    return (tm2.select("id", F.sha2("source_text", 256).alias("source_hash"), F.lit("ok").alias("status"))
            .unionByName(rejected.select(F.lit(None).cast("long").alias("id"),
                                         F.sha2("source_text", 256).alias("source_hash"),
                                         F.lit("rejected").alias("status"))))


# ---------------------------------------------------------------- documents
FENCE_TAIL = "\n```\ncode\n```\ntail"


def _md_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat(F.col("text"), F.lit(FENCE_TAIL)).alias("content"),
                                   F.lit("markdown").alias("format"))


#: A page falls into very many pieces: a task takes this much of the files.
PAGE_TASK_BYTES = 4 << 20


def _html_docs(spark, sf):
    return T.read(spark, sf, "pages", PAGE_TASK_BYTES).select((F.lit(1000000) + F.col("page_id")).alias("doc_id"),
                                             F.col("html").alias("content"), F.lit("html").alias("format"))


def _json_docs(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.to_json(F.struct("lang", F.struct("text").alias("body"))).alias("content"),
        F.lit("json").alias("format"))


def segment_translator(target: str = "es"):
    """translate_fn for documents: BT-5 with the mock engine over the segments, whose equal
    texts share one answer; the other columns of the segments come back beside it."""
    from lingua_spark.operators.engines import has_engine, mock_engine, register_engine
    from lingua_spark.plans.translate import translate
    if not has_engine("mock"):
        register_engine("mock", mock_engine(), kind="native")

    def fn(segs):
        carry = [c for c in segs.columns if c != "segment"]
        reqs = segs.select(*carry, F.lit(0).cast("long").alias("request_id"), F.lit(None).cast("timestamp").alias("ts"),
                           F.col("segment").alias("text"), F.lit("auto").alias("source_lang"),
                           F.lit(target).alias("target_lang"), F.lit("").alias("provider"), F.lit("").alias("model"),
                           F.lit("").alias("context"), F.lit("neutral").alias("tone"), F.lit(True).alias("use_cache"),
                           F.lit(0).alias("alternatives"))
        res = translate(reqs, engine="mock", carry=carry)
        ok = res.answers.select(*carry, "translation", "error")
        bad = res.rejected.select(*carry, F.lit(None).cast("string").alias("translation"), "error")
        return ok.unionByName(bad)
    fn.keeps_rows = True
    return fn


@query("dc1_segment_markdown")
def dc1(spark, sf):
    from lingua_spark.operators.documents import segment_markdown
    s = segment_markdown(_md_docs(spark, sf))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.sha2("segment", 256).alias("seg_hash"))


@query("dc2_segment_tagged")
def dc2(spark, sf):
    from lingua_spark.operators.documents import segment_tagged
    s = segment_tagged(_html_docs(spark, sf))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.sha2("segment", 256).alias("seg_hash"))


@query("dc3_segment_json")
def dc3(spark, sf):
    from lingua_spark.operators.documents import segment_json
    s = segment_json(_json_docs(spark, sf))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.sha2("segment", 256).alias("seg_hash"))


@query("dc4_reassemble")
def dc4(spark, sf):
    from lingua_spark.operators.documents import reassemble, segment_tagged
    s = segment_tagged(_html_docs(spark, sf)).withColumn("out", F.col("segment"))
    return reassemble(s, "doc_id", "").select("doc_id", F.sha2("output", 256).alias("output_hash"))


@query("dc5_translate_documents")
def dc5(spark, sf):
    from lingua_spark.operators.documents import translate_documents
    docs = _md_docs(spark, sf).unionByName(_html_docs(spark, sf))
    r = translate_documents(docs, segment_translator("es"))
    return r.select("doc_id", F.sha2("output", 256).alias("output_hash"), "error")


@query("dc5_translate_mixed")
def dc5_mixed(spark, sf):
    """DC-5 over all formats together, JSON included, and over documents that are refused."""
    from lingua_spark.operators.documents import translate_documents
    js = _json_docs(spark, sf).withColumn("doc_id", F.col("doc_id") + 2000000)
    i = F.col("item_id") % 4
    odd = T.read(spark, sf, "benchmark").select(
        (F.col("item_id") + 3000000).alias("doc_id"), F.when(i == 1, F.lit(None)).when(i == 3, F.lit("")).otherwise(F.col("text")).alias("content"),
        F.when(i == 0, F.lit(None)).when(i == 2, F.lit("pdf")).otherwise(F.lit("plain")).alias("format"))
    docs = _md_docs(spark, sf).unionByName(_html_docs(spark, sf)).unionByName(js).unionByName(odd)
    r = translate_documents(docs, segment_translator("es"))
    read = F.concat_ws("|", F.get_json_object("output", "$.lang"), F.get_json_object("output", "$.body.text"))
    value = F.when(F.col("doc_id").between(2000000, 2999999), F.when(F.col("output").isNotNull(), read)).otherwise(F.col("output"))
    return r.select("doc_id", F.sha2(value, 256).alias("output_hash"), "error")


# ---------------------------------------------------------------- detection
@query("ld1_train_language_profiles")
def ld1(spark, sf):
    from lingua_spark.operators.detect import train_language_profiles
    return train_language_profiles(_docs(spark, sf)).select("lang", "gram", "cnt", "rank")


@query("ld2_detect_language")
def ld2(spark, sf):
    from lingua_spark.operators.detect import detect_language, train_language_profiles
    prof = train_language_profiles(_docs(spark, sf))
    c = T.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    d = detect_language(c, prof)
    return d.select("row_id", "language", F.round("confidence", 6).alias("confidence"))


@query("ld2_detect_documents")
def ld2_documents(spark, sf):
    from lingua_spark.operators.detect import detect_language, train_language_profiles
    d = detect_language(_docs(spark, sf).select(F.col("doc_id").alias("row_id"), "text"), train_language_profiles(_docs(spark, sf)))
    return d.select("row_id", "language", F.round("confidence", 6).alias("confidence"))


def _heuristic_detector(pdf):
    """UD-3 example detector (pandas batch): marks of German, Spanish, French, else English."""
    import pandas as pd
    t = pdf["text"].fillna("")
    lang = pd.Series("en", index=pdf.index)
    lang = lang.mask(t.str.contains("[éèêàç]", regex=True), "fr")
    lang = lang.mask(t.str.contains("[ñ¿¡]", regex=True), "es")
    lang = lang.mask(t.str.contains("[äöüß]", regex=True), "de")
    return pd.DataFrame({"row_key": pdf["row_key"], "language": lang, "confidence": 0.97})


@query("ud3_register_detector")
def ud3(spark, sf):
    from lingua_spark.operators.engines import register_detector, run_detector
    register_detector("marks", _heuristic_detector)
    d = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("row_key"), "text")
    r = run_detector(d, "marks")
    return r.select(F.col("row_key").cast("long").alias("doc_id"), "language",
                    F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- engines
def _work(spark, sf):
    k = _keyed(spark, sf)
    return k.select("key_hash", "text", "source_lang", "target_lang", F.col("provider_name").alias("provider"),
                    "model", "context", "tone", "alternatives").dropDuplicates(["key_hash"])


def _py_engine(pdf):
    """UD-1 example engine (pandas batch): prefixes the text."""
    import pandas as pd
    return pd.DataFrame({"key_hash": pdf["key_hash"], "translation": "py:" + pdf["text"],
                         "source_language": pdf["source_lang"], "confidence": 0.8, "input_tokens": 0,
                         "output_tokens": 0, "error": None})


@query("ud1_run_engine")
def ud1(spark, sf):
    from lingua_spark.operators.engines import register_engine, run_engine
    register_engine("py_prefix", _py_engine, kind="pandas")
    r = run_engine(_work(spark, sf), "py_prefix")
    return r.select("key_hash", F.sha2("translation", 256).alias("translation_hash"),
                    F.round("confidence", 6).alias("confidence"), "error")


@query("ud2_mock_engine")
def ud2(spark, sf):
    from lingua_spark.operators.engines import mock_engine
    b = T.read(spark, sf, "benchmark")
    dictionary = b.select(F.col("text").alias("source_text"),
                          F.concat(F.lit("dict:"), F.col("item_id").cast("string")).alias("translation"))
    c = T.read(spark, sf, "conversations").select("text")
    work = (b.select("text").unionByName(c).distinct()
            .select(F.sha2("text", 256).alias("key_hash"), "text", F.lit("en").alias("source_lang"),
                    F.lit("es").alias("target_lang")))
    r = mock_engine(dictionary)(work)
    return r.select("key_hash", F.sha2("translation", 256).alias("translation_hash"),
                    F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- batch and chain
@query("bt1_batch_one_to_many")
def bt1(spark, sf):
    from lingua_spark.operators.chain import batch_one_to_many
    d = _docs(spark, sf).select(
        "doc_id", "text",
        F.when(F.col("n_chars") > 19000, F.array_repeat(F.lit("es"), 51))
        .when(F.col("lang") == "fr", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("es"), F.lit("fr"), F.lit("de"))).alias("targets"))
    b = batch_one_to_many(d)
    return b.select("doc_id", F.col("item_pos").cast("long").alias("item_pos"), "target_lang", "error")


@query("bt2_batch_many_to_one")
def bt2(spark, sf):
    from lingua_spark.operators.chain import batch_many_to_one
    c = T.read(spark, sf, "conversations")
    items = c.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "text", "role"))),
        lambda x: F.struct(x["text"].alias("text"),
                           F.when(x["role"] == "assistant", F.lit("fr")).otherwise(F.lit("")).alias("target_lang")))
        .alias("items")).withColumn("target_lang", F.lit("es"))
    b = batch_many_to_one(items)
    return b.select("conv_id", F.col("item_pos").cast("long").alias("item_pos"),
                    F.sha2("text", 256).alias("text_hash"), "target_lang", "error")


FALLBACK = ["deepl", "openai", "nosuch", "google"]


def _chain(spark, sf):
    from lingua_spark.operators.chain import resolve_chain
    lab = T.read(spark, sf, "labels")
    req = lab.select("doc_id", "quality", "toxic",
                     F.element_at(F.lit(PROVIDER_CYCLE), (F.col("doc_id") % 9 + 1).cast("int")).alias("provider"))
    return resolve_chain(req, [p for p, _, _ in K.PROVIDERS], FALLBACK)


@query("bt3_resolve_chain")
def bt3(spark, sf):
    return _chain(spark, sf).select("doc_id", F.col("rank").cast("long").alias("rank"),
                                    F.col("chain_provider").alias("provider"))


@query("bt4_first_success")
def bt4(spark, sf):
    from lingua_spark.operators.chain import first_success
    ch = _chain(spark, sf)
    p = F.col("chain_provider")
    fails = (((p == "openai") & (F.col("quality") == 0)) | ((p == "deepl") & (F.col("toxic") == 1))
             | ((p == "google") & (F.col("doc_id") % 2 == 0)) | (p == "anthropic"))
    outcomes = ch.select("doc_id", "chain_provider", (~fails).alias("ok"),
                         F.when(~fails, F.concat(p, F.lit(":"), F.col("doc_id").cast("string"))).alias("translation"),
                         F.when(fails, F.concat(p, F.lit(" failed"))).alias("error"))
    r = first_success(ch, outcomes, key="doc_id")
    return r.select("doc_id", "provider", "translation", "error")


# ---------------------------------------------------------------- streaming
def _log_stream_cols(s):
    """call_log columns over an events stream (same derivation as sources.tables)."""
    from pyspark.sql.types import TimestampNTZType
    return s.select(
        F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("tool"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        F.sha2(F.concat_ws("\u0000", F.col("user_id").cast("string"), F.col("event_type")), 256).alias("key_hash"),
        (F.col("event_type") != "error").alias("ok"),
        FK.epoch_micros("ts", TimestampNTZType()).alias("t_us"))


def arrivals(spark, df, part, run, parts=3):
    """`df` arrives in `parts` portions, each written with as many files as it has tasks: after every arrival
    `run(stream, base, last)` starts the stream again on its own folder. Returns what the last run returned."""
    import os
    from lingua_spark.streaming.streams import scratch
    source, base = scratch(spark, "input"), scratch(spark, "stream")
    df = df.withColumn("_part", F.least(F.greatest(part.cast("int"), F.lit(0)), F.lit(parts - 1)))
    out = None
    for k in range(parts):
        df.filter(F.col("_part") == k).drop("_part").write.parquet(os.path.join(source, f"part={k}"))
        stream = spark.readStream.schema(df.drop("_part").schema).parquet(os.path.join(source, "part=*"))
        out = run(stream, base, k == parts - 1)
    return out


def log_arrivals(spark, sf, run):
    """The call log in three portions that overlap by up to a day on either side."""
    log = _log_stream_cols(T.read(spark, sf, "events"))
    lo, hi = log.agg(F.min("t_us"), F.max("t_us")).first()
    lo, hi = lo or 0, hi or 0
    jitter = F.col("call_id") * 7919 % 86400 * 1_000_000
    return arrivals(spark, log, (F.col("t_us") + jitter - lo) / F.lit((hi - lo) / 3 + 1), run)


def doc_arrivals(spark, sf, run):
    docs = T.read(spark, sf, "documents")
    last = docs.agg(F.max("doc_id")).first()[0]
    return arrivals(spark, docs, F.col("doc_id") * 3 / F.lit((last or 0) + 1), run)


@query("st1_stream_translate")
def st1(spark, sf):
    from lingua_spark.operators.engines import has_engine, mock_engine, register_engine
    from lingua_spark.streaming.streams import stream_translate
    if not has_engine("mock"):
        register_engine("mock", mock_engine(), kind="native")
    gl = T.glossary(spark, sf)
    cache = T.cache_from_labels(spark, sf, gl)

    def to_requests(d):
        return d.select(
            F.col("doc_id").alias("request_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("source_lang"),
            F.when(F.col("lang") == "es", "fr").otherwise("es").alias("target_lang"),
            F.lit("").alias("provider"), F.lit("").alias("model"), F.lit("").alias("context"),
            F.lit("neutral").alias("tone"), F.lit(True).alias("use_cache"), F.lit(0).alias("alternatives"))
    a = doc_arrivals(spark, sf, lambda stream, base, last: stream_translate(
        stream, to_requests, dict(engine="mock", glossary=gl, cache=cache, as_of=F.expr(T.AS_OF)), base=base))
    return a.select("request_id", "key_hash", F.sha2("translation", 256).alias("translation_hash"),
                    "source_language", "target_language", "provider", "model", "cached",
                    F.round("confidence", 6).alias("confidence"),
                    FT.estimate_tokens("translation").alias("est_output_tokens"), "error")


@query("st2_stream_cache_upsert")
def st2(spark, sf):
    from lingua_spark.plans.translate import keyed_requests
    from lingua_spark.streaming.streams import stream_cache_upsert
    gl = T.glossary(spark, sf)
    cache = T.cache_from_labels(spark, sf, gl).drop("request_id")

    def to_rows(d):
        reqs = d.select(
            F.col("doc_id").alias("request_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("source_lang"),
            F.when(F.col("lang") == "es", "fr").otherwise("es").alias("target_lang"),
            F.lit("").alias("provider"), F.lit("").alias("model"), F.lit("").alias("context"),
            F.lit("neutral").alias("tone"), F.lit(True).alias("use_cache"), F.lit(0).alias("alternatives"))
        k, _ = keyed_requests(reqs, gl)
        k = k.filter(F.col("source_lang") != "en")
        return k.select(
            "key_hash",
            F.struct(F.concat(F.lit("new:"), F.col("request_id").cast("string")).alias("translation"),
                     F.col("source_lang").alias("source_language"), F.col("target_lang").alias("target_language"),
                     F.col("provider_name").alias("provider"), "model", F.lit(False).alias("cached"),
                     F.lit(0.9).alias("confidence"), F.lit(None).cast("array<string>").alias("alternatives"),
                     F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
            .alias("response"),
            (F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'") + F.make_dt_interval(secs=F.col("request_id").cast("int")))
            .alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.lit(1).alias("tier"))
    u = doc_arrivals(spark, sf, lambda stream, base, last: stream_cache_upsert(stream, cache, to_rows, base=base))
    return u.select("key_hash", F.col("response.translation").alias("translation"),
                    F.when(F.col("expires_at").isNull(), "new").otherwise("old").alias("generation"))


def _st3(spark, sf, delay_seconds):
    from lingua_spark.streaming.streams import stream_dedup
    return log_arrivals(spark, sf, lambda stream, base, last: stream_dedup(
        stream, "key_hash", "t_us", "call_id", 86400.0, delay_seconds, base=base, close=last, late=True)).select("call_id", "action")


@query("st3_stream_dedup")
def st3(spark, sf):
    return _st3(spark, sf, 2 * 86400.0)


@query("st3_stream_dedup_late")
def st3_late(spark, sf):
    """ST-3 with a delay shorter than the portions' overlap: late rows are marked and change nothing."""
    return _st3(spark, sf, 6 * 3600.0)


@query("st4_stream_counts")
def st4(spark, sf):
    from lingua_spark.streaming.streams import stream_counts
    c = log_arrivals(spark, sf, lambda stream, base, last: stream_counts(
        stream.withColumn("ets", F.timestamp_micros("t_us")), "ets", "tool", "1 day", "3 days", base=base))
    return c.select(F.unix_micros(F.col("w.start")).alias("window_start_us"), "tool", "calls")


def _st5(spark, sf, delay_seconds):
    from lingua_spark.streaming.streams import stream_failure_runs
    return log_arrivals(spark, sf, lambda stream, base, last: stream_failure_runs(
        stream, 3, delay_seconds, base=base, close=last, late=True)).select("call_id", "provider", "run_len", "tripped")


@query("st5_stream_failure_runs")
def st5(spark, sf):
    return _st5(spark, sf, 2 * 86400.0)


@query("st5_stream_failure_runs_late")
def st5_late(spark, sf):
    """ST-5 with late rows: they come without a run and are no part of any."""
    return _st5(spark, sf, 6 * 3600.0)


# ---------------------------------------------------------------- landed provider bodies
INGEST_PROVIDERS = ["openai", "anthropic", "google", "ollama", "deepl", "libretranslate", "openrouter", "custom"]


def landed_from_conversations(spark, sf):
    """One landed body per conversation turn: provider by (conv_id + turn) % 8, HTTP 429 /
    500 by text length, model output as JSON, fenced JSON or plain text by turn % 3."""
    c = T.read(spark, sf, "conversations")
    p = F.element_at(F.lit(INGEST_PROVIDERS), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    obj = F.to_json(F.struct(F.col("text").alias("translation"), F.lit("en").alias("source_language"),
                             F.lit(0.93).alias("confidence")))
    out = (F.when(F.col("turn") % 3 == 0, obj)
           .when(F.col("turn") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```")))
           .otherwise(F.col("text")))
    usage = F.struct(F.lit(10).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"))
    body = (F.when(p.isin("openai", "openrouter", "custom"), F.to_json(F.struct(
        F.array(F.struct(F.struct(out.alias("content")).alias("message"))).alias("choices"), usage.alias("usage"))))
        .when(p == "anthropic", F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), out.alias("text")))
                                                   .alias("content"))))
        .when(p == "google", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(out.alias("text")))
                                                                          .alias("parts")).alias("content")))
                                                .alias("candidates"))))
        .when(p == "ollama", F.to_json(F.struct(F.struct(out.alias("content")).alias("message"))))
        .when(p == "deepl", F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"),
                                                                F.lit("EN").alias("detected_source_language")))
                                               .alias("translations"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("translatedText"),
                                      F.struct(F.lit("en").alias("language"), F.lit(90.0).alias("confidence"))
                                      .alias("detectedLanguage")))))
    ln = F.char_length("text")
    status = F.when(ln % 17 == 0, 429).when(ln % 13 == 0, 500).otherwise(200)
    return c.select(F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
                    .alias("key_hash"), p.alias("provider"), F.lit("m").alias("model"), status.alias("status"),
                    body.alias("body"), F.lit("auto").alias("source_lang"), F.lit("es").alias("target_lang"))


@query("src7_ingest_responses")
def src7(spark, sf):
    from lingua_spark.sources.ingest import ingest_responses
    r = ingest_responses(landed_from_conversations(spark, sf))
    return r.select("key_hash", "provider", F.sha2("translation", 256).alias("translation_hash"), "source_language",
                    F.round("confidence", 6).alias("confidence"), "input_tokens", "output_tokens",
                    F.regexp_extract("error", r"^([^:]*)", 1).alias("error_kind"))


@query("src7_ingest_detections")
def src7_detections(spark, sf):
    """Landed detection bodies: one per conversation turn; by turn and provider good ones, fenced, mistyped and empty ones."""
    from lingua_spark.sources.ingest import ingest_detections
    c = T.read(spark, sf, "conversations")
    p = F.element_at(F.lit(INGEST_PROVIDERS), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    k = F.char_length("text") % 5
    obj = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, F.lit(" PT-BR")).otherwise(F.lit("es")).alias("language"), F.lit(0.97).alias("confidence")))
    out = (F.when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k == 2, F.lit('{"language": "es", "confidence": "high"}'))
           .when(k == 3, F.lit(None)).otherwise(obj))
    body = (F.when(p.isin("openai", "openrouter", "custom"), F.to_json(F.struct(F.array(F.struct(F.struct(out.alias("content")).alias("message"))).alias("choices"))))
            .when(p == "anthropic", F.to_json(F.struct(F.array(F.struct(out.alias("text"))).alias("content"))))
            .when(p == "google", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(out.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
            .when(p == "ollama", F.to_json(F.struct(F.struct(out.alias("content")).alias("message"))))
            .when(p == "deepl", F.when(k == 3, F.lit('{"translations": []}')).otherwise(F.lit('{"translations": [{"detected_source_language": "FR", "text": "x"}]}')))
            .otherwise(F.when(k == 3, F.lit("[]")).when(k == 2, F.lit("[{")).otherwise(F.concat(F.lit("["), obj, F.lit("]")))))
    ln = F.char_length("text")
    landed = c.select(F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256).alias("key_hash"), p.alias("provider"),
                      F.when(ln % 17 == 0, 429).when(ln % 13 == 0, 500).otherwise(200).alias("status"), body.alias("body"))
    r = ingest_detections(landed)
    return r.select("key_hash", "provider", "language", F.round("confidence", 6).alias("confidence"), "error")


@query("jn5_tm_search_parts")
def jn5_parts(spark, sf):
    """JN-5 at volume: every part name searched against all part names (t = 0.8)."""
    from lingua_spark.operators.memory import tm_search
    p = T.read(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), _fold(F.col("p_name")).alias("text"))
    tm = p.select(F.col("p_partkey").alias("id"), _fold(F.col("p_name")).alias("source_text"))
    return tm_search(q, tm, 0.8, with_entries=False, digits=6).select("query_id", "id", "score")


@query("jn7_list_languages")
def jn7_list(spark, sf):
    from lingua_spark.operators.chain import list_languages
    lab = T.read(spark, sf, "labels").select(
        "doc_id", F.element_at(F.lit(PROVIDER_CYCLE), (F.col("doc_id") % 9 + 1).cast("int")).alias("provider"))
    r = list_languages(lab, ["openai", "deepl", "google", "custom"])
    return r.select("doc_id", "provider_name", "n_languages", "error")


@query("bt5_translate_detect")
def bt5_detect(spark, sf):
    """BT-5 with source 'auto' everywhere: translate detects once per distinct normalized text
    (profiles trained on the labelled documents) and the detected language keys the request."""
    from lingua_spark.operators.detect import train_language_profiles
    from lingua_spark.operators.engines import has_engine, mock_engine, register_engine
    from lingua_spark.plans.translate import translate
    if not has_engine("mock"):
        register_engine("mock", mock_engine(), kind="native")
    reqs = T.requests_from_documents(spark, sf).withColumn("source_lang", F.lit("auto"))
    a = translate(reqs, engine="mock", glossary=T.glossary(spark, sf),
                  profiles=train_language_profiles(_docs(spark, sf))).results
    return a.select("request_id", "key_hash", F.sha2("translation", 256).alias("translation_hash"),
                    "source_language", "target_language", "provider", "model", "cached",
                    F.round("confidence", 6).alias("confidence"),
                    FT.estimate_tokens("translation").alias("est_output_tokens"), "error")
