"""BT-5: the end-to-end translate job as one lazy DataFrame plan.

requests -> FN-11 validate -> (LD-2 detect) -> FN-6 languages -> FN-10/FN-13 provider, model
-> AG-7 glossary version -> FN-7 key -> JN-8 first-per-key -> JN-3 cache -> (JN-6 TM exact)
-> JN-1/JN-2 mask -> engine along the BT-3 chain, BT-4 first success -> restore -> join back.

Only the first request of each key reaches the cache and the engine; the other requests
of that key share its answer (cached=true, unless it is an error). A request with
use_cache=false neither reads nor feeds the cache nor shares an answer: it is work of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.functions.keys import cache_key
from lingua_spark.functions.text import first_nonempty, normalize_language, utrim
from lingua_spark.operators import engines as E
from lingua_spark.operators.cache import live_responses
from lingua_spark.operators.chain import chain_array, providers_table, resolve_model
from lingua_spark.operators.glossary import GLOSS_TYPE, glossary_for, glossary_mask, glossary_version_at, restore_terms
from lingua_spark.operators.skew import hot_keys, join_per_key
from lingua_spark.operators.validate import split_valid, validate_requests
from lingua_spark.session import cut_lineage, written_once

ANSWER_COLUMNS = ["request_id", "key_hash", "translation", "source_language", "target_language", "provider",
                  "model", "cached", "confidence", "alternatives", "input_tokens", "output_tokens", "error"]


@dataclass
class TranslateResult:
    answers: DataFrame        # one row per valid request
    rejected: DataFrame       # invalid requests with `error`
    cache_updates: DataFrame  # new cache rows (key_hash, response, created_at, expires_at, tier)

    @property
    def results(self) -> DataFrame:
        """One row per request: the answers, and the refused requests with their error."""
        refused = self.rejected.withColumn("cached", F.lit(False))
        return self.answers.unionByName(refused, allowMissingColumns=True)


def keyed_requests(requests: DataFrame, glossary: DataFrame | None = None, providers: DataFrame | None = None,
                   default_provider: str = K.DEFAULT_PROVIDER, max_len: int = K.MAX_TEXT_LENGTH,
                   detected: DataFrame | None = None, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate, normalize languages, pick provider/model and derive key_hash.

    Blank and `auto` source languages are detected: with LD-2 over the LD-1 `profiles`, once per
    distinct normalized text, or taken from `detected`, (text, language) rows of another
    detector. Without either they stay `auto`. Returns (keyed valid requests, rejected).
    """
    spark = requests.sparkSession
    providers = providers if providers is not None else providers_table(spark)
    ok = split_valid(validate_requests(requests, max_len))[0]
    # normalizing only shortens a text: others than these are never refused, and are not normalized a second time
    odd = requests.filter((utrim("text") == "") | (F.char_length("text") > max_len))
    rejected = split_valid(validate_requests(odd, max_len))[1]
    src = F.lower(F.trim(F.col("source_lang")))
    det = None
    if detected is not None:
        det = detected.select(F.sha2("text", 256).alias("_dt"), F.col("language").alias("_dl")).dropDuplicates(["_dt"])
    elif profiles is not None:
        from lingua_spark.operators.detect import detect_language
        texts = ok.filter(src.isin("", "auto")).select(F.sha2("text", 256).alias("_dt"), "text").dropDuplicates(["_dt"])
        det = detect_language(texts, profiles, id_col="_dt").select("_dt", F.col("language").alias("_dl"))
    if det is not None:
        ok = ok.join(det, F.when(src.isin("", "auto"), F.sha2("text", 256)) == det["_dt"], "left")
        found = F.col("_dl").isNotNull() & ~F.col("_dl").isin("", "auto")
        ok = ok.withColumn("source_lang", F.when(src.isin("", "auto") & found, F.col("_dl"))
                           .otherwise(F.col("source_lang"))).drop("_dt", "_dl")
    ok = (ok.withColumn("source_lang", normalize_language("source_lang"))
          .withColumn("target_lang", normalize_language("target_lang"))
          .withColumn("provider_name", first_nonempty(F.col("provider"), F.lit(default_provider)))
          .withColumn("model_in", F.col("model")))
    ok = resolve_model(ok, providers, "provider_name", "model")
    if glossary is not None:
        ok = glossary_version_at(ok, glossary, "ts", "glossary_version")
    else:
        ok = ok.withColumn("glossary_version", F.lit(0).cast("long"))
    ok = ok.withColumn("key_hash", cache_key("text", "source_lang", "target_lang", "provider_name", "model",
                                             "context", "tone", "glossary_version"))
    return ok, rejected


def _answer_rows(res: DataFrame, error: "F.Column") -> DataFrame:
    """Per-key answer rows of an engine result (or of rows with no provider left)."""
    cols = set(res.columns)
    ok = error.isNull()

    def c(name, dtype):
        return F.col(name) if name in cols else F.lit(None).cast(dtype)
    translation = F.when(c("_masked", "boolean"), restore_terms(c("translation", "string"), F.col("gloss"))) \
        .otherwise(c("translation", "string"))
    src = c("source_language", "string")
    return res.select(
        "work_key", "key_hash", "first_id",
        F.when(ok, translation).alias("translation"),
        F.when(ok, F.when(F.coalesce(src, F.lit("")).isin("", "auto"), F.col("source_lang")).otherwise(src))
        .alias("source_language"),
        F.col("target_lang").alias("target_language"),
        F.when(ok, c("chain_provider", "string")).alias("provider"),
        F.when(ok, c("model", "string")).alias("model"),
        F.lit(False).alias("hit"),
        F.when(ok, c("confidence", "double")).alias("confidence"),
        F.when(ok, c("alternative_texts", "array<string>")).alias("alternatives"),
        F.when(ok, c("input_tokens", "long")).alias("input_tokens"),
        F.when(ok, c("output_tokens", "long")).alias("output_tokens"),
        error.alias("error"),
        (ok & F.col("use_cache")).alias("store"))


def _engine_for(provider_engines: dict[str, str] | None, default_engine: str):
    def pick(p):
        return (provider_engines or {}).get(p, default_engine)
    return pick


def translate(requests: DataFrame, *, engine: str = "mock", provider_engines: dict[str, str] | None = None,
              glossary: DataFrame | None = None, cache: DataFrame | list[DataFrame] | None = None, as_of=None,
              known: list[str] | None = None, fallback: list[str] | None = None,
              default_provider: str = K.DEFAULT_PROVIDER, providers: DataFrame | None = None,
              max_len: int = K.MAX_TEXT_LENGTH, ttl_seconds: float = K.DEFAULT_TTL_SECONDS, now=None,
              detected: DataFrame | None = None, profiles: DataFrame | None = None,
              tm: DataFrame | None = None, use_tm: bool = False,
              materialize: bool = True, carry: list[str] | None = None,
              cache_unique: bool = False, answers_once: bool = False) -> TranslateResult:
    """BT-5. `engine` names a registered engine (UD-1) used for every provider unless
    `provider_engines` maps a provider to another one. `known` = configured providers
    (default: the catalogue), `fallback` = fallback order (default: none). `as_of` = the time at
    which cache rows must be alive (default: now). `profiles` / `detected`: see keyed_requests.
    `cache_unique=True` declares the cache one row per key_hash (as cache_upsert keeps it),
    which skips the latest-row aggregation; stored with write_bucketed, the cache
    joins without being shuffled. `cache` may also be the runs of a cache log, newest first.
    `answers_once=True` writes the answer per key once, for callers that use answers and cache updates."""
    spark = requests.sparkSession
    providers = providers if providers is not None else providers_table(spark)
    known = known if known is not None else [r[0] for r in K.PROVIDERS]
    fallback = fallback or []
    keyed, rejected = keyed_requests(requests, glossary, providers, default_provider, max_len, detected, profiles)
    keyed = keyed.withColumn("use_cache", F.coalesce("use_cache", F.lit(True)))
    # a request that opted out of the cache shares nothing: it is keyed by its own id too
    keyed = keyed.withColumn("work_key", F.when(F.col("use_cache"), F.col("key_hash"))
                             .otherwise(F.concat_ws("#", "key_hash", F.col("request_id").cast("string"))))
    # The keyed requests, texts included, are evaluated and written once. The first request per key and the
    # cache lookup read and shuffle their narrow columns; only the texts of cache misses are joined.
    keyed = written_once(keyed, "zstd") if materialize else keyed
    carry = carry or []
    use_cache_table = cache is not None
    oldest = F.struct("ts", "request_id")
    if use_cache_table:
        first = F.min_by(F.struct("request_id", "key_hash", "use_cache"), oldest).alias("_f")
        looked = keyed.groupBy("work_key").agg(first).select("work_key", F.col("_f.request_id").alias("first_id"), "_f.key_hash", "_f.use_cache")
        as_of = F.current_timestamp() if as_of is None else as_of
        looked = live_responses(looked, cache, as_of, cache_unique)
        looked = cut_lineage(looked) if materialize else looked

    # exactly one work row per key, even when request ids repeat
    hit_answers = None
    if use_cache_table:
        is_hit = F.col("use_cache") & F.col("cached_response").isNotNull()
        hit_answers = looked.filter(is_hit).select(
            "work_key", "key_hash", "first_id", F.col("cached_response.translation").alias("translation"),
            F.col("cached_response.source_language").alias("source_language"),
            F.col("cached_response.target_language").alias("target_language"),
            F.col("cached_response.provider").alias("provider"), F.col("cached_response.model").alias("model"),
            F.lit(True).alias("hit"), F.col("cached_response.confidence").alias("confidence"),
            F.col("cached_response.alternatives").alias("alternatives"),
            F.col("cached_response.input_tokens").alias("input_tokens"),
            F.col("cached_response.output_tokens").alias("output_tokens"),
            F.lit(None).cast("string").alias("error"), F.lit(False).alias("store"))
        wanted = looked.filter(~is_hit).select(F.col("work_key").alias("_wk"), F.col("first_id").alias("_fid"))
        misses = (keyed.withColumnRenamed("request_id", "first_id")
                  .join(wanted, (F.col("work_key") == F.col("_wk")) & F.col("first_id").eqNullSafe(F.col("_fid")), "left_semi")
                  .dropDuplicates(["work_key"]))
    else:
        # nothing is looked up in between: the first request of a key comes with its text, by one shuffle
        cols = [c for c in keyed.columns if c not in ("work_key", "key_hash", *carry)]
        misses = (keyed.groupBy("work_key").agg(F.min_by(F.struct(*cols), oldest).alias("_f"))
                  .select("work_key", F.substring_index("work_key", "#", 1).alias("key_hash"),
                          *[F.col("_f")[c].alias("first_id" if c == "request_id" else c) for c in cols]))
    ranks = 1 + len(fallback)
    pick = _engine_for(provider_engines, engine)
    engines = sorted({pick(p) for p in known})
    if materialize and (use_cache_table or glossary is not None or (use_tm and tm is not None) or ranks + len(engines) > 2):
        misses = cut_lineage(misses)  # read by the glossary lookup, the masks and the engines

    if use_tm and tm is not None:
        from lingua_spark.operators.memory import tm_exact
        tm_hits = tm_exact(misses.select("work_key", "key_hash", "first_id", "text", "source_lang", "target_lang"), tm)
        misses = misses.join(tm_hits.select("work_key"), "work_key", "left_anti")
        tm_answers = (tm_hits.select("work_key", "key_hash", "first_id", F.col("target_text").alias("translation"),
                              F.col("source_lang").alias("source_language"),
                              F.col("target_lang").alias("target_language"), F.lit("memory").alias("provider"),
                              F.lit("").alias("model"), F.lit(True).alias("hit"), F.lit(1.0).alias("confidence"),
                              F.lit(None).cast("array<string>").alias("alternatives"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"),
                              F.lit(None).cast("string").alias("error"), F.lit(False).alias("store")))
        hit_answers = tm_answers if hit_answers is None else hit_answers.unionByName(tm_answers)

    # Engine work: distinct keys only, masked per target, along the provider chain.
    work = misses
    if glossary is not None:
        work = glossary_for(work, glossary, row_id="work_key")
    else:
        work = work.withColumn("gloss", F.array().cast(GLOSS_TYPE))
    work = (glossary_mask(work, "text", "gloss", "masked")
            .withColumn("chain", chain_array(F.col("provider_name"), known, fallback)))
    pmeta = providers.select(F.col("provider").alias("chain_provider"), F.col("default_model").alias("_pm"),
                             F.col("uses_glossary").alias("_ug"))
    unavailable = F.lit(f"{K.ERR_PROVIDER_UNAVAILABLE}: no provider available")
    parts: list[DataFrame] = []
    pending = work.withColumn("last_error", F.lit(None).cast("string"))
    for rank in range(ranks):
        last = rank == ranks - 1
        step = pending.withColumn("chain_provider", F.get(F.col("chain"), rank))
        if rank > 0 or not any(f in known for f in fallback):
            # rows whose chain ends before this rank (at rank 0 only possible without a known fallback)
            exhausted = step.filter(F.col("chain_provider").isNull())
            parts.append(_answer_rows(exhausted, F.coalesce(F.col("last_error"), unavailable)))
        step = (step.filter(F.col("chain_provider").isNotNull()).join(F.broadcast(pmeta), "chain_provider", "left")
                .withColumn("_masked", F.coalesce(F.col("_ug"), F.lit(True)))
                .withColumnRenamed("text", "req_text").withColumnRenamed("provider", "req_provider")
                .withColumnRenamed("model", "key_model")
                .withColumn("text", F.when(F.col("_masked"), F.col("masked")).otherwise(F.col("req_text")))
                .withColumn("provider", F.col("chain_provider"))
                .withColumn("model", first_nonempty(F.col("model_in"), F.col("_pm"))))
        outs = []
        for eng in engines:
            provs = [p for p in known if pick(p) == eng]
            outs.append(E.run_engine(step.filter(F.col("chain_provider").isin(provs)), eng))
        res = outs[0]
        for o in outs[1:]:
            res = res.unionByName(o)
        res = res.withColumn("error", F.when(F.col("error").isNull() & (F.coalesce(F.col("translation"), F.lit("")) == ""),
                                             F.lit(K.ERR_EMPTY_TRANSLATION)).otherwise(F.col("error")))
        if last:
            parts.append(_answer_rows(res, F.col("error")))
        else:
            # the engine result feeds two branches: materialise it once (no second engine call)
            res = cut_lineage(res)
            parts.append(_answer_rows(res.filter(F.col("error").isNull()), F.col("error")))
            pending = (res.filter(F.col("error").isNotNull()).withColumn("last_error", F.col("error"))
                       .drop("error", "translation", "source_language", "confidence", "alternative_texts", "input_tokens",
                             "output_tokens", "_pm", "_ug", "_masked", "chain_provider", "text", "provider", "model")
                       .withColumnRenamed("req_text", "text").withColumnRenamed("req_provider", "provider")
                       .withColumnRenamed("key_model", "model"))
    answered = parts[0]
    for p_ in parts[1:]:
        answered = answered.unionByName(p_)
    by_key = answered
    if hit_answers is not None:
        by_key = by_key.unionByName(hit_answers)

    # texts that very many requests share take their answer from a broadcast of those few answers
    hot = hot_keys(keyed, "work_key") if materialize else []
    if answers_once or hot:
        by_key = written_once(by_key, "zstd")
    answers = (join_per_key(keyed.select("request_id", "work_key", *carry), by_key, "work_key", hot)
               .withColumn("cached", F.col("error").isNull() & (F.col("hit") | (F.col("request_id") != F.col("first_id"))))
               .select(*ANSWER_COLUMNS, *carry))
    ts_now = F.current_timestamp() if now is None else F.lit(now)
    updates = by_key.filter(F.col("store") & F.col("error").isNull()).select(
        "key_hash",
        F.struct(F.col("translation"), F.col("source_language"), F.col("target_language"), F.col("provider"),
                 F.col("model"), F.lit(False).alias("cached"), F.col("confidence"),
                 F.col("alternatives"), F.col("input_tokens"), F.col("output_tokens")).alias("response"),
        ts_now.alias("created_at"), (ts_now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
        F.lit(1).alias("tier"))
    return TranslateResult(answers, rejected.select("request_id", "error", *carry), updates)
