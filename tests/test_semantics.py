"""Numbering at volume, cache semantics of translate, exact lookups with blank filters, ordered streams."""

import random

import pytest
from pyspark.sql import functions as F

from lingua_spark import constants as K


def big(spark, n=600_000):
    return spark.range(0, n, 1, 16).select(
        F.xxhash64("id").alias("k"), F.col("id").alias("payload"), F.sha2(F.col("id").cast("string"), 256).alias("text"))


def test_sequential_ids_with_payload(spark):
    from lingua_spark.operators.ids import sequential_ids
    got = sequential_ids(big(spark), ["k"], "no", start=5)
    r = got.agg(F.count("*").alias("n"), F.countDistinct("no").alias("d"), F.min("no").alias("lo"), F.max("no").alias("hi"),
                F.countDistinct("payload").alias("p")).first()
    assert (r.n, r.d, r.lo, r.hi, r.p) == (600_000, 600_000, 5, 600_004, 600_000)
    head = [x.k for x in got.orderBy("no").limit(50).collect()]
    assert head == [x.k for x in big(spark).orderBy("k").limit(50).collect()]


def test_rank_results_keeps_all_rows(spark):
    from lingua_spark.operators.windows import rank_results
    df = big(spark).select((F.col("payload") % 3).alias("query_id"), F.col("payload").alias("id"),
                           (F.pmod("k", F.lit(1000)) / 1000).alias("score"), "text")
    r = rank_results(df).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("result_rank").alias("d"), F.max("result_rank").alias("m")).collect()
    assert [(x.n, x.d, x.m) for x in r] == [(200_000, 200_000, 200_000)] * 3


def test_glossary_numbers_follow_the_input(spark):
    from lingua_spark.operators.glossary import load_glossary
    rows = [("zeta", "es", "z"), ("alpha", "es", "a"), ("mid", "fr", "m")]
    ok, _ = load_glossary(spark.createDataFrame(rows, "source_term string, target_lang string, translation string").coalesce(1))
    assert {r.source_term: r.entry_no for r in ok.collect()} == {"zeta": 1, "alpha": 2, "mid": 3}


def requests(spark, rows):
    """(id, text, use_cache)"""
    return spark.createDataFrame(rows, "request_id long, text string, use_cache boolean").select(
        "request_id", F.lit(None).cast("timestamp_ntz").alias("ts"), "text", F.lit("en").alias("source_lang"), F.lit("es").alias("target_lang"),
        F.lit("").alias("provider"), F.lit("").alias("model"), F.lit("").alias("context"), F.lit("neutral").alias("tone"), "use_cache",
        F.lit(0).alias("alternatives"))


def register_choices():
    from lingua_spark.operators.engines import register_engine

    def with_choices(pdf):
        import pandas as pd
        return pd.DataFrame({"translation": "t:" + pdf["text"], "source_language": pdf["source_lang"], "confidence": 0.5, "input_tokens": 1,
                             "output_tokens": 2, "error": None, "alternative_texts": [[x, x + "!"] for x in pdf["text"]]})
    register_engine("choices", with_choices)


def test_use_cache_per_row(spark):
    from lingua_spark.operators.engines import mock_engine, register_engine
    from lingua_spark.plans.translate import translate
    register_choices()
    register_engine("broken", mock_engine(fails=True), kind="native")
    rows = [(1, "a", False), (2, "a", True), (3, "a", True), (4, "a", False), (5, "b", None), (6, "b", True), (7, "", True)]
    res = translate(requests(spark, rows), engine="choices")
    got = {r.request_id: r for r in res.answers.collect()}
    assert {i: r.cached for i, r in got.items()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}
    assert got[3].alternatives == ["a", "a!"]
    assert [r.request_id for r in res.rejected.collect()] == [7]
    updates = res.cache_updates.collect()
    assert len(updates) == 2 and sorted(u.response.alternatives[0] for u in updates) == ["a", "b"]

    # answers kept in a cache come back with their alternatives, without `as_of` at the current time
    again = {r.request_id: r for r in translate(requests(spark, rows), engine="choices", cache=res.cache_updates).answers.collect()}
    assert {i: r.cached for i, r in again.items()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
    assert again[2].alternatives == ["a", "a!"]

    failed = {r.request_id: r for r in translate(requests(spark, rows), engine="broken").answers.collect()}
    assert not any(r.cached for r in failed.values()) and all(r.error for r in failed.values())
    first = K.DEFAULT_PROVIDER
    saved = translate(requests(spark, rows), engine="choices", provider_engines={first: "broken"}, fallback=["deepl"]).answers.collect()
    assert {r.provider for r in saved} == {"deepl"} and sum(r.cached for r in saved) == 2


def test_tiers_and_blank_languages(spark):
    from lingua_spark.operators.cache import tiered_lookup
    from lingua_spark.operators.memory import tm_exact
    tiers = spark.createDataFrame([("k", 2, "old", 1), ("k", 2, "new", 5), ("k", 3, "far", 9)], "key_hash string, tier int, response string, s int") \
        .select("key_hash", "tier", "response", F.timestamp_seconds("s").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    hits, back = tiered_lookup(spark.createDataFrame([("k", 1)], "key_hash string, request_id long"), tiers, F.current_timestamp())
    assert hits.first().cached_response == "new" and back.first().response == "new"
    tm = spark.createDataFrame([(1, "Hi", "hola", "en", "es"), (2, "hi", "salut", "en", "fr")],
                               "id long, source_text string, target_text string, source_lang string, target_lang string")
    q = spark.createDataFrame([(1, " hi ", "en", ""), (2, "HI", None, "es"), (3, "hi", "de", ""), (4, "hi", "", None)],
                              "query_id long, text string, source_lang string, target_lang string")
    assert {r.query_id: r.tm_id for r in tm_exact(q, tm).collect()} == {1: 2, 2: 1, 4: 2}


def file_stream(spark, parts, schema):
    import os
    from lingua_spark.streaming.streams import scratch
    base = scratch(spark, "test-in")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).repartition(1).write.parquet(os.path.join(base, f"part={k}"))
    return base, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "part=*"))


def test_stream_runs_and_dedup_out_of_order(spark):
    """Three micro-batches that overlap in time; the streams resume in a second call."""
    from lingua_spark.operators.cache import ttl_dedup
    from lingua_spark.operators.windows import failure_runs
    from lingua_spark.streaming.streams import scratch, stream_dedup, stream_failure_runs
    rng = random.Random(4)
    rows = [(i, rng.choice("pppq"), rng.random() < 0.3, i * 1_000_000 + rng.randrange(10)) for i in range(300)]
    parts = [[], [], [], []]
    for r in rows:
        parts[min(3, max(0, (r[0] + rng.randrange(-30, 30)) // 75))].append(r)
    for p in parts:
        rng.shuffle(p)
    schema = "call_id long, provider string, ok boolean, t_us long"
    import os
    base, s = file_stream(spark, parts[:3], schema)
    whole = spark.createDataFrame(rows, schema)
    a, b = scratch(spark, "runs"), scratch(spark, "dedup")
    stream_failure_runs(s, 3, 70, base=a, close=False)
    stream_dedup(s, "provider", "t_us", "call_id", 7.0, 70, base=b, close=False)
    spark.createDataFrame(parts[3], schema).repartition(1).write.parquet(os.path.join(base, "part=3"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "part=*"))
    got = {r.call_id: (r.run_len, r.tripped) for r in stream_failure_runs(s, 3, 70, base=a).collect()}
    assert got == {r.call_id: (r.run_len, r.tripped) for r in failure_runs(whole.withColumn("ts", F.timestamp_micros("t_us")), 3).collect()}
    got = {r.call_id: r.action for r in stream_dedup(s, "provider", "t_us", "call_id", 7.0, 70, base=b).collect()}
    assert got == {r.call_id: r.action for r in ttl_dedup(whole, 7.0, key="provider", ts_micros="t_us", id_col="call_id").collect()}


def test_stream_translate_feeds_its_cache(spark):
    from lingua_spark.plans.translate import translate
    from lingua_spark.streaming.streams import stream_translate
    register_choices()
    _, s = file_stream(spark, [[(1, "a", True)], [(2, "a", True), (3, "b", True)], [(4, "a", True)]], "request_id long, text string, use_cache boolean")
    empty = translate(requests(spark, [(9, "z", True)]), engine="choices").cache_updates.where("false")
    out = stream_translate(s, lambda d: d.select(
        "request_id", F.lit(None).cast("timestamp_ntz").alias("ts"), "text", F.lit("en").alias("source_lang"), F.lit("es").alias("target_lang"),
        F.lit("").alias("provider"), F.lit("").alias("model"), F.lit("").alias("context"), F.lit("neutral").alias("tone"), "use_cache",
        F.lit(0).alias("alternatives")), {"engine": "choices", "cache": empty})
    assert {r.request_id: r.cached for r in out.collect()} == {1: False, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("hot", [True, False])
def test_scans_split_one_provider(spark, hot):
    """One provider with all calls of a day is spread over several buckets, and the runs are right."""
    from lingua_spark.operators.windows import failure_runs, order_buckets, over_rate
    rng = random.Random(2)
    rows = [(i, "p" if hot else rng.choice("pq"), rng.random() < 0.2, rng.randrange(86_400) * 1_000_000) for i in range(4000)]
    log = spark.createDataFrame(rows, "call_id long, provider string, ok boolean, t_us long").withColumn("ts", F.timestamp_micros("t_us"))
    if hot:
        many = spark.range(0, 400_000, 1, 8).select(F.lit("p").alias("provider"), F.xxhash64("id").alias("t"))
        assert order_buckets(many, "provider", [F.col("t")], "b").select("b").distinct().count() > 1
    want, run = {}, {}
    for i, p, ok, t in sorted(rows, key=lambda r: (r[3], r[0])):
        run[p] = 0 if ok else run.get(p, 0) + 1
        want[i] = run[p]
    assert {r.call_id: r.run_len for r in failure_runs(log, 3).collect()} == want
    times = {p: sorted(r[3] for r in rows if r[1] == p) for p in "pq"}
    got = {r.call_id: r.in_window for r in over_rate(log, 1 / 60, 2, 600.0).collect()}
    for i, p, _, t in rows[::40]:
        assert got[i] == sum(t - 600_000_000 < x <= t for x in times[p])
