"""Typed loaders and sinks: SRC-1, SRC-4, SRC-6."""

import os
import uuid

from pyspark.sql import functions as F

from lingua_spark.session import ensure_checkpoint_dir


def _tmp(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "test_src", f"{name}-{uuid.uuid4().hex}")


def test_load_requests_json_defaults(spark):
    from lingua_spark.sources.requests import load_requests
    path = _tmp(spark, "req")
    lines = ['{"request_id": 1, "text": "hello", "target_lang": "es"}',
             '{"request_id": 2, "text": "hi", "target_lang": "fr", "source_lang": "en", "tone": "formal", '
             '"use_cache": false, "alternatives": 2}']
    spark.sparkContext.parallelize(lines, 1).saveAsTextFile(path)
    r = {x.request_id: x for x in load_requests(spark, path, "json").collect()}
    assert (r[1].source_lang, r[1].tone, r[1].use_cache, r[1].alternatives, r[1].provider) == ("auto", "neutral", True, 0, "")
    assert (r[2].source_lang, r[2].tone, r[2].use_cache, r[2].alternatives) == ("en", "formal", False, 2)


def test_load_documents_split(spark):
    from lingua_spark.sources.requests import load_documents
    path = _tmp(spark, "docs")
    lines = ['{"doc_id": 1, "content": "# hi", "format": "markdown", "target_lang": "es"}',
             '{"doc_id": 2, "content": "x", "format": "rst", "target_lang": "es"}',
             '{"doc_id": 3, "content": "", "format": "html", "target_lang": "es"}']
    spark.sparkContext.parallelize(lines, 1).saveAsTextFile(path)
    ok, bad = load_documents(spark, path, "json")
    assert [r.doc_id for r in ok.collect()] == [1] and ok.first().source_lang == "auto"
    errs = {r.doc_id: r.error for r in bad.collect()}
    assert errs[2] == "invalid input: unsupported format rst"
    assert errs[3].startswith("invalid input: content, format and target_language required")


def test_write_responses_round_trip(spark):
    from lingua_spark import schemas as S
    from lingua_spark.operators.cache import write_responses
    path = _tmp(spark, "resp")
    df = spark.createDataFrame([("hola", "en", "es", "mock", "", False, 0.9, None, 0, 0)], S.RESPONSE)
    write_responses(df, path)
    back = spark.read.schema(S.RESPONSE).json(path).first()
    assert (back.translation, back.source_language, back.target_language, back.confidence) == ("hola", "en", "es", 0.9)
    js = df.select(F.to_json(F.struct(*df.columns)).alias("j")).first().j
    assert '"translation":"hola"' in js and '"source_language":"en"' in js


def test_ingest_parses_each_body_once_and_checks_types(spark):
    from lingua_spark.sources.ingest import ingest_detections, ingest_responses
    llm = lambda content: '{"choices": [{"message": {"content": %s}}], "usage": {"prompt_tokens": 7, "completion_tokens": "x"}}' % content
    bodies = [llm('"{\\"translation\\": \\"hola\\", \\"confidence\\": 3, \\"alternatives\\": [\\"a\\"]}"'),
              llm('"{\\"translation\\": 5}"'), llm('"{\\"translation\\": \\"x\\", \\"confidence\\": \\"high\\"}"'), llm("12"),
              llm('"{\\"translation\\": null}"'), "not json", None, llm('"plain"')]
    landed = spark.createDataFrame([(str(i), "openai", "m", 200, b, "en", "es") for i, b in enumerate(bodies)],
                                   "key_hash string, provider string, model string, status int, body string, source_lang string, target_lang string")
    out = ingest_responses(landed)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(body") + plan.count("ParseJson(body") + plan.lower().count("parsejson(body") <= 1
    got = {r.key_hash: (r.translation, r.confidence, r.alternatives, r.input_tokens, r.output_tokens, r.error) for r in out.collect()}
    assert got["0"] == ("hola", 1.0, ["a"], 7, 0, None)
    assert got["1"][:2] == ('{"translation": 5}', 0.5) and got["2"][1] == 0.5  # mistyped: the raw text
    assert got["3"][5] == got["5"][5] == got["6"][5] == "openai returned no content" and got["4"][5] == "empty translation"
    assert got["7"][:2] == ("plain", 0.5)
    detect = landed.withColumn("body", F.when(F.col("key_hash") == "0", F.lit(llm('"{\\"language\\": \\"ES\\", \\"confidence\\": 0.97}"')))
                               .when(F.col("key_hash") == "1", F.lit(llm('"[1]"'))).otherwise(F.col("body")))
    got = {r.key_hash: (r.language, r.confidence, r.error) for r in ingest_detections(detect).collect()}
    assert got["0"] == ("es", 0.97, None) and got["1"][2] == "openai detect failed: mistyped field"
    assert got["3"][2] == "no response" and got["5"][2] == got["6"][2] == "openai detect failed: invalid json"
    libre = detect.withColumn("provider", F.lit("libretranslate")).withColumn("body", F.lit('[{"language": "fr", "confidence": 90}, {"language": "en"}]'))
    assert {(r.language, r.confidence) for r in ingest_detections(libre).collect()} == {("fr", 90.0)}


def test_spread_bounds_the_bytes_of_a_task(spark, tmp_path):
    """One file with one row group is dealt to as many tasks as `task_bytes` asks for; no row is lost."""
    from pyspark.sql import functions as F

    from lingua_spark.session import spread
    spark.range(40_000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    few, many = spread(df), spread(df, 64 << 10)
    assert many.rdd.getNumPartitions() > max(20, few.rdd.getNumPartitions())
    assert many.exceptAll(df).count() == 0 and many.count() == 40_000
