"""Golden rows of the scalar functions (reference tests and decisions D-1, D-2, D-3)."""

from pyspark.sql import functions as F

from lingua_spark.functions import keys as FK
from lingua_spark.functions import text as FT


def one(spark, expr_fn, *vals, schema="v string"):
    df = spark.createDataFrame([tuple(v if isinstance(v, tuple) else (v,)) for v in vals], schema)
    return [r[0] for r in df.select(expr_fn(df)).collect()]


def test_normalize_text(spark):
    got = one(spark, lambda d: FT.normalize_text("v"), "  hello   world  ", "\n\nfoo\tbar\n\n", "", " x ")
    assert got == ["hello world", "foo bar", "", "x"]


def test_truncate_tokens_paragraphs(spark):
    assert one(spark, lambda d: FT.truncate_text("v", 5), "hello world") == ["hello"]
    assert one(spark, lambda d: FT.truncate_text("v", 100), "hello world") == ["hello world"]
    assert one(spark, lambda d: FT.estimate_tokens("v"), "a" * 40) == [11]
    assert one(spark, lambda d: FT.split_paragraphs("v"), "p1\n\np2\n\n\n\np3") == [["p1", "p2", "p3"]]


def test_mostly_latin(spark):
    assert one(spark, lambda d: FT.is_mostly_latin("v"), "hello", "你好", "123") == [True, False, True]


def test_normalize_language(spark):
    got = one(spark, lambda d: FT.normalize_language("v"), "  EN  ", "EN-US", "fr-CA", "auto", "", "xx", "zh-CN", "pt-BR")
    assert got == ["en", "en", "fr", "auto", "auto", "xx", "zh", "pt"]


def test_cache_key(spark):
    df = spark.createDataFrame([("hello",), ("hello",), ("hello ",)], "t string")
    k = [r[0] for r in df.select(FK.cache_key("t", F.lit("en"), F.lit("es"), F.lit("p"), F.lit("m"), F.lit(""),
                                              F.lit("neutral"), F.lit(0))).collect()]
    assert k[0] == k[1] and k[0] != k[2] and len(k[0]) == 64


def test_mask_for_log(spark):
    assert one(spark, lambda d: FT.mask_for_log("v"), "short", "abcdefghijk") == ["***", "abc...ijk"]
    assert one(spark, lambda d: FT.mask_for_log("v", False), "short") == ["short"]


def test_ttl_seconds(spark):
    got = one(spark, lambda d: FK.ttl_seconds("v", 60), "1h", "", "invalid", "0", "1h30m", "500ms", "1.5h", "-2s")
    assert got == [3600.0, 60.0, 60.0, 60.0, 5400.0, 0.5, 5400.0, -2.0]


def test_first_nonempty(spark):
    df = spark.createDataFrame([("", None, "c"), ("a", "b", "c"), ("", "", "")], "a string, b string, c string")
    assert [r[0] for r in df.select(FT.first_nonempty("a", "b", "c")).collect()] == ["c", "a", ""]


def test_supported_languages_and_names(spark):
    from lingua_spark.operators.chain import language_names, supported_languages
    langs = [r.code for r in supported_languages(spark).collect()]
    assert len(langs) == 30 and langs == sorted(langs)
    df = spark.createDataFrame([("es",), ("unknown",)], "c string")
    assert [r.language_name for r in language_names(df, "c").orderBy("c").collect()] == ["Spanish", "unknown"]


def test_checkpoint_dir_and_listing(spark, tmp_path):
    from lingua_spark.session import ensure_checkpoint_dir, list_dir
    d = ensure_checkpoint_dir(spark)
    assert d
    (tmp_path / "a=1").mkdir()
    assert list_dir(spark, "file://" + str(tmp_path)) == ["a=1"]
    assert list_dir(spark, "file://" + str(tmp_path / "missing")) == []
