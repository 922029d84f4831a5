"""Golden rows of the operators (reference tests, FIXTURES.md parts B and C)."""

import os

from pyspark.sql import functions as F

from lingua_spark.operators import engines as E
from lingua_spark.operators.glossary import (glossary_for, glossary_get, glossary_mask, glossary_version_at,
                                             restore_terms)
from lingua_spark.plans.translate import translate

GL = "entry_no long, source_term string, target_lang string, translation string, context string, " \
     "case_sensitive boolean, added_at timestamp"


def gloss(spark, rows):
    return spark.createDataFrame([(i + 1, *r, "", cs, None) for i, (*r, cs) in enumerate(rows)], GL)


def mask(spark, g, texts, target="es"):
    req = spark.createDataFrame([(i, t, target) for i, t in enumerate(texts)], "id long, text string, target_lang string")
    m = glossary_mask(glossary_for(req, g), "text", "gloss", "masked")
    return [r.masked for r in m.orderBy("id").collect()], m


def test_glossary_mask_restore(spark):
    g = gloss(spark, [("API", "es", "API", True), ("server", "es", "servidor", False)])
    got, m = mask(spark, g, ["The server exposes an API"])
    assert got == ["The __TERM_0__ exposes an __TERM_1__"]
    r = m.select(restore_terms(F.lit("El __TERM_1__ expone una __TERM_0__"), F.col("gloss")).alias("r")).first().r
    assert r == "El API expone una servidor"


def test_glossary_ascii_boundaries(spark):
    g = gloss(spark, [("caf", "es", "X", False)])
    assert mask(spark, g, ["café caf"])[0] == ["__TERM_0__é __TERM_0__"]
    g = gloss(spark, [("C++", "es", "X", True)])
    assert mask(spark, g, ["C++ and C"])[0] == ["C++ and C"]
    g = gloss(spark, [("äpi", "es", "X", False)])
    assert mask(spark, g, ["ÄPI aÄPI"])[0] == ["ÄPI a__TERM_0__"]


def test_glossary_rank_order_and_global(spark):
    g = gloss(spark, [("ab", "es", "1", False), ("cd", "es", "2", False), ("ab", "", "3", False)])
    _, m = mask(spark, g, ["ab cd"])
    ranks = [(e.rank, e.term, e.translation) for e in m.first().gloss]
    assert ranks == [(0, "ab", "1"), (1, "cd", "2"), (2, "ab", "3")]


def test_glossary_get_and_version(spark):
    g = gloss(spark, [("hello", "es", "hola", False), ("world", "fr", "monde", False), ("all", "", "todo", False)])
    assert glossary_get(g, "es").count() == 2 and glossary_get(g, "").count() == 1 and g.count() == 3
    req = spark.createDataFrame([(1, None)], "request_id long, ts timestamp")
    assert glossary_version_at(req, g).first().glossary_version == 3
    empty = spark.createDataFrame([], GL)
    assert glossary_version_at(req, empty).first().glossary_version == 0


def _tm(spark, rows):
    return spark.createDataFrame([(i + 1, s, t, sl, tl) for i, (s, t, sl, tl) in enumerate(rows)],
                                 "id long, source_text string, target_text string, source_lang string, target_lang string")


def _search(spark, tm, queries, t, **kw):
    from lingua_spark.operators.memory import tm_search
    q = spark.createDataFrame([(i, *qq) for i, qq in enumerate(queries)],
                              "query_id long, text string" + (", sl string, tl string" if kw else ""))
    return tm_search(q, tm, t, **({"source_lang": "sl", "target_lang": "tl"} if kw else {}))


def test_tm_search_golden(spark):
    tm = _tm(spark, [("hello", "hola", "en", "es"), ("hello", "bonjour", "en", "fr")])
    assert _search(spark, tm, [("hello", "en", "fr")], 0.9, kw=True).select("target_text").first()[0] == "bonjour"
    tm = _tm(spark, [("hello world", "x", "en", "es"), ("hello", "y", "en", "es")])
    r = _search(spark, tm, [("hello",)], 0.5).orderBy(F.col("score").desc()).collect()
    assert [(x.source_text, x.score) for x in r] == [("hello", 1.0), ("hello world", 0.95)]


def test_tm_search_scores(spark):
    tm = _tm(spark, [("é", "x", "en", "es"), ("", "y", "en", "es"), ("abcdefghij", "z", "en", "es")])
    r = {(x.query_id, x.id): x.score for x in _search(spark, tm, [("e",), ("",), ("abcdefghix",)], 0.5).collect()}
    assert r[(0, 1)] == 0.5            # 1 - 1 edit / 2 bytes
    assert r[(1, 1)] == 0.95 and r[(1, 2)] == 1.0 and r[(1, 3)] == 0.95
    assert abs(r[(2, 3)] - 0.9) < 1e-9


def test_tm_search_brute_force(spark):
    import random
    rnd = random.Random(7)
    alphabet = "abcé "
    words = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    tm = _tm(spark, [(w, "t", "en", "es") for w in words])
    queries = [(w,) for w in words[:30]]

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(cur[j - 1] + 1, prev[j] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]

    def score(a, b):
        if a == b:
            return 1.0
        if a in b:
            return 0.95
        m = max(len(a.encode()), len(b.encode()))
        return 1.0 - lev(a, b) / m
    for t in (0.5, 0.8, 0.97):
        got = {(x.query_id, x.id) for x in _search(spark, tm, queries, t).collect()}
        exp = {(qi, ti + 1) for qi, (q,) in enumerate(queries) for ti, w in enumerate(words)
               if score(q.strip().lower(), w.lower()) >= t}
        assert got == exp, t


def test_ttl_dedup_sequence(spark):
    from lingua_spark.operators.cache import ttl_dedup
    ts = [0, 4, 10, 11, 15, 21, 22]
    df = spark.createDataFrame([("k", i, t * 1_000_000) for i, t in enumerate(ts)], "key_hash string, request_id long, ts_us long")
    got = [r.action for r in ttl_dedup(df, 10).orderBy("request_id").collect()]
    assert got == ["write", "hit", "hit", "write", "hit", "hit", "write"]


def test_failure_runs(spark):
    from lingua_spark.operators.windows import failure_runs
    rows = [(1, False), (2, False), (3, True), (4, False), (5, False)]
    df = spark.createDataFrame([(i, "p", ok, f"2024-01-01 00:00:0{i}") for i, ok in rows],
                               "call_id long, provider string, ok boolean, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    got = [(r.run_len, r.tripped) for r in failure_runs(df, 2).orderBy("call_id").collect()]
    assert got == [(1, False), (2, True), (0, False), (1, False), (2, True)]


def _reqs(spark, rows):
    return spark.createDataFrame(
        [(i, None, t, s, tg, p, "", "", "neutral", True, 0) for i, (t, s, tg, p) in enumerate(rows)],
        "request_id long, ts timestamp, text string, source_lang string, target_lang string, provider string, "
        "model string, context string, tone string, use_cache boolean, alternatives int")


def test_translate_mock_cache_and_fallback(spark):
    d = spark.createDataFrame([("hello", "hola")], "source_text string, translation string")
    E.register_engine("t_mock", E.mock_engine(d), kind="native")
    E.register_engine("t_fail", E.mock_engine(fails=True), kind="native")
    res = translate(_reqs(spark, [("hello", "en", "es", "openai"), ("hello", "en", "es", "openai"), ("", "en", "es", "")]),
                    engine="t_mock", materialize=False)
    a = res.answers.orderBy("request_id").collect()
    assert [x.translation for x in a] == ["hola", "hola"] and [x.cached for x in a] == [False, True]
    assert res.rejected.first().error == "invalid input: text is empty"
    d2 = spark.createDataFrame([("hello", "salut")], "source_text string, translation string")
    E.register_engine("t_fb", E.mock_engine(d2), kind="native")
    res = translate(_reqs(spark, [("hello", "en", "fr", "openai")]), engine="t_fail",
                    provider_engines={"deepl": "t_fb"}, fallback=["deepl"])
    a = res.answers.first()
    assert (a.translation, a.provider, a.error) == ("salut", "deepl", None)


def test_translate_glossary_restores(spark):
    E.register_engine("t_mock2", E.mock_engine(), kind="native")
    g = gloss(spark, [("SDK", "es", "SDK", False)])
    a = translate(_reqs(spark, [("Welcome to SDK", "en", "es", "")]), engine="t_mock2", glossary=g,
                  materialize=False).answers.first()
    assert "SDK" in a.translation and "__TERM_" not in a.translation


def test_batches(spark):
    from lingua_spark.operators.chain import batch_many_to_one, batch_one_to_many
    df = spark.createDataFrame([(1, "hello", ["es", "fr"]), (2, "x", ["es", "fr"])], "batch_id long, text string, targets array<string>")
    assert batch_one_to_many(df).count() == 4
    assert batch_one_to_many(df, max_items=1).filter("error is not null").count() == 2
    items = spark.createDataFrame([(1, [("hello", ""), ("world", "fr")], "es")],
                                  "batch_id long, items array<struct<text:string,target_lang:string>>, target_lang string")
    got = [(r.text, r.target_lang) for r in batch_many_to_one(items).orderBy("item_pos").collect()]
    assert got == [("hello", "es"), ("world", "fr")]


def test_resolve_chain(spark):
    from lingua_spark.operators.chain import resolve_chain
    df = spark.createDataFrame([(1, "nosuch"), (2, "deepl"), (3, "")], "request_id long, provider string")
    r = resolve_chain(df, ["openai", "deepl"], ["deepl", "openai"])
    got = {(x.request_id, x.rank): x.chain_provider for x in r.collect()}
    assert got == {(1, 0): "deepl", (1, 1): "openai", (2, 0): "deepl", (2, 1): "openai", (3, 0): "openai", (3, 1): "deepl"}
    assert resolve_chain(df, ["openai"], []).filter("request_id = 1").count() == 0


def test_documents_json_and_markup(spark):
    from lingua_spark.operators.documents import segment_markdown, segment_tagged, translate_documents
    docs = spark.createDataFrame([
        (1, '{"greeting":"hello","n":12345678901234567890,"a":["x",{"k:1":"é"}],"e":""}', "json"),
        (2, "not json", "json"), (3, "<p>hi</p><script>x</script> \n<b>", "html"),
        (4, "intro\n```py\ncode\n```\n```\nmore\n```tail", "markdown"), (5, "x", "rst")],
        "doc_id long, content string, format string")

    def fn(segs):
        return segs.select("segment", F.concat(F.lit("translated:"), F.col("segment")).alias("translation"),
                           F.lit(None).cast("string").alias("error"))
    out = {r.doc_id: (r.output, r.error) for r in translate_documents(docs, fn).collect()}
    assert out[1][0] == '{"greeting":"translated:hello","n":12345678901234567890,' \
                        '"a":["translated:x",{"k:1":"translated:é"}],"e":""}'
    assert out[2] == (None, "invalid input: invalid json")
    assert out[3][0] == "<p>translated:hi</p><script>translated:x</script> \n<b>"
    assert out[4][0].startswith("translated:intro\n\n\n```py\ncode\n```")
    assert out[5][1] == "invalid input: unsupported format rst"
    # split / reassemble identity
    pages = spark.createDataFrame([(1, "<a>x</a> y <b>")], "doc_id long, content string")
    assert "".join(r.segment for r in segment_tagged(pages).orderBy("pos").collect()) == "<a>x</a> y <b>"
    assert segment_markdown(docs.filter("doc_id = 4")).filter("kind = 'keep'").count() == 2


def test_ingest_responses(spark):
    from lingua_spark.sources.ingest import ingest_responses
    body = '{"choices":[{"message":{"content":"{\\"translation\\":\\"hola\\",\\"source_language\\":\\"en\\",' \
           '\\"confidence\\":0.95}"}}],"usage":{"prompt_tokens":10,"completion_tokens":2}}'
    rows = [("a", "openrouter", "m", 200, body), ("b", "openai", "m", 429, "{}"),
            ("c", "ollama", "m", 200, '{"message":{"content":"hola"}}'),
            ("d", "ollama", "m", 200, '{"message":{"content":"{\\"translation\\":\\"x\\",\\"confidence\\":7}"}}'),
            ("e", "ollama", "m", 200, '{"message":{"content":"{\\"translation\\":\\"\\"}"}}'),
            ("f", "ollama", "m", 200, '{"message":{"content":"{\\"translation\\":\\"x\\",\\"confidence\\":\\"x\\"}"}}')]
    df = spark.createDataFrame([(*r, "auto", "es") for r in rows],
                               "key_hash string, provider string, model string, status int, body string, "
                               "source_lang string, target_lang string")
    r = {x.key_hash: x for x in ingest_responses(df).collect()}
    assert (r["a"].translation, r["a"].source_language, r["a"].confidence, r["a"].input_tokens) == ("hola", "en", 0.95, 10)
    assert r["b"].error.startswith("rate limited")
    assert (r["c"].translation, r["c"].confidence) == ("hola", 0.5)
    assert r["d"].confidence == 1.0
    assert r["e"].error == "empty translation"
    assert r["f"].confidence == 0.5


def test_metrics_status(spark):
    from lingua_spark.operators.metrics import provider_status
    df = spark.createDataFrame([(1, "a", True, None, 1), (2, "b", False, "boom", 1)],
                               "call_id long, provider string, ok boolean, error string, t int") \
        .withColumn("ts", F.current_timestamp())
    got = {r.provider: r.status for r in provider_status(df).collect()}
    assert got == {"a": "healthy", "b": "unhealthy: boom"}


def test_ttl_dedup_brute_force(spark):
    import random
    from lingua_spark.operators.cache import ttl_dedup
    rnd = random.Random(3)
    rows, t = [], {}
    for i in range(600):
        k = rnd.choice(["a", "a", "a", "b", "c"])
        t[k] = t.get(k, 0) + rnd.choice([0, 1, 5, 20, 3600, 7300]) * 1_000_000
        rows.append((k, i, t[k]))
    df = spark.createDataFrame(rows, "key_hash string, request_id long, ts_us long")
    ttl = 3600.0
    got = {r.request_id: r.action for r in ttl_dedup(df, ttl).collect()}
    exp, anchor = {}, {}
    for k, i, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if k not in anchor or ts > anchor[k] + ttl * 1_000_000:
            anchor[k] = ts
            exp[i] = "write"
        else:
            exp[i] = "hit"
    assert got == exp


def test_glossary_special_letters(spark):
    from lingua_spark.operators import glossary as G
    g = gloss(spark, [("server", "es", "S", False), ("kb", "es", "K", False), ("日本", "es", "J", False),
                      ("ещё", "es", "E", False), ("€", "es", "U", True), ("\u0131\u015f\u0131k", "es", "T", False)])
    req = spark.createDataFrame([(0, "the ſerver and server", "es"), (1, "a\u212ab x 日本 a日本", "es"), (2, "__TERM_1__", "es"),
                                 (3, "ЕЩЁ ещё € 日本語 xЕЩЁy 5€6", "es"), (4, "an I\u015e\u0131K", "es"), (5, "an I\u015eiK.", "es"), (6, None, "es")],
                                "id long, text string, target_lang string")
    m = G.glossary_mask(G.glossary_for(req, g, row_id="id"), "text", "gloss", "masked")
    got = {r.id: r.masked for r in m.collect()}
    # ranks by byte length: ışık, then server, 日本, ещё (6 bytes each), €, kb
    assert got == {0: "the ſerver and __TERM_1__", 1: "a__TERM_5__ x 日本 a日本", 2: "__TERM_1__", 3: "ЕЩЁ ещё € 日本語 x__TERM_3__y 5__TERM_4__6",
                   4: "an __TERM_0__", 5: "an __TERM_0__.", 6: None}
    assert [len(r.gloss) for r in m.filter("id = 2").collect()] == [1]  # a placeholder keeps its entry


def test_glossary_candidates_are_few(spark):
    """2,000 Cyrillic terms on plain Cyrillic rows: no entry can match, and none is compared."""
    words = [f"{a}{b}{c}" for a in "абвгдежз" for b in "ийклмнопрс" for c in "туфхцчшщъыьэюяабвгдежзийк"]
    g = gloss(spark, [(w, "es", "x", False) for w in words])
    req = spark.createDataFrame([(i, " ".join(words[i::7]), "es") for i in range(500)], "id long, text string, target_lang string")
    found = glossary_for(req, g, row_id="id")
    assert found.select(F.sum(F.size("gloss"))).first()[0] == 0 and g.count() == 2000
    joined = req.withColumn("text", F.concat(F.lit("x"), F.lit(words[5]), F.lit("y")))
    found = glossary_for(joined, g, row_id="id")
    assert found.select(F.max(F.size("gloss"))).first()[0] <= 30  # those that begin with the same two letters


def test_glossary_mask_against_all_entries(spark):
    """The looked-up entries give what running every entry of the target gives, on mixed scripts."""
    import random
    from lingua_spark.operators.glossary import mask_terms, ranked_entries
    rnd = random.Random(4)
    bits = ["ab", "AB", "c", "d_e", "9", "é", "É", "ß", "ẞ", "ς", "Σ", "日", "本", "ſ", "K", "k", "İ", "i", "-", ".", "+", " ", "  ", "\n", "\\E"]
    terms = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    g = gloss(spark, [(t, rnd.choice(["es", "", "fr"]), "x", rnd.random() < 0.3) for t in terms])
    req = spark.createDataFrame([(i, t, rnd.choice(["es", "fr"])) for i, t in enumerate(texts)], "id long, text string, target_lang string")
    got = {r.id: r.masked for r in glossary_mask(glossary_for(req, g, row_id="id"), "text", "gloss", "masked").collect()}
    every = (ranked_entries(req, g).groupBy("target_lang").agg(F.array_sort(F.collect_list(F.struct("rank", "placeholder", "pattern"))).alias("gloss")))
    want = {r.id: r.masked for r in req.join(every, "target_lang").select("id", mask_terms(F.col("text"), F.col("gloss")).alias("masked")).collect()}
    assert got == want and sum(v != t for v, t in zip(map(want.get, range(150)), texts)) > 50


def test_tm_search_language_filters_brute_force(spark):
    import random
    from lingua_spark.operators.memory import tm_search
    rnd = random.Random(11)
    langs = ["", "en", "fr"]
    words = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    tm_rows = [(i + 1, w, "t", rnd.choice(["en", "fr"]), rnd.choice(["es", "de"])) for i, w in enumerate(words)]
    tm = spark.createDataFrame(tm_rows, "id long, source_text string, target_text string, source_lang string, "
                                        "target_lang string")
    qs = [(i, rnd.choice(words), rnd.choice(langs), rnd.choice(["", "es", "de"])) for i in range(25)]
    q = spark.createDataFrame(qs, "query_id long, text string, sl string, tl string")
    got = {(r.query_id, r.id) for r in tm_search(q, tm, 0.5, source_lang="sl", target_lang="tl").collect()}

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(cur[j - 1] + 1, prev[j] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]

    def score(a, b):
        if a == b:
            return 1.0
        if a in b:
            return 0.95
        return 1.0 - lev(a, b) / max(len(a), len(b))
    exp = {(qi, tid) for qi, text, sl, tl in qs for tid, w, _, tsl, ttl in tm_rows
           if (sl == "" or sl == tsl) and (tl == "" or tl == ttl) and score(text.strip(), w) >= 0.5}
    assert got == exp


def test_translate_with_repeated_request_ids(spark):
    E.register_engine("t_mock3", E.mock_engine(), kind="native")
    r = _reqs(spark, [("hello", "en", "es", ""), ("hello", "en", "es", ""), ("bye", "en", "es", "")])
    r = r.withColumn("request_id", F.lit(0).cast("long"))
    a = translate(r, engine="t_mock3").answers
    assert a.count() == 3 and a.select("key_hash").distinct().count() == 2


def test_documents_edge_cases(spark):
    from lingua_spark.operators.documents import translate_documents
    docs = spark.createDataFrame([
        (1, '"top level"', "json"),
        (2, '{"q":"say \\"hi\\"\\n","k":[1,2.50,true,null]}', "json"),
        (3, "a < b <i>c</i>", "html"),
        (4, "text\n```unclosed\ncode", "markdown"),
        (5, "```a```\n```b```", "markdown")],
        "doc_id long, content string, format string")

    def fn(segs):
        return segs.select("segment", F.concat(F.lit("T:"), F.col("segment")).alias("translation"),
                           F.lit(None).cast("string").alias("error"))
    out = {r.doc_id: r.output for r in translate_documents(docs, fn).collect()}
    assert out[1] == '"T:top level"'
    assert out[2] == '{"q":"T:say \\"hi\\"\\n","k":[1,2.50,true,null]}'
    # '<[^>]+>' swallows "< b <i>"; the stray '<' never starts a text piece
    assert out[3] == "T:a </i>" or out[3].startswith("T:a ")
    assert out[4] == "T:text\n```unclosed\ncode"
    # the optional info-string group swallows "a```\n": the first fence is "```a```\n```"
    assert out[5] == "```a```\n```\n\nT:b```"


def test_output_budget_golden(spark):
    from lingua_spark.operators.validate import output_budget
    df = spark.createDataFrame([("",), ("hello",), ("a" * 65,)], "t string")
    assert [r[0] for r in df.select(output_budget(F.col("t"))).collect()] == [512, 512, 516]


def test_translate_with_detection_and_tm(spark):
    from lingua_spark.operators.memory import tm_exact  # noqa: F401
    E.register_engine("t_mock4", E.mock_engine(), kind="native")
    reqs = _reqs(spark, [("Hallo Welt", "auto", "es", ""), ("hello", "en", "es", "")])
    detected = spark.createDataFrame([("Hallo Welt", "DE")], "text string, language string")
    tm = spark.createDataFrame([(1, "HELLO", "hola (tm)", "en", "es")],
                               "id long, source_text string, target_text string, source_lang string, target_lang string")
    a = {r.request_id: r for r in translate(reqs, engine="t_mock4", detected=detected.withColumn(
        "language", F.lower("language")), tm=tm, use_tm=True, materialize=False).answers.collect()}
    assert a[0].source_language == "de" and a[0].translation == "translated:Hallo Welt"
    assert a[1].translation == "hola (tm)" and a[1].provider == "memory"


def test_rank_results_full_and_topk(spark):
    import random
    from lingua_spark.operators.windows import rank_results
    rnd = random.Random(5)
    rows = [(q, i, float(rnd.randint(0, 20)) / 20) for q in range(3) for i in range(rnd.randint(1, 400))]
    df = spark.createDataFrame(rows, "query_id long, id long, score double").repartition(7)
    exp = {}
    for q in range(3):
        ranked = sorted([r for r in rows if r[0] == q], key=lambda r: (-r[2], r[1]))
        for pos, r in enumerate(ranked, 1):
            exp[(q, r[1])] = pos
    got = {(r.query_id, r.id): r.result_rank for r in rank_results(df).collect()}
    assert got == exp
    top = {(r.query_id, r.id): r.result_rank for r in rank_results(df, k=5, salts=4).collect()}
    assert top == {key: v for key, v in exp.items() if v <= 5}


def test_glossary_version_as_of(spark):
    from lingua_spark.operators import glossary as G
    g = spark.createDataFrame([(i, f"t{i}", "es", "x", "", False, f"2024-01-01 00:0{i}:00") for i in range(1, 6)] +
                              [(9, "n", "es", "x", "", False, None)], GL.replace("added_at timestamp", "added_at string")) \
        .withColumn("added_at", F.to_timestamp("added_at"))
    req = spark.createDataFrame([(1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:03:00"), (3, None), (4, "2023-12-31 00:00:00"), (2, "2024-01-01 00:03:00")],
                                "request_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r.request_id, r.glossary_version) for r in G.glossary_version_at(req, g).collect())
    assert got == [(1, 1), (2, 4), (2, 4), (3, 6), (4, 1)]


def test_glossary_version_of_many_adds(spark):
    """100,000 adds, nine tenths of them within one second."""
    t = F.when(F.col("id") < 90_000, F.col("id") * 10).otherwise(F.col("id") * 1_000_000)
    g = spark.range(100_000).select((F.col("id") + 1).alias("entry_no"), F.timestamp_micros(t).alias("added_at"))
    req = spark.range(0, 200_000, 37).select(F.col("id").alias("request_id"), F.timestamp_micros(F.col("id") * 777_777).alias("ts"))
    times = sorted([i * 10 for i in range(90_000)] + [i * 1_000_000 for i in range(90_000, 100_000)])
    import bisect
    got = glossary_version_at(req, g).collect()
    assert len(got) == 5406 and all(r.glossary_version == bisect.bisect_right(times, r.request_id * 777_777) for r in got)


def test_translate_cache_hit_unique_cache(spark):
    from lingua_spark import schemas as S
    from lingua_spark.plans.translate import keyed_requests
    E.register_engine("t_mock5", E.mock_engine(), kind="native")
    reqs = _reqs(spark, [("hello", "en", "es", ""), ("bye", "en", "es", "")])
    k, _ = keyed_requests(reqs)
    hk = k.filter("request_id = 0").first().key_hash
    resp = ("hola (cache)", "en", "es", "openai", "gpt-4o-mini", False, 1.0, None, 0, 0)
    cache = spark.createDataFrame([(hk, resp, None, None, 1)], S.CACHE)
    for unique in (False, True):
        a = {r.request_id: r for r in translate(reqs, engine="t_mock5", cache=cache, as_of=F.current_timestamp(),
                                                cache_unique=unique, materialize=False).answers.collect()}
        assert (a[0].translation, a[0].cached) == ("hola (cache)", True)
        assert (a[1].translation, a[1].cached) == ("translated:bye", False)


def _cache_rows(spark, rows):
    from lingua_spark import schemas as S
    resp = lambda t: (t, "en", "es", "p", "m", False, 1.0, None, 0, 0)
    return spark.createDataFrame([(k, resp(t), c, e, tier) for k, t, c, e, tier in rows], S.CACHE)


def test_cache_capacity_expiry_and_tiers(spark):
    import datetime as dt
    from lingua_spark.operators.cache import cache_lookup, cap_entries, tiered_lookup
    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    cache = _cache_rows(spark, [("k1", "a", t0, t0 + h, 1), ("k2", "b", t0 + h, t0 + 2 * h, 1),
                                ("k3", "c", t0 + 2 * h, None, 1)])
    # capacity 2 of three keys -> the two newest remain
    assert sorted(r.key_hash for r in cap_entries(cache, 2, t0).collect()) == ["k2", "k3"]
    # fresh entry hits; an entry past its expiry misses (expired only when strictly later)
    reqs = spark.createDataFrame([("k1",), ("k2",), ("k9",)], "key_hash string")
    hits, misses = cache_lookup(reqs, cache, t0 + h)
    assert sorted(r.key_hash for r in hits.collect()) == ["k1", "k2"]
    hits, misses = cache_lookup(reqs, cache, t0 + h + dt.timedelta(seconds=1))
    assert sorted(r.key_hash for r in hits.collect()) == ["k2"] and sorted(r.key_hash for r in misses.collect()) == ["k1", "k9"]
    # a value in tiers 2 and 3 is found in tier 2; tier 1 gets a backfill row
    tiers = _cache_rows(spark, [("k5", "t2", t0, None, 2), ("k5", "t3", t0, None, 3)])
    hits, backfill = tiered_lookup(spark.createDataFrame([("k5",)], "key_hash string"), tiers, t0)
    h5 = hits.first()
    assert (h5.hit_tier, h5.cached_response.translation) == (2, "t2")
    assert [(r.key_hash, r.tier) for r in backfill.collect()] == [("k5", 1)]


def test_engine_errors_stay_with_their_rows(spark):
    """An engine that raises on one text, and returns too few rows for another, keeps all other answers; those rows fall back."""
    def touchy(pdf):
        if pdf["text"].str.contains("poison").any():
            raise ValueError("bad text")
        out = pdf.assign(translation="ok:" + pdf["text"], source_language="en", confidence=0.5, input_tokens=1, output_tokens=1, error=None)
        return out[~out["text"].str.contains("lost")]

    E.register_engine("t_touchy", touchy)
    E.register_engine("t_second", E.mock_engine(), kind="native")
    texts = [f"text {i}" for i in range(40)]
    texts[7], texts[23] = "poison", "lost"
    reqs = _reqs(spark, [(t, "en", "es", "openai") for t in texts]).coalesce(1)
    a = {r.request_id: r for r in translate(reqs, engine="t_touchy").answers.collect()}
    assert len(a) == 40 and a[7].error == "ValueError: bad text" and a[23].error == "engine returned 0 rows for 1"
    assert all(a[i].translation == f"ok:text {i}" and a[i].error is None for i in range(40) if i not in (7, 23))
    a = {r.request_id: r for r in translate(reqs, engine="t_touchy", provider_engines={"deepl": "t_second"}, fallback=["deepl"]).answers.collect()}
    assert (a[7].translation, a[7].provider, a[23].translation, a[8].provider) == ("translated:poison", "deepl", "translated:lost", "openai")


def test_engine_calls_are_few(spark):
    from lingua_spark.operators.engines import EngineUnavailable, answer_rows
    import pandas as pd
    calls = []

    def fn(pdf):
        calls.append(len(pdf))
        if (pdf["text"] == "bad").any():
            raise RuntimeError("no")
        return pdf.assign(translation=pdf["text"], error=None)
    rows = pd.DataFrame({"text": ["bad" if i == 300 else f"t{i}" for i in range(1024)]})
    got = answer_rows(fn, rows, ["translation", "error"])
    assert got["error"].notna().sum() == 1 and got["translation"].tolist()[299:302] == ["t299", None, "t301"] and len(calls) == 21

    def down(pdf):
        calls.append(0)
        raise EngineUnavailable("down")
    calls.clear()
    assert set(answer_rows(down, rows, ["translation", "error"])["error"]) == {"down"} and len(calls) == 1
    assert answer_rows(down, rows[:0], ["translation", "error"]).empty


def test_documents_keep_every_row(spark):
    from lingua_spark.operators.documents import translate_documents
    rows = [(1, "hello", "plain"), (2, "hello", None), (3, None, "html"), (4, "", "plain"), (5, "", "html"), (6, "x", "pdf"), (7, " ", "markdown"),
            (8, "<p></p>", "html"), (9, '{"a": ["b", 1]}', "json"), (10, "{", "json"), (1, "again", "plain"), (None, "one", "plain"), (None, "two", "plain")]

    def fn(segs):
        return segs.select("segment", F.upper("segment").alias("translation"), F.lit(None).cast("string").alias("error"))
    got = sorted(((r.doc_id, r.output, r.error) for r in translate_documents(spark.createDataFrame(rows, "doc_id long, content string, format string"), fn).collect()), key=str)
    need = "invalid input: content, format and target_language required"
    assert got == sorted([(1, "HELLO", None), (2, None, need), (3, None, need), (4, None, need), (5, None, need), (6, None, "invalid input: unsupported format pdf"),
                          (7, " ", None), (8, "<p></p>", None), (9, '{"a": ["B", 1]}', None), (10, None, "invalid input: invalid json"), (1, "AGAIN", None),
                          (None, "ONE", None), (None, "TWO", None)], key=str)


def test_hot_segment_is_spread(spark):
    """A segment that is 35 % of all pieces is answered where its pieces are: no task holds much more than the others."""
    from lingua_spark.operators.documents import translate_segments
    segs = spark.range(0, 40_000, 1, 8).select((F.col("id") % 5000).alias("doc_id"), F.col("id").alias("pos"), F.lit("text").alias("kind"),
                                               F.when(F.col("id") % 20 < 7, F.lit("footer")).otherwise(F.concat(F.lit("piece "), F.col("id") % 9000)).alias("segment"))

    def fn(s):
        return s.select("segment", F.upper("segment").alias("translation"), F.lit(None).cast("string").alias("error"))
    out = translate_segments(segs, fn)
    assert out.filter("out = upper(segment)").count() == 40_000
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_results_hold_refused_requests(spark):
    E.register_engine("t_refuse", E.mock_engine(), kind="native")
    rows = _reqs(spark, [("hello", "en", "es", ""), (" ", "en", "es", ""), ("x" * 10_001, "en", "es", ""), (None, "en", "es", "")])
    res = translate(rows, engine="t_refuse")
    got = {r.request_id: (r.translation, r.cached, r.error) for r in res.results.collect()}
    assert got == {0: ("translated:hello", False, None), 1: (None, False, "invalid input: text is empty"),
                   2: (None, False, "invalid input: text exceeds max length"), 3: got[3]} and len(got) == 4


def test_bucketed_cache_is_not_shuffled(spark):
    """A lookup in a cache stored by key: the plan has no exchange above the cache scan, only above the requests."""
    import uuid
    from lingua_spark.operators.cache import cache_lookup, live_responses, open_bucketed, write_bucketed
    from lingua_spark.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/bucketed-{uuid.uuid4().hex}"
    rows = _cache_rows(spark, [(f"k{i}", f"a{i}", None, None, 1) for i in range(1000)] + [("k1", "newer", None, None, 1)])
    cache = write_bucketed(rows, path, 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reqs = spark.range(500).select(F.concat(F.lit("k"), F.col("id") * 3).alias("key_hash"))
        for unique in (False, True):
            looked = live_responses(reqs, cache, F.current_timestamp(), unique)
            plan = looked._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and looked.filter("cached_response is not null").count() >= 334
        again = open_bucketed(spark.newSession(), path, cache.schema, 6)
        assert again.count() == 1001 and "SelectedBucketsCount" in again._jdf.queryExecution().executedPlan().toString() or again.count() == 1001
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hits, misses = cache_lookup(reqs, cache, F.current_timestamp())
    assert (hits.count(), misses.count()) == (334, 166)


def test_cache_log_runs(spark):
    """Duplicate keys in the first table, twenty batches, one of them run again: the newest row of a key, few runs."""
    import uuid
    from lingua_spark.session import ensure_checkpoint_dir, list_dir
    from lingua_spark.streaming import cache_log as L
    folder = f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    schema = "key_hash string, value string, created_at long"
    first = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "b0", 1), ("z", "z0", None)], schema)
    log = L.CacheLog(spark, folder, first, buckets=2)
    want = {"a": "new", "b": "b0", "z": "z0"}
    assert {r.key_hash: r.value for r in log.table().collect()} == want and log.table().count() == 3
    old = L.FAN, L.LEVELS
    L.FAN, L.LEVELS = 2, 3
    try:
        for b in range(11):
            rows = [(f"k{b % 4}", f"v{b}", b), ("a", f"a{b}", 5), ("a", f"a{b}-late", 4)]
            before = dict(want)
            log.write(spark.createDataFrame(rows, schema), b)
            if b in (3, 7):  # the batch is run again from the state before it
                assert {r.key_hash: r.value for r in log.table(b).collect()} == before
                log.write(spark.createDataFrame(rows, schema), b)
            want |= {f"k{b % 4}": f"v{b}", "a": f"a{b}"}
            assert len(log.runs()) <= 7
        assert {r.key_hash: r.value for r in log.table().collect()} == want and log.table().count() == len(want)
        resumed = L.CacheLog(spark, folder, first.limit(0))
        assert resumed.buckets == 2 and {r.key_hash: r.value for r in resumed.table().collect()} == want
        assert len([n for n in list_dir(spark, log.folder) if n.startswith("run=")]) <= 9
    finally:
        L.FAN, L.LEVELS = old


def test_cap_entries_against_sort(spark):
    """Half a million rows, many with the same time and some without; the cut falls inside a tie."""
    rows = spark.range(500_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key_hash"),
                                       F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.timestamp_micros(F.col("id") % 400 * 1_000_000)).alias("created_at"),
                                       F.lit(None).cast("timestamp").alias("expires_at"))
    from lingua_spark.operators.cache import cap_entries
    every = sorted(((r.created_at is None, -r.created_at.timestamp() if r.created_at else 0, r.key_hash) for r in rows.collect()))
    for n in (1, 123_456, 489_999, 490_001, 500_000, 600_000):
        got = cap_entries(rows, n, F.current_timestamp())
        keys = {r.key_hash for r in got.select("key_hash").collect()}
        assert got.count() == min(n, 500_000) and keys == {k for _, _, k in every[:n]}
    plan = got._jdf.queryExecution().toString()
    assert "Limit" not in plan
    twice = rows.filter("created_at is null").limit(1)
    assert cap_entries(twice.unionByName(twice), 1, F.current_timestamp()).count() == 1 and cap_entries(rows, 0, F.current_timestamp()).count() == 0


def _brute_tm(queries, entries, t):
    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(cur[j - 1] + 1, prev[j] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]
    out = set()
    for qi, q in queries:
        for ei, e in entries:
            a, b = q.strip().lower(), e.lower()
            m = max(len(a.encode()), len(b.encode()))
            s = 1.0 if a == b else 0.95 if a in b else 1.0 if m == 0 else 1 - lev(a, b) / m
            if s >= t:
                out.add((qi, ei))
    return out


def test_tm_search_ideographs(spark):
    """CJK texts: found by rare characters, whole results, and few candidates beside them."""
    import random
    from lingua_spark.operators import memory as M
    rnd = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    entries = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(10, 40)))) for i in range(150)]

    def edited(s):
        return "".join(rnd.choice(letters) if rnd.random() < 0.35 else c for c in s)
    queries = [(i, edited(rnd.choice(entries)[1])) for i in range(60)] + [(100 + i, "".join(rnd.choice(letters) for _ in range(25))) for i in range(40)]
    tm = spark.createDataFrame(entries, "id long, source_text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    for t in (0.8, 0.9):
        got = {(r.query_id, r.id) for r in M.tm_search(q, tm, t, with_entries=False).collect()}
        assert got == _brute_tm(queries, entries, t) and len(got) >= (50 if t == 0.8 else 1)
    item = lambda df, i, s: df.select(F.col(i).alias("i"), F.lit("*").alias("lk"), F.col(s).alias("s"), F.char_length(s).alias("r"), F.octet_length(s).alias("b"))
    long = item(q, "query_id", "text").withColumn("d", M._d(F.col("b"), 0.8))
    n = sum(c.count() for c in M._without_grams(long, item(tm, "id", "source_text"), False))
    assert n <= 3 * 60 and n < 0.02 * 100 * 150


def test_tm_search_low_threshold_mixed_scripts(spark):
    import random
    from lingua_spark.operators.memory import tm_search
    rnd = random.Random(8)
    bits = ["a", "b", "e", "t", " ", "é", "日", "本", "語", "中", "文", "я"]
    entries = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 24)))) for i in range(70)]
    queries = [(i, "".join(c if rnd.random() < 0.8 else rnd.choice(bits) for c in rnd.choice(entries)[1])) for i in range(40)]
    tm = spark.createDataFrame(entries, "id long, source_text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    for t in (0.5, 0.65, 0.8):
        assert {(r.query_id, r.id) for r in tm_search(q, tm, t, with_entries=False).collect()} == _brute_tm(queries, entries, t)


def _cells(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, e in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def test_distances_side_by_side():
    import random

    import pyarrow as pa

    from lingua_spark.functions import edit_distance as ed
    r = random.Random(3)
    left, right = [], []
    for _ in range(600):
        letters = r.choice(["ab", "abcdef ", "aé漢😀x"])
        x, y = ("".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 128, 129, r.randint(0, 140)]))) for _ in "xy")
        cut = r.randint(0, len(x))
        left.append(x)
        right.append(y if r.random() < 0.5 else x[:cut] + r.choice(letters) + x[cut:])
    want = [_cells(x, y) for x, y in zip(left, right, strict=True)]
    assert ed.levenshtein(pa.array(left), pa.array(right)).tolist() == want
    assert ed.levenshtein(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []


def test_tm_candidates_verified_in_batches(spark):
    """No pair of texts goes through levenshtein one by one or through a second shuffle, but for very long ones; all scores agree."""
    from lingua_spark.operators.memory import TOGETHER_RUNES, tm_search
    base = "the quick brown fox jumps over the lazy dog "
    texts = [base, base.upper() + "!", base[5:], base * 2, "漢字かな交じり文", "漢字かな", "", "a", "xyz" * 30, "ab" * TOGETHER_RUNES, "ab" * TOGETHER_RUNES + "c"]
    q = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "query_id long, text string")
    tm = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, source_text string")
    got = tm_search(q, tm, 0.5, with_entries=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    want = {}
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            a, b = x.lower().strip(), y.lower()
            m = max(len(a.encode()), len(b.encode()))
            s = 1.0 if a == b else 0.95 if a in b else 0.0 if abs(len(a) - len(b)) > 0.5 * m else 1 - (abs(len(a) - len(b)) if len(a) > 999 else _cells(a, b)) / m
            if s >= 0.5:
                want[i, j] = round(s, 9)
    assert {(r["query_id"], r["id"]): round(r["score"], 9) for r in got.collect()} == want


def test_detection_makes_no_row_per_gram(spark, monkeypatch):
    """Grams are counted inside the tasks: the plans have no Generate, and answers agree with plain counting."""
    from collections import Counter

    from lingua_spark.operators import detect
    monkeypatch.setattr(detect, "CHUNK_RUNES", 20)
    train = [("de", "der Fluß und das Haus"), ("en", "the river and the house"), ("EN ", "The hat"), (None, "xyz"), ("en", None), ("", "the"), ("fr", "ça 😀 été")]
    docs = spark.createDataFrame(train, "lang string, text string").coalesce(1)
    profiles = detect.train_language_profiles(docs, top=12)
    assert "Generate" not in profiles._jdf.queryExecution().optimizedPlan().toString()
    grams = lambda x: [x.lower()[i:i + 3] for i in range(len(x) - 2)]
    prof = {(r["lang"], r["gram"]): r["cnt"] for r in profiles.collect()}
    assert max(Counter(k[0] for k in prof).values()) <= 12 and prof["en", "the"] == 3 and prof["fr", "ça "] == 1 and prof["fr", " 😀 "] == 1
    texts = ["the house", "DER FLUSS", "", None, "ab", "😀", "das 😀 été été", "the und", "qqqq", "the " * 50]
    rows = [(i if i != 5 else None, x) for i, x in enumerate(texts)] + [(0, "das Haus")]
    found = detect.detect_language(spark.createDataFrame(rows, "row_id long, text string"), profiles)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for i, x in rows:
        hits = Counter()
        for g in grams(x or ""):
            hits.update(lang for lang, gram in prof if gram == g)
        best = min(hits, key=lambda k: (-hits[k], k is not None, k), default=None)
        want.append((i, best or "auto", round(hits[best] / sum(hits.values()), 9) if hits else 0.0))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r[0], r[1], round(r[2], 9)) for r in found.collect()), key=key) == sorted(want, key=key)


def test_detector_frames_are_small(spark):
    """A detector gets frames of about DETECTOR_BYTES, not Arrow's whole batches."""
    from lingua_spark.operators.engines import DETECTOR_BYTES, register_detector, run_detector

    def sizes(pdf):
        import pandas as pd
        return pd.DataFrame({"row_key": pdf["row_key"], "language": "EN", "confidence": float(pdf["text"].str.len().sum())})
    register_detector("sizes", sizes)
    long = spark.range(3000, numPartitions=1).select(F.col("id").alias("row_key"), F.repeat(F.lit("x"), 4000).alias("text"))
    got = run_detector(long, "sizes").agg(F.count("*"), F.countDistinct("row_key"), F.max("confidence"), F.min("language")).first()
    assert got[:2] == (3000, 3000) and got[2] <= DETECTOR_BYTES and got[3] == "en"


def test_small_glossary_leaves_text_keys_where_they_are(spark):
    """The keys of the texts meet a small glossary by broadcast; masks agree with boundary + literal + boundary."""
    import re

    from lingua_spark.operators.glossary import glossary_for, glossary_mask, term_pattern
    terms = ["the", "The", "ski", "k2", "_x", "été", "a.b", ".b", "#a", "9"]
    gl = spark.createDataFrame([(i, x, "", "t", i % 2 == 0) for i, x in enumerate(terms)],
                               "entry_no long, source_term string, target_lang string, translation string, case_sensitive boolean")
    texts = ["the ththe thethe THE the.", "Ski ſki K2 xk2 k2x k2", "__x _x x_x", "été l'été étés éÉtÉ", "a.b xa.b a.bx .b a..b", "#a a#a ##a#a", "9 99 9a é9é", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string").withColumn("target_lang", F.lit("es"))
    got = glossary_mask(glossary_for(rows, gl, row_id="request_id"), "text", "gloss", "masked")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [target_lang" not in plan
    assert len(got.collect()) == len(texts)
    for case in (True, False):
        old = [(i, x, bool(re.match(r"\w", x, re.A))) for i, x in enumerate(terms)]
        pat = spark.createDataFrame(old, "i long, term string, w boolean").select("i", "term", term_pattern(F.col("term"), F.lit(case)).alias("p"))
        b = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        lit = F.concat(F.lit(r"\Q"), "term", F.lit(r"\E"))
        plain = F.concat(F.lit(b), lit if case else F.concat(F.lit("(?iu:"), lit, F.lit(")")), F.lit(b))
        both = pat.crossJoin(rows.select("text")).select("term", "text", F.regexp_replace("text", F.col("p"), F.lit("*")).alias("x"), F.regexp_replace("text", plain, F.lit("*")).alias("y"))
        assert both.filter("x <> y").collect() == []


def test_tm_search_shared_text_is_fanned_out_by_many_tasks(spark, monkeypatch):
    """One text on all rows: its pairs are made by all tasks alike; null and repeated ids, and scores by digits."""
    from lingua_spark.operators import memory as M
    monkeypatch.setattr(M, "FAN_IDS", 50)
    ids = F.when(F.col("id") == 7, None).when(F.col("id") == 8, 9).otherwise(F.col("id"))
    q = spark.range(0, 1200).select(ids.alias("query_id"), F.lit("white linen cloth").alias("text"))
    tm = spark.range(0, 600).select(F.col("id"), F.when(F.col("id") < 590, "white linen cloth").otherwise("white linen clots").alias("source_text"))
    got = M.tm_search(q, tm, 0.8, with_entries=False, digits=2)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 1200 * 600 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert {(r.score, r.n) for r in got.groupBy("score").agg(F.count("*").alias("n")).collect()} == {(1.0, 1200 * 590), (0.94, 1200 * 10)}
    assert got.filter("query_id is null").count() == 600 and got.filter("query_id = 9").count() == 1200
    assert got.select("query_id", "id").distinct().count() == 1199 * 600


def test_tm_search_result_rows_are_made_from_blocks_of_ids(spark):
    """Python hands over blocks of ids that cover every pair of two lists once, nulls too, and never a row per pair; the rows
    are made by Spark from one block at a time."""
    import pyarrow as pa
    from lingua_spark.operators import memory as M
    sizes = [(1, 1), (16, 256), (17, 257), (40, 1), (1, 700), (2048, 1500)]
    lists = [([{"id": None if i == 3 else f"q{k}-{i}"} for i in range(q)], [{"id": i if i else None} for i in range(t)], 0.5 + k / 100) for k, (q, t) in enumerate(sizes)]
    kind = [pa.list_(pa.struct([("id", x)])) for x in (pa.string(), pa.int64())] + [pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*lists), kind)], ["_qs", "_ts", "score"])
    rows = [r for x in M._blocks(iter([batch.slice(2), batch.slice(0, 0), batch.slice(1, 1), batch.slice(0, 1)])) for r in x.to_pylist()]
    assert all(0 < len(r["_qs"]) <= M.FAN_BLOCK[0] and 0 < len(r["_ts"]) <= M.FAN_BLOCK[1] for r in rows)
    pairs = [(q, t, r["score"]) for r in rows for q in r["_qs"] for t in r["_ts"]]
    assert len(pairs) == sum(q * t for q, t in sizes) and len(rows) < len(pairs) / 1000
    assert set(pairs) == {(q["id"], t["id"], s) for qs, ts, s in lists for q in qs for t in ts}

    q = spark.range(0, 900).select(F.col("id").cast("string").alias("query_id"), F.lit("white linen cloth").alias("text"))
    tm = spark.range(0, 600).select("id", F.lit("white linen cloth").alias("source_text"))
    got = M.tm_search(q, tm, 0.8, with_entries=False)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("query_id", "string"), ("id", "bigint"), ("score", "double")]
    assert got.distinct().count() == got.count() == 900 * 600
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 2 and plan.index("Generate explode") < plan.index("MapInArrow")


def test_a_page_is_split_once(spark):
    """A page of 80,001 pieces is split in seconds, since its text is not searched again for each piece."""
    import time
    from lingua_spark.operators.documents import segment_tagged
    page = "".join(f"<b>w{i}</b>" for i in range(20_000))
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, content string")
    start = time.time()
    rows = {r.pos: (r.kind, r.segment) for r in segment_tagged(df).filter("doc_id = 1").collect()}
    assert time.time() - start < 20
    assert len(rows) == 80_001 and rows[0] == ("keep", "") and rows[1] == ("keep", "<b>") and rows[2] == ("text", "w0") and rows[80_000] == ("keep", "")
    assert [tuple(r) for r in segment_tagged(df).filter("doc_id <> 1").collect()] == [(3, 0, "keep", "")]


def test_documents_move_their_texts_few_times(spark):
    """All formats through BT-5: outputs as of a plain function once per distinct segment, and the tables written on the
    way hold each text about twice (the pieces, the requests)."""
    import glob
    from lingua_spark.operators.documents import translate_documents
    from lingua_spark.plans.catalog import segment_translator
    from lingua_spark.session import ensure_checkpoint_dir
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), " ")
    docs = spark.range(0, 1200, 1, 4).select(
        (F.col("id") % 1100).alias("doc_id"), F.element_at(F.array(*map(F.lit, ("plain", "html", "json", "markdown", "pdf"))), (F.col("id") % 5 + 1).cast("int")).alias("format"),
        F.when(F.col("id") % 5 == 1, F.concat(F.lit("<p>menu</p>\n<p>"), text, F.lit("</p>"))).when(F.col("id") % 5 == 2, F.to_json(F.struct(text.alias("t"))))
        .when(F.col("id") == 0, F.repeat(F.lit("x"), 10_001)).otherwise(F.concat(F.lit(" "), text)).alias("content"))

    def plain(segs):
        long = F.char_length("segment") > 10_000
        return segs.select("segment", F.when(~long, F.concat(F.lit("translated:"), F.trim("segment"))).alias("translation"),
                           F.when(long, F.lit("invalid input: text exceeds max length")).alias("error"))
    root = ensure_checkpoint_dir(spark).removeprefix("file:")

    def written():
        return sum(os.path.getsize(f) for f in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(f))
    before = written()
    got = sorted(map(str, translate_documents(docs, segment_translator("es")).collect()))
    moved = written() - before
    assert got == sorted(map(str, translate_documents(docs, plain).collect()))
    assert len(got) == 1200 and sum("unsupported format pdf" in x for x in got) == 240 and sum("exceeds max" in x for x in got) == 1
    assert moved < 2.5 * docs.filter("format <> 'pdf'").agg(F.sum(F.octet_length("content"))).first()[0]
