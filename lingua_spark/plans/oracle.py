"""DuckDB oracle SQL for the registered queries (same column names as plans/catalog.py)."""

from __future__ import annotations

from lingua_spark.plans import sqlfrag as Q

ORACLE: dict[str, str] = {}


def sql(name: str, body: str, ctes: tuple = ()):
    head = Q.derived_ctes(set(ctes))
    ORACLE[name] = (f"WITH {head}\n{body}" if head else body).strip()


sql("fn1_normalize_text", f"""
SELECT doc_id, CAST(length(n) AS BIGINT) AS norm_len, sha256(n) AS norm_hash
FROM (SELECT doc_id, {Q.norm('text')} AS n FROM documents)""")

sql("fn2_truncate_text", """
SELECT doc_id, CAST(length(t) AS BIGINT) AS trunc_len, sha256(t) AS trunc_hash
FROM (SELECT doc_id, substring(text, 1, 100) AS t FROM documents)""")

sql("fn3_estimate_tokens", f"SELECT conv_id, turn, {Q.tokens('text')} AS tokens FROM conversations")

sql("fn4_split_paragraphs", f"""
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paragraphs, sha256(array_to_string(p, '|')) AS paragraphs_hash
FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10) || ' ' || chr(10) || chr(10)), chr(10) || chr(10)),
      lambda x: {Q.trim_u('x')}), lambda x: x <> '') AS p FROM documents)""")

sql("fn5_is_mostly_latin", """
SELECT doc_id, CASE WHEN letters = 0 THEN true ELSE latin / letters > 0.5 END AS mostly_latin
FROM (SELECT doc_id, len(regexp_extract_all(text, '\\p{Latin}')) AS latin,
             len(regexp_extract_all(text, '\\p{L}')) AS letters FROM documents)""")

sql("fn6_normalize_language", f"""
SELECT doc_id, raw_code, {Q.lang('raw_code')} AS code
FROM (SELECT doc_id, '  ' || upper(lang) || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '-' || upper(source)
      ELSE '-br ' END AS raw_code FROM documents)""")

KEYED = f"""
valid AS (
  SELECT r.*, {Q.norm('text')} AS ntext FROM requests_d r),
keyed AS (
  SELECT request_id, ts, ntext AS text, {Q.lang('source_lang')} AS source_lang, {Q.lang('target_lang')} AS target_lang,
         {Q.first_nonempty('valid.provider', "'openai'")} AS provider_name, valid.model AS model_in,
         {Q.first_nonempty('valid.model', 'p.default_model')} AS model, context, tone, use_cache, (SELECT v FROM gl_version) AS glossary_version
  FROM valid LEFT JOIN providers_d p ON p.provider = {Q.first_nonempty('valid.provider', "'openai'")}
  WHERE ntext <> '' AND length(ntext) <= 10000),
keyed2 AS (
  SELECT *, {Q.key('text', 'source_lang', 'target_lang', 'provider_name', 'model', 'context', 'tone', 'glossary_version')} AS key_hash
  FROM keyed)"""

sql("fn7_cache_key", f""", {KEYED.strip()}
SELECT request_id, key_hash FROM keyed2""".replace("WITH ", "WITH ", 1), ("requests_d", "gl_version", "providers_d"))

sql("fn8_mask_for_log", f"""
SELECT conv_id, turn,
  CASE WHEN length(n) <= 8 THEN '***' ELSE substring(n, 1, 3) || '...' || substring(n, length(n) - 2, 3) END AS masked,
  CASE WHEN length(role) <= 8 THEN '***' ELSE substring(role, 1, 3) || '...' || substring(role, length(role) - 2, 3) END AS masked_role
FROM (SELECT conv_id, turn, role, {Q.norm('text')} AS n FROM conversations)""")

DURATIONS = """
durations AS (
  SELECT event_id, CASE
    WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) || 'h' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'm'
    WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || 's'
    WHEN event_type = 'purchase' THEN '-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'ms' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || 'us'
    WHEN event_type = 'signup' THEN CASE WHEN user_id % 2 = 0 THEN '' ELSE '0' END
    ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'x' END AS duration
  FROM events)"""

sql("fn9_ttl_seconds", f"""WITH {DURATIONS.strip()},
toks AS (
  SELECT event_id, duration, regexp_extract_all(duration, '((?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:ns|us|µs|μs|ms|h|m|s))', 1) AS t
  FROM durations),
secs AS (
  SELECT event_id, duration, list_sum(list_transform(t, lambda x:
      CAST(regexp_extract(x, '^([0-9.]+)', 1) AS DOUBLE) *
      CASE regexp_extract(x, '([a-zµμ]+)$', 1) WHEN 'h' THEN 3600.0 WHEN 'm' THEN 60.0 WHEN 's' THEN 1.0
           WHEN 'ms' THEN 0.001 WHEN 'ns' THEN 1e-9 ELSE 1e-6 END)) AS total
  FROM toks)
SELECT event_id, duration, round(CASE
    WHEN duration IS NULL OR duration IN ('', '0') THEN 60.0
    WHEN regexp_full_match(duration, '[+-]?(?:(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:ns|us|µs|μs|ms|h|m|s))+')
      THEN CASE WHEN starts_with(duration, '-') THEN -coalesce(total, 0.0) ELSE coalesce(total, 0.0) END
    ELSE 60.0 END, 6) AS ttl_s
FROM secs""")

sql("fn10_first_nonempty", f"""
SELECT doc_id, {Q.first_nonempty("CASE WHEN lang = 'en' THEN '' ELSE lang END", "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END", "'none'")} AS pick,
       {Q.first_nonempty("''", "CAST(NULL AS VARCHAR)")} AS empty_pick
FROM documents""")

sql("fn11_validate_requests", f"""
SELECT request_id, CAST(length(n) AS BIGINT) AS norm_len,
  CASE WHEN n = '' THEN 'invalid input: text is empty'
       WHEN length(n) > 10000 THEN 'invalid input: text exceeds max length' END AS error
FROM (SELECT request_id, {Q.norm('text')} AS n FROM requests_d)""", ("requests_d",))

# BT-5 flagship ------------------------------------------------------------------------
GLOSS_BY_TARGET = f"""
targets AS (SELECT DISTINCT target_lang FROM keyed2),
gl_keys AS (SELECT target_lang, target_lang AS gl_key FROM targets UNION ALL SELECT target_lang, '' FROM targets),
gl_ranked AS (
  SELECT k.target_lang, g.source_term AS term, g.translation,
         CAST(row_number() OVER (PARTITION BY k.target_lang ORDER BY strlen(g.source_term) DESC, g.entry_no) - 1 AS INTEGER) AS rank,
         {Q.pattern('g.source_term', 'g.case_sensitive')} AS pattern
  FROM gl_keys k JOIN glossary_d g ON g.target_lang = k.gl_key),
gl_lists AS (
  SELECT target_lang, list(struct_pack(p := pattern, ph := '__TERM_' || CAST(rank AS VARCHAR) || '__', tr := translation,
         term := term, rank := rank) ORDER BY rank) AS gl
  FROM gl_ranked GROUP BY target_lang)"""

CACHE_D = f"""
cache_d AS (
  SELECT k.key_hash, 'cached:' || CAST(k.request_id AS VARCHAR) AS c_translation, k.source_lang AS c_source,
         k.target_lang AS c_target, k.provider_name AS c_provider, k.model AS c_model, 1.0 AS c_confidence,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(k.request_id AS BIGINT)) AS created_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(k.request_id AS BIGINT)) + to_hours(CASE WHEN l.quality = 1 THEN 24 ELSE 1 END) AS expires_at,
         1 + l.toxic AS tier, k.request_id
  FROM keyed2 k JOIN labels l ON l.doc_id = k.request_id),
cache_live AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY created_at DESC) AS rn
                 FROM cache_d WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-01 06:00:00') WHERE rn = 1)"""

# requests that validation refuses: a row with the error alone
REFUSED = """
SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL,
       CASE WHEN ntext = '' THEN 'invalid input: text is empty' ELSE 'invalid input: text exceeds max length' END
FROM valid WHERE ntext = '' OR length(ntext) > 10000"""

sql("bt5_translate", f""", {KEYED.strip()},
{CACHE_D.strip()},
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY ts NULLS FIRST, request_id) AS rn FROM keyed2)
  WHERE rn = 1),
{GLOSS_BY_TARGET.strip()},
engine AS (
  SELECT f.key_hash, f.source_lang, f.target_lang, f.provider_name, f.model, coalesce(g.gl, []) AS gl,
         'translated:' || list_reduce(coalesce(g.gl, []), lambda acc, e: regexp_replace(acc, e.p, e.ph, 'g'), f.text) AS raw
  FROM firsts f LEFT JOIN gl_lists g ON g.target_lang = f.target_lang
  WHERE f.key_hash NOT IN (SELECT key_hash FROM cache_live)),
by_key AS (
  SELECT key_hash, list_reduce(gl, lambda acc, e: replace(acc, e.ph, e.tr), raw) AS translation,
         source_lang AS source_language, target_lang AS target_language, provider_name AS provider, model,
         false AS hit, 0.9 AS confidence, CAST(NULL AS VARCHAR) AS error
  FROM engine
  UNION ALL
  SELECT key_hash, c_translation, c_source, c_target, c_provider, c_model, true, c_confidence, NULL
  FROM cache_live WHERE key_hash IN (SELECT key_hash FROM firsts))
SELECT k.request_id, k.key_hash, sha256(b.translation) AS translation_hash, b.source_language, b.target_language,
       b.provider, b.model, b.hit OR k.rn > 1 AS cached, round(b.confidence, 6) AS confidence,
       {Q.tokens('b.translation')} AS est_output_tokens, b.error
FROM (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY ts NULLS FIRST, request_id) AS rn FROM keyed2) k
JOIN by_key b ON b.key_hash = k.key_hash
UNION ALL
{REFUSED.strip()}""", ("requests_d", "gl_version", "providers_d", "glossary_d"))

# glossary ------------------------------------------------------------------------------
VALID = f"""
vreq AS (
  SELECT request_id, ts, {Q.norm('text')} AS text, source_lang, {Q.lang('target_lang')} AS target_lang,
         provider, model, context, tone, use_cache, alternatives
  FROM requests_d WHERE {Q.norm('text')} <> '' AND length({Q.norm('text')}) <= 10000)"""

GLOSS_RANK = f"""
gl_keys AS (SELECT target_lang, target_lang AS gl_key FROM targets UNION ALL SELECT target_lang, '' FROM targets),
gl_ranked AS (
  SELECT k.target_lang, g.source_term AS term, g.translation, g.entry_no,
         CAST(row_number() OVER (PARTITION BY k.target_lang ORDER BY strlen(g.source_term) DESC, g.entry_no) - 1 AS BIGINT) AS rank,
         {Q.pattern('g.source_term', 'g.case_sensitive')} AS pattern
  FROM gl_keys k JOIN glossary_d g ON g.target_lang = k.gl_key),
gl_lists AS (
  SELECT target_lang, list(struct_pack(p := pattern, ph := '__TERM_' || CAST(rank AS VARCHAR) || '__', tr := translation) ORDER BY rank) AS gl
  FROM gl_ranked GROUP BY target_lang)"""

sql("jn1_glossary_for", f""",
targets AS (SELECT DISTINCT {Q.lang('target_lang')} AS target_lang FROM requests_d),
{GLOSS_RANK.strip()}
SELECT target_lang, rank, '__TERM_' || CAST(rank AS VARCHAR) || '__' AS placeholder, term, translation FROM gl_ranked""",
    ("requests_d", "glossary_d"))

sql("jn2_glossary_mask", f""", {VALID.strip()},
targets AS (SELECT DISTINCT target_lang FROM vreq),
{GLOSS_RANK.strip()},
m AS (
  SELECT v.request_id, coalesce(g.gl, []) AS gl,
         list_reduce(coalesce(g.gl, []), lambda acc, e: regexp_replace(acc, e.p, e.ph, 'g'), v.text) AS masked
  FROM vreq v LEFT JOIN gl_lists g ON g.target_lang = v.target_lang)
SELECT request_id, sha256(masked) AS masked_hash,
       CAST(len(regexp_extract_all(masked, '__TERM_[0-9]+__')) AS BIGINT) AS n_placeholders,
       sha256(list_reduce(gl, lambda acc, e: replace(acc, e.ph, e.tr), masked)) AS restored_hash
FROM m""", ("requests_d", "glossary_d"))

sql("se1_glossary_get", """,
q AS (SELECT * FROM (VALUES ('es'), ('fr'), ('')) t(query_target))
SELECT q.query_target, g.entry_no, g.source_term, g.translation
FROM q JOIN glossary_d g ON g.target_lang IN ('', q.query_target)""", ("glossary_d",))

sql("ag7_glossary_version_at", """,
tg AS (SELECT entry_no, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(entry_no AS INTEGER)) AS added_at FROM glossary_d),
tr AS (SELECT request_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(request_id * 10 AS INTEGER)) AS ts FROM requests_d)
SELECT tr.request_id, CAST(count(tg.entry_no) AS BIGINT) AS glossary_version
FROM tr LEFT JOIN tg ON tg.added_at <= tr.ts GROUP BY tr.request_id""", ("requests_d", "glossary_d"))

sql("fn12_prepare_prompts", f""", {VALID.strip()},
pr AS (SELECT request_id, text, target_lang,
              CASE WHEN request_id % 4 = 0 THEN 'medical' ELSE '' END AS context,
              CASE WHEN request_id % 5 = 0 THEN 'formal' ELSE 'neutral' END AS tone,
              CAST(request_id % 2 AS INTEGER) AS alternatives FROM vreq),
targets AS (SELECT DISTINCT target_lang FROM pr),
{GLOSS_RANK.strip()},
m AS (
  SELECT pr.*, coalesce(g.gl, []) AS gl, coalesce(l.name, pr.target_lang) AS lname,
         list_reduce(coalesce(g.gl, []), lambda acc, e: regexp_replace(acc, e.p, e.ph, 'g'), pr.text) AS masked
  FROM pr LEFT JOIN gl_lists g ON g.target_lang = pr.target_lang LEFT JOIN languages_d l ON l.code = pr.target_lang)
SELECT request_id,
  sha256('You are a professional translator. Translate the following text accurately into ' || lname || '. ' ||
    CASE WHEN context <> '' THEN 'Context: ' || context || '. ' ELSE '' END ||
    CASE WHEN tone NOT IN ('', 'neutral') THEN 'Tone: ' || tone || '. ' ELSE '' END ||
    CASE WHEN len(gl) > 0 THEN 'Preserve the following placeholders exactly as they appear and do not translate them: '
         || array_to_string(list_transform(gl, lambda e: e.ph || ' -> ' || e.tr), '; ') || '. ' ELSE '' END ||
    'Return ONLY a JSON object with keys: translation (string), source_language (string), confidence (number 0-1).' ||
    CASE WHEN alternatives > 0 THEN ' Also include alternatives (array of strings).' ELSE '' END ||
    chr(10) || chr(10) || 'Text: ' || masked) AS prompt_hash,
  CAST(greatest(512, length(masked) * 4 + 256) AS BIGINT) AS max_tokens,
  CAST(len(gl) AS BIGINT) AS n_entries
FROM m""", ("requests_d", "glossary_d", "languages_d"))

sql("fn13_resolve_model", f""",
d AS (SELECT doc_id AS request_id,
             ['openai','anthropic','deepl','google','ollama','libretranslate','custom','openrouter','nosuch'][doc_id % 9 + 1] AS provider_name,
             CASE WHEN lang = 'de' THEN 'my-model' ELSE '' END AS model FROM documents)
SELECT d.request_id, d.provider_name, {Q.first_nonempty('d.model', 'p.default_model')} AS model
FROM d LEFT JOIN providers_d p ON p.provider = d.provider_name""", ("providers_d",))

# sources -------------------------------------------------------------------------------
sql("src1_load_requests", """
SELECT doc_id AS request_id, CASE WHEN lang = 'en' OR lang IS NULL OR lang = '' THEN 'auto' ELSE lang END AS source_lang,
       'es' AS target_lang, CASE WHEN doc_id % 3 = 0 THEN 'neutral' ELSE 'formal' END AS tone, true AS use_cache,
       CAST(0 AS BIGINT) AS alternatives, '' AS provider, '' AS model, '' AS context
FROM documents""")

sql("src2_load_glossary", f""",
g AS (SELECT entry_no AS no, source_term, target_lang, translation FROM glossary_raw),
ok AS (SELECT * FROM g WHERE source_term <> '' AND target_lang <> '' AND translation <> '')
SELECT CAST(row_number() OVER (ORDER BY no DESC) AS BIGINT) AS entry_no,
       source_term, CASE WHEN target_lang = '' THEN '' ELSE {Q.lang('target_lang')} END AS target_lang, translation,
       CAST(NULL AS VARCHAR) AS error FROM ok
UNION ALL
SELECT NULL, source_term, target_lang, translation,
       'invalid input: source_term, target_language and translation required'
FROM g WHERE NOT (source_term <> '' AND target_lang <> '' AND translation <> '')""", ("glossary_raw",))

sql("src4_load_documents", """
SELECT doc_id, format, 'auto' AS source_lang,
  CASE WHEN content = '' OR format = '' THEN 'invalid input: content, format and target_language required'
       WHEN format NOT IN ('markdown', 'plain', 'json', 'html', 'xml') THEN 'invalid input: unsupported format ' || format
  END AS error
FROM (SELECT doc_id, CASE WHEN n_chars < 100 THEN '' ELSE text END AS content,
             ['markdown','plain','html','xml','json','rst'][doc_id % 6 + 1] AS format FROM documents)""")

KEYED_FULL = f""", {KEYED.strip()}"""

sql("src5_cache_upsert", f"""{KEYED_FULL},
{CACHE_D.strip()},
newr AS (
  SELECT key_hash, 'new:' || CAST(request_id AS VARCHAR) AS translation,
         TIMESTAMP '2024-01-02 00:00:00' + to_seconds(CAST(request_id AS BIGINT)) AS created_at, 'new' AS generation
  FROM keyed2 WHERE source_lang <> 'en'),
allr AS (
  SELECT key_hash, c_translation AS translation, created_at, 'old' AS generation, 0 AS src FROM cache_d
  UNION ALL SELECT key_hash, translation, created_at, generation, 1 FROM newr)
SELECT key_hash, translation, generation FROM (
  SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY src DESC, created_at DESC) AS rn FROM allr) WHERE rn = 1""",
    ("requests_d", "gl_version", "providers_d"))

sql("src6_write_responses", f"""{KEYED_FULL},
{CACHE_D.strip()}
SELECT key_hash, to_json(struct_pack(translation := c_translation, source_language := c_source,
       target_language := c_target, provider := c_provider, model := c_model, cached := false,
       confidence := CAST(c_confidence AS DOUBLE), alternatives := [c_target], input_tokens := CAST(0 AS BIGINT),
       output_tokens := CAST(0 AS BIGINT)))::VARCHAR AS json
FROM cache_d""", ("requests_d", "gl_version", "providers_d"))

sql("jn3_cache_lookup", f"""{KEYED_FULL},
{CACHE_D.strip()}
SELECT k.request_id, c.key_hash IS NOT NULL AS hit, c.c_translation AS translation
FROM keyed2 k LEFT JOIN cache_live c ON c.key_hash = k.key_hash""", ("requests_d", "gl_version", "providers_d"))

sql("jn4_tiered_lookup", f"""{KEYED_FULL},
{CACHE_D.strip()},
tiers AS (SELECT key_hash, tier, created_at, c_translation, expires_at FROM cache_d
          UNION ALL SELECT key_hash, 3, created_at, c_translation, NULL FROM cache_d),
best AS (SELECT key_hash, min(tier) AS hit_tier, arg_max(c_translation, struct_pack(t := -tier, c := created_at)) AS answer FROM tiers
         WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-01 06:00:00' GROUP BY key_hash),
hitk AS (SELECT DISTINCT b.key_hash, b.hit_tier, b.answer FROM best b JOIN keyed2 k ON k.key_hash = b.key_hash)
SELECT 'hit' AS kind, k.request_id, k.key_hash, CAST(b.hit_tier AS BIGINT) AS tier, b.answer FROM keyed2 k JOIN best b ON b.key_hash = k.key_hash
UNION ALL
SELECT 'backfill', NULL, key_hash, CAST(unnest(generate_series(1, hit_tier - 1)) AS BIGINT), answer FROM hitk WHERE hit_tier > 1""",
    ("requests_d", "gl_version", "providers_d"))

sql("jn7_language_names", f""",
r AS (SELECT doc_id AS request_id, {Q.lang('lang')} AS src, lang || '-x' AS raw FROM documents)
SELECT r.request_id, coalesce(a.name, r.src) AS source_name, coalesce(b.name, r.raw) AS raw_name
FROM r LEFT JOIN languages_d a ON a.code = r.src LEFT JOIN languages_d b ON b.code = r.raw""", ("languages_d",))

sql("jn8_dedup_then_join", f"""{KEYED_FULL}
SELECT request_id, key_hash, row_number() OVER (PARTITION BY key_hash ORDER BY ts NULLS FIRST, request_id) > 1 AS cached
FROM keyed2""", ("requests_d", "gl_version", "providers_d"))

# metrics -------------------------------------------------------------------------------
sql("ag1_request_counts", ", x AS (SELECT 1)\nSELECT tool, CAST(count(*) AS BIGINT) AS requests FROM call_log GROUP BY tool",
    ("call_log",))

_LES = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0"]
_LE_VALUES = ", ".join(f"('{x}', {x})" for x in _LES) + ", ('+Inf', 'Infinity'::DOUBLE)"
sql("ag2_latency_histogram", f""",
les AS (SELECT * FROM (VALUES {_LE_VALUES}) t(le, v)),
tot AS (SELECT tool, round(sum(latency_s), 6) AS latency_sum, CAST(count(*) AS BIGINT) AS latency_count FROM call_log GROUP BY tool)
SELECT t.tool, les.le, CAST(count(c.tool) AS BIGINT) AS cumulative_count, t.latency_sum, t.latency_count
FROM tot t CROSS JOIN les LEFT JOIN call_log c ON c.tool = t.tool AND c.latency_s <= les.v
GROUP BY t.tool, les.le, t.latency_sum, t.latency_count""", ("call_log",))

sql("ag3_cache_hits", """, x AS (SELECT 1)
SELECT tool, CAST(count_if(cached) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS calls,
       round(count_if(cached) / count(*), 6) AS hit_ratio FROM call_log GROUP BY tool""", ("call_log",))

sql("ag4_provider_calls", """, x AS (SELECT 1)
SELECT provider, CAST(count_if(ok AND NOT cached) AS BIGINT) AS calls, CAST(count_if(NOT ok) AS BIGINT) AS errors
FROM call_log GROUP BY provider""", ("call_log",))

sql("ag5_token_totals", f""", x AS (SELECT 1)
SELECT provider, CAST(sum({Q.tokens(Q.norm("coalesce(input_text, '')"))}) AS BIGINT) AS input_tokens,
       CAST(sum({Q.tokens("coalesce(output_text, '')")}) AS BIGINT) AS output_tokens
FROM call_log WHERE ok AND NOT cached GROUP BY provider""", ("call_log",))

sql("ag6_provider_status", """, x AS (SELECT 1)
SELECT provider, CASE WHEN ok THEN 'healthy' ELSE 'unhealthy: ' || coalesce(error, '') END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, call_id DESC) AS rn FROM call_log) WHERE rn = 1""",
    ("call_log",))

# windows -------------------------------------------------------------------------------
sql("wn1_latest_by_key", """, x AS (SELECT 1)
SELECT key_hash, call_id, tool FROM (
  SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY ts DESC, call_id DESC) AS rn FROM call_log) WHERE rn = 1""",
    ("call_log",))

sql("wn2_cap_entries", """,
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY ts DESC, call_id DESC) AS rn FROM call_log) WHERE rn = 1),
c AS (SELECT key_hash, call_id, ts AS created_at, ts + CASE WHEN ok THEN INTERVAL 24 HOURS ELSE INTERVAL 1 HOURS END AS expires_at FROM l)
SELECT key_hash, call_id FROM c WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-29 00:00:00'
ORDER BY created_at DESC, key_hash LIMIT 25""", ("call_log",))

ORACLE["wn3_ttl_dedup"] = "WITH RECURSIVE " + Q.derived_ctes({"call_log"}) + """,
o AS (SELECT key_hash, call_id, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY key_hash ORDER BY epoch_us(ts), call_id) AS rn FROM call_log),
r AS (
  SELECT key_hash, call_id, t, rn, t AS anchor, 'write' AS action FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key_hash, o.call_id, o.t, o.rn,
         CASE WHEN o.t > r.anchor + 86400000000 THEN o.t ELSE r.anchor END,
         CASE WHEN o.t > r.anchor + 86400000000 THEN 'write' ELSE 'hit' END
  FROM r JOIN o ON o.key_hash = r.key_hash AND o.rn = r.rn + 1)
SELECT call_id, action FROM r"""

sql("wn4_failure_runs", """,
s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS island
      FROM call_log),
f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY provider, island ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS run_len
      FROM s)
SELECT call_id, provider, CAST(run_len AS BIGINT) AS run_len, (NOT ok) AND run_len = 3 AS tripped FROM f""", ("call_log",))

sql("wn5_over_rate", """,
c AS (SELECT call_id, provider, epoch_us(ts) AS t FROM call_log)
SELECT call_id, CAST(count(*) OVER (PARTITION BY provider ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window,
       count(*) OVER (PARTITION BY provider ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 3.0 AS over
FROM c""", ("call_log",))

# translation memory ---------------------------------------------------------------------
TMQ = f"""
tmq AS (
  SELECT conv_id * 1000 + turn AS query_id, text FROM conversations
  UNION ALL SELECT 1000000 + item_id, substring(text, 1, CAST(length(text) / 2 AS INTEGER)) || 'x' ||
                   substring(text, CAST(length(text) / 2 AS INTEGER) + 2) FROM benchmark
  UNION ALL SELECT 2000000 + item_id, substring(text, 1, CAST(length(text) / 2 AS INTEGER)) FROM benchmark
  UNION ALL SELECT 3000000 + item_id, regexp_extract(text, '^(\\S*)', 1) FROM benchmark),
qa AS (SELECT query_id, lower({Q.trim_u("regexp_replace(text, '[^ -~]', '?', 'g')")}) AS a FROM tmq),
tb AS (SELECT CAST(item_id + 1 AS BIGINT) AS id, lower(regexp_replace(text, '[^ -~]', '?', 'g')) AS b FROM benchmark)"""


def _tm_pairs(t: float) -> str:
    return f"""
pairs AS (
  SELECT query_id, id, CASE WHEN a = b THEN 1.0 WHEN contains(b, a) THEN 0.95
         WHEN greatest(strlen(a), strlen(b)) = 0 THEN 1.0
         ELSE 1.0 - levenshtein(a, b) / greatest(strlen(a), strlen(b)) END AS score
  FROM qa, tb
  WHERE a = b OR contains(b, a)
     OR abs(length(a) - length(b)) <= floor({1 - t} * greatest(strlen(a), strlen(b)) + 1e-9))"""


sql("jn5_tm_search", f"""WITH {TMQ.strip()}, {_tm_pairs(0.8).strip()}
SELECT query_id, CAST(id AS BIGINT) AS id, round(score, 6) AS score FROM pairs WHERE score >= 0.8""")

sql("so1_rank_results", f"""WITH {TMQ.strip()}, {_tm_pairs(0.5).strip()}
SELECT query_id, CAST(id AS BIGINT) AS id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS result_rank,
       sha256('translated:' || m.text) AS target_hash
FROM pairs JOIN benchmark m ON m.item_id + 1 = id WHERE score >= 0.5""")

sql("jn6_tm_exact", f""",
q AS (SELECT 1000000 + item_id AS query_id, '  ' || text || chr(9) AS text,
             CASE WHEN item_id % 3 = 0 THEN '' ELSE 'en' END AS sl, CASE WHEN item_id % 4 = 0 THEN '' WHEN item_id % 4 = 1 THEN 'de' ELSE 'es' END AS tl
      FROM benchmark
      UNION ALL SELECT conv_id * 1000 + turn, text, 'en', 'es' FROM conversations),
j AS (SELECT q.query_id, t.id AS tm_id, t.target_text,
             row_number() OVER (PARTITION BY q.query_id, q.text ORDER BY t.id DESC) AS rn
      FROM q JOIN tm_d t ON lower({Q.trim_u('q.text')}) = lower(t.source_text)
        AND (q.sl = '' OR t.source_lang = q.sl) AND (q.tl = '' OR t.target_lang = q.tl))
SELECT query_id, tm_id, sha256(target_text) AS target_hash FROM j WHERE rn = 1""", ("tm_d",))

sql("src3_append_tm", """,
mx AS (SELECT coalesce(max(id), 0) AS m FROM tm_d),
newr AS (SELECT conv_id * 1000 + turn AS seq, text AS source_text,
                CASE WHEN role = 'user' THEN 'translated:' || text ELSE '' END AS target_text FROM conversations)
SELECT id, sha256(source_text) AS source_hash, 'ok' AS status FROM tm_d
UNION ALL
SELECT CAST((SELECT m FROM mx) + row_number() OVER (ORDER BY seq) AS BIGINT), sha256(source_text), 'ok'
FROM newr WHERE source_text <> '' AND target_text <> ''
UNION ALL
SELECT NULL, sha256(source_text), 'rejected' FROM newr WHERE source_text = '' OR target_text = ''""", ("tm_d",))

# documents ------------------------------------------------------------------------------
FENCE = "(?s)(```(?:[^\\n]*\\n)?(.*?)```)"
TAG = "(<[^>]+>)"
MD_DOCS = f"""md AS (SELECT doc_id, text || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || 'tail' AS content FROM documents),
mdp AS (SELECT doc_id, regexp_split_to_array(content, '{FENCE}') AS segs, regexp_extract_all(content, '{FENCE}', 1) AS m FROM md)"""
HTML_DOCS = f"""hd AS (SELECT 1000000 + page_id AS doc_id, html AS content FROM pages),
hdp AS (SELECT doc_id, content, regexp_split_to_array(content, '{TAG}') AS parts, regexp_extract_all(content, '{TAG}', 1) AS tags FROM hd)"""

sql("dc1_segment_markdown", f"""WITH {MD_DOCS},
pieces AS (SELECT doc_id, unnest(flatten(list_transform(range(1, len(segs) + 1), lambda i:
    [struct_pack(pos := 2 * (i - 1), kind := 'text', s := segs[i])] ||
    CASE WHEN i <= len(m) THEN [struct_pack(pos := 2 * (i - 1) + 1, kind := 'keep', s := m[i])] ELSE [] END))) AS p FROM mdp)
SELECT doc_id, CAST(p.pos AS BIGINT) AS pos, p.kind AS kind, sha256(p.s) AS seg_hash FROM pieces WHERE p.kind = 'keep' OR p.s <> ''""")

sql("dc2_segment_tagged", f"""WITH {HTML_DOCS},
pieces AS (SELECT doc_id, unnest(flatten(list_transform(range(1, len(parts) + 1), lambda i:
    [struct_pack(pos := 2 * (i - 1), kind := CASE WHEN parts[i] <> '' AND NOT starts_with(parts[i], '<') THEN 'text' ELSE 'keep' END, s := parts[i])] ||
    CASE WHEN i <= len(tags) THEN [struct_pack(pos := 2 * (i - 1) + 1, kind := 'keep', s := tags[i])] ELSE [] END))) AS p FROM hdp)
SELECT doc_id, CAST(p.pos AS BIGINT) AS pos, p.kind AS kind, sha256(p.s) AS seg_hash FROM pieces""")

sql("dc4_reassemble", f"""WITH {HTML_DOCS}
SELECT doc_id, sha256(content) AS output_hash FROM hdp""")


def _tr(x: str) -> str:
    return f"(CASE WHEN {Q.norm(x)} = '' THEN {x} ELSE 'translated:' || {Q.norm(x)} END)"


def _too_long(x: str) -> str:
    return f"(length({Q.norm(x)}) > 10000)"


sql("dc5_translate_documents", f"""WITH {MD_DOCS}, {HTML_DOCS},
mdo AS (SELECT doc_id,
    array_to_string(flatten(list_transform(range(1, len(segs) + 1), lambda i:
      (CASE WHEN segs[i] <> '' THEN [{_tr('segs[i]')}] ELSE [] END) || (CASE WHEN i <= len(m) THEN [m[i]] ELSE [] END))),
      chr(10) || chr(10)) AS output,
    list_bool_or(list_transform(segs, lambda s: s <> '' AND {_too_long('s')})) AS bad FROM mdp),
hdo AS (SELECT doc_id,
    array_to_string(list_transform(range(1, len(parts) + 1), lambda i:
      (CASE WHEN parts[i] = '' OR starts_with(parts[i], '<') THEN parts[i] ELSE {_tr('parts[i]')} END) || coalesce(tags[i], '')), '') AS output,
    list_bool_or(list_transform(parts, lambda s: s <> '' AND NOT starts_with(s, '<') AND {_too_long('s')})) AS bad FROM hdp)
SELECT doc_id, CASE WHEN coalesce(bad, false) THEN NULL ELSE sha256(output) END AS output_hash,
       CASE WHEN coalesce(bad, false) THEN 'invalid input: text exceeds max length' END AS error
FROM (SELECT * FROM mdo UNION ALL SELECT * FROM hdo)""")

ORACLE["dc5_translate_mixed"] = ORACLE["dc5_translate_documents"] + f"""
UNION ALL
SELECT doc_id + 2000000, CASE WHEN {_too_long('text')} THEN NULL ELSE sha256({_tr('lang')} || '|' || CASE WHEN text = '' THEN '' ELSE {_tr('text')} END) END,
       CASE WHEN {_too_long('text')} THEN 'invalid input: text exceeds max length' END FROM documents
UNION ALL
SELECT item_id + 3000000, NULL, CASE WHEN item_id % 4 = 2 THEN 'invalid input: unsupported format pdf'
       ELSE 'invalid input: content, format and target_language required' END FROM benchmark"""

# detection ------------------------------------------------------------------------------
PROFILES = f"""
g AS (SELECT lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram
      FROM (SELECT {Q.lang('lang')} AS lang, lower(text) AS t FROM documents)),
cnts AS (SELECT lang, gram, CAST(count(*) AS BIGINT) AS cnt FROM g GROUP BY lang, gram),
prof AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, gram) AS BIGINT) AS rank
         FROM cnts) WHERE rank <= 300)"""

sql("ld1_train_language_profiles", f"WITH {PROFILES.strip()}\nSELECT lang, gram, cnt, rank FROM prof")

sql("ld2_detect_language", f"""WITH {PROFILES.strip()},
rows_ AS (SELECT conv_id * 1000 + turn AS row_id, lower(text) AS t FROM conversations),
rg AS (SELECT row_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram FROM rows_),
per AS (SELECT row_id, gram, count(*) AS k FROM rg GROUP BY row_id, gram),
hits AS (SELECT per.row_id, prof.lang, sum(per.k) AS hits FROM per JOIN prof ON prof.gram = per.gram GROUP BY per.row_id, prof.lang),
best AS (SELECT row_id, arg_min(lang, struct_pack(h := -hits, l := lang)) AS lang, max(hits) AS top, sum(hits) AS total
         FROM hits GROUP BY row_id)
SELECT r.row_id, coalesce(b.lang, 'auto') AS language, round(coalesce(b.top / b.total, 0.0), 6) AS confidence
FROM rows_ r LEFT JOIN best b ON b.row_id = r.row_id""")

sql("ld2_detect_documents", f"""WITH {PROFILES.strip()},
rows_ AS (SELECT doc_id AS row_id, lower(text) AS t FROM documents),
rg AS (SELECT row_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram FROM rows_),
per AS (SELECT row_id, gram, count(*) AS k FROM rg GROUP BY row_id, gram),
hits AS (SELECT per.row_id, prof.lang, sum(per.k) AS hits FROM per JOIN prof ON prof.gram = per.gram GROUP BY per.row_id, prof.lang),
best AS (SELECT row_id, arg_min(lang, struct_pack(h := -hits, l := lang)) AS lang, max(hits) AS top, sum(hits) AS total
         FROM hits GROUP BY row_id)
SELECT r.row_id, coalesce(b.lang, 'auto') AS language, round(coalesce(b.top / b.total, 0.0), 6) AS confidence
FROM rows_ r LEFT JOIN best b ON b.row_id = r.row_id""")

sql("ud3_register_detector", """
SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[äöüß]') THEN 'de'
                    WHEN regexp_matches(coalesce(text, ''), '[ñ¿¡]') THEN 'es'
                    WHEN regexp_matches(coalesce(text, ''), '[éèêàç]') THEN 'fr' ELSE 'en' END AS language,
       0.97 AS confidence
FROM documents""")

# engines --------------------------------------------------------------------------------
sql("ud1_run_engine", f"""{KEYED_FULL}
SELECT DISTINCT key_hash, sha256('py:' || text) AS translation_hash, 0.8 AS confidence, CAST(NULL AS VARCHAR) AS error
FROM keyed2""", ("requests_d", "gl_version", "providers_d"))

sql("ud2_mock_engine", """
WITH work AS (SELECT DISTINCT text FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)),
d AS (SELECT text AS source_text, 'dict:' || CAST(item_id AS VARCHAR) AS translation FROM benchmark)
SELECT sha256(w.text) AS key_hash, sha256(coalesce(d.translation, 'translated:' || w.text)) AS translation_hash,
       0.9 AS confidence
FROM work w LEFT JOIN d ON d.source_text = w.text""")

# batch and chain -------------------------------------------------------------------------
sql("bt1_batch_one_to_many", """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS item_pos, ['es', 'fr', 'de'][i] AS target_lang, CAST(NULL AS VARCHAR) AS error
FROM documents, range(1, 4) r(i) WHERE NOT (n_chars > 19000) AND lang IS DISTINCT FROM 'fr'
UNION ALL
SELECT doc_id, NULL, NULL, CASE WHEN n_chars > 19000 THEN 'invalid input: too many targets' ELSE 'invalid input: targets required' END
FROM documents WHERE n_chars > 19000 OR lang = 'fr'""")

sql("bt2_batch_many_to_one", """
WITH c AS (SELECT conv_id, turn, text, role, count(*) OVER (PARTITION BY conv_id) AS n,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, CAST(pos AS BIGINT) AS item_pos, sha256(coalesce(text, '')) AS text_hash,
       CASE WHEN role = 'assistant' THEN 'fr' ELSE 'es' END AS target_lang, CAST(NULL AS VARCHAR) AS error
FROM c WHERE n <= 50
UNION ALL
SELECT DISTINCT conv_id, NULL, NULL, 'es', 'invalid input: too many items' FROM c WHERE n > 50""")

_KNOWN = "[" + ", ".join(f"'{p}'" for p, _, _ in __import__('lingua_spark.constants', fromlist=['x']).PROVIDERS) + "]"
CHAIN = f"""
req AS (SELECT doc_id, quality, toxic,
               ['openai','anthropic','deepl','google','ollama','libretranslate','custom','openrouter','nosuch'][doc_id % 9 + 1] AS requested
        FROM labels),
ch AS (SELECT doc_id, quality, toxic, list_concat(CASE WHEN list_contains({_KNOWN}, requested) THEN [requested] ELSE [] END,
              list_filter(['deepl', 'openai', 'nosuch', 'google'], lambda f: list_contains({_KNOWN}, f) AND f <> requested)) AS chain
       FROM req),
chain_rows AS (SELECT doc_id, quality, toxic, CAST(i - 1 AS BIGINT) AS rank, chain[i] AS provider
               FROM ch, range(1, 6) r(i) WHERE i <= len(chain))"""

sql("bt3_resolve_chain", f"WITH {CHAIN.strip()}\nSELECT doc_id, rank, provider FROM chain_rows")

sql("bt4_first_success", f"""WITH {CHAIN.strip()},
o AS (SELECT *, NOT ((provider = 'openai' AND quality = 0) OR (provider = 'deepl' AND toxic = 1)
                    OR (provider = 'google' AND doc_id % 2 = 0) OR provider = 'anthropic') AS ok FROM chain_rows),
agg AS (SELECT doc_id, arg_min(CASE WHEN ok THEN provider END, CASE WHEN ok THEN rank END) AS p_ok,
               arg_max(CASE WHEN NOT ok THEN provider END, CASE WHEN NOT ok THEN rank END) AS p_err,
               bool_or(ok) AS any_ok FROM o GROUP BY doc_id)
SELECT doc_id, CASE WHEN any_ok THEN p_ok END AS provider,
       CASE WHEN any_ok THEN p_ok || ':' || CAST(doc_id AS VARCHAR) END AS translation,
       CASE WHEN NOT any_ok THEN coalesce(p_err || ' failed', 'provider unavailable: no provider available') END AS error
FROM agg""")

# streaming (drained with availableNow: one micro-batch over each table) --------------------
ORACLE["st1_stream_translate"] = ORACLE["bt5_translate"]
ORACLE["st2_stream_cache_upsert"] = ORACLE["src5_cache_upsert"]
ORACLE["st5_stream_failure_runs"] = ORACLE["wn4_failure_runs"]
sql("st4_stream_counts", """
SELECT epoch_us(date_trunc('day', ts)) AS window_start_us, event_type AS tool, CAST(count(*) AS BIGINT) AS calls
FROM events GROUP BY 1, 2""")

sql("jn5_tm_search_parts", f"""
WITH qa AS (SELECT p_partkey AS query_id, lower({Q.trim_u("regexp_replace(p_name, '[^ -~]', '?', 'g')")}) AS a FROM part),
tb AS (SELECT p_partkey AS id, lower(regexp_replace(p_name, '[^ -~]', '?', 'g')) AS b FROM part),
{_tm_pairs(0.8).strip().replace("FROM qa, tb", "FROM qa, tb")}
SELECT query_id, id, round(score, 6) AS score FROM pairs WHERE score >= 0.8""")

sql("jn7_list_languages", """
SELECT doc_id, p AS provider_name,
       CASE WHEN p IN ('openai', 'deepl', 'google', 'custom') THEN CAST(30 AS BIGINT) END AS n_languages,
       CASE WHEN p NOT IN ('openai', 'deepl', 'google', 'custom') THEN 'not found: provider ' || p END AS error
FROM (SELECT doc_id, ['openai','anthropic','deepl','google','ollama','libretranslate','custom','openrouter','nosuch'][doc_id % 9 + 1] AS p
      FROM labels)""")

# landed provider bodies (derived from conversations the same way as the Spark query) ----------
sql("src7_ingest_responses", """
WITH c AS (
  SELECT conv_id, turn, text,
         ['openai','anthropic','google','ollama','deepl','libretranslate','openrouter','custom'][(conv_id + turn) % 8 + 1] AS p,
         CASE WHEN length(text) % 17 = 0 THEN 429 WHEN length(text) % 13 = 0 THEN 500 ELSE 200 END AS status
  FROM conversations)
SELECT sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS key_hash, p AS provider,
  CASE WHEN status < 400 THEN sha256(text) END AS translation_hash,
  CASE WHEN status >= 400 THEN NULL WHEN p IN ('deepl', 'libretranslate') THEN 'en'
       WHEN turn % 3 = 2 THEN 'auto' ELSE 'en' END AS source_language,
  CAST(CASE WHEN status >= 400 THEN NULL WHEN p = 'deepl' THEN 0.92 WHEN p = 'libretranslate' THEN 0.75
       WHEN turn % 3 = 2 THEN 0.5 ELSE 0.93 END AS DOUBLE) AS confidence,
  CASE WHEN status < 400 THEN CAST(CASE WHEN p IN ('openai', 'openrouter', 'custom') THEN 10 ELSE 0 END AS BIGINT) END AS input_tokens,
  CASE WHEN status < 400 THEN CAST(CASE WHEN p IN ('openai', 'openrouter', 'custom') THEN 2 ELSE 0 END AS BIGINT) END AS output_tokens,
  CASE WHEN status = 429 THEN 'rate limited' WHEN status >= 400 THEN p || ' translate failed' END AS error_kind
FROM c""")

sql("src7_ingest_detections", """
WITH c AS (
  SELECT conv_id, turn, length(text) % 5 AS k,
         ['openai','anthropic','google','ollama','deepl','libretranslate','openrouter','custom'][(conv_id + turn) % 8 + 1] AS p,
         CASE WHEN length(text) % 17 = 0 THEN 429 WHEN length(text) % 13 = 0 THEN 500 ELSE 200 END AS status
  FROM conversations),
e AS (
  SELECT *, CASE WHEN status = 429 THEN 'rate limited: ' || p || ' rate limited' WHEN status = 500 THEN p || ' detect failed: HTTP 500'
    WHEN p = 'deepl' THEN CASE WHEN k = 3 THEN 'no translation returned' END
    WHEN p = 'libretranslate' THEN CASE WHEN k = 3 THEN 'no detection result' WHEN k = 2 THEN p || ' detect failed: invalid json' END
    WHEN k = 3 THEN 'no response' WHEN k = 1 THEN p || ' detect failed: invalid json' WHEN k = 2 THEN p || ' detect failed: mistyped field' END AS error
  FROM c)
SELECT sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS key_hash, p AS provider,
  CASE WHEN error IS NOT NULL THEN NULL WHEN p = 'deepl' THEN 'fr' WHEN turn % 2 = 0 THEN 'pt' ELSE 'es' END AS language,
  CAST(CASE WHEN error IS NOT NULL THEN NULL WHEN p = 'deepl' THEN 0.95 ELSE 0.97 END AS DOUBLE) AS confidence, error
FROM e""")

# JSON documents {"lang": .., "body": {"text": ..}}: fixed structure pieces + the two string values
sql("dc3_segment_json", """
WITH d AS (SELECT doc_id, lang, text FROM documents),
fixed AS (SELECT * FROM (VALUES (0, 'keep', '{'), (1, 'keep', '"lang":'), (2, 'keep', ''), (4, 'keep', ','),
                                (5, 'keep', '"body":'), (6, 'keep', '{'), (7, 'keep', '"text":'), (8, 'keep', ''),
                                (10, 'keep', '}}')) t(pos, kind, s))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, kind, sha256(s) AS seg_hash FROM d, fixed
UNION ALL SELECT doc_id, CAST(3 AS BIGINT), 'text', sha256(lang) FROM d
UNION ALL SELECT doc_id, CAST(9 AS BIGINT), 'text', sha256(text) FROM d""")

ORACLE["st3_stream_dedup"] = ORACLE["wn3_ttl_dedup"]

# the portions in which the call log arrives, and the rows below the watermark of those before (delay of 6 hours)
ARRIVAL = """
arrival AS (
  SELECT *, least(greatest(CAST(floor((epoch_us(ts) + call_id * 7919 % 86400 * 1000000 - lo) / ((hi - lo) / 3.0 + 1)) AS INTEGER), 0), 2) AS part
  FROM all_calls, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM all_calls)),
marks AS (
  SELECT p AS part, (max(epoch_us(ts)) // 1000 - 6 * 3600000) * 1000 AS mark
  FROM arrival, (SELECT unnest([1, 2]) AS p) WHERE part < p GROUP BY p),
timed AS (SELECT a.*, coalesce(epoch_us(ts) <= mark, false) AS late FROM arrival a LEFT JOIN marks m ON m.part = a.part),
call_log AS (SELECT * FROM timed WHERE NOT late)"""


def with_late_rows(name: str, late_row: str) -> str:
    body = ORACLE[name].replace("call_log AS (", "all_calls AS (", 1)
    head, sep, rest = body.partition(Q.derived_ctes({"call_log"}).replace("call_log AS (", "all_calls AS (", 1))
    return f"{head}{sep},{ARRIVAL}{rest}\nUNION ALL SELECT {late_row} FROM timed WHERE late"


ORACLE["st3_stream_dedup_late"] = with_late_rows("wn3_ttl_dedup", "call_id, 'late'")
ORACLE["st5_stream_failure_runs_late"] = with_late_rows("wn4_failure_runs", "call_id, provider, NULL, NULL")

sql("bt5_translate_detect", f"""WITH {Q.derived_ctes({"requests_d", "gl_version", "providers_d", "glossary_d"})},
{PROFILES.strip()},
vt AS (SELECT DISTINCT {Q.norm('text')} AS t FROM documents
       WHERE {Q.norm('text')} <> '' AND length({Q.norm('text')}) <= 10000),
rg AS (SELECT t, unnest(list_transform(range(1, length(lower(t)) - 1),
                   lambda i: substring(lower(t), i, 3))) AS gram FROM vt),
per AS (SELECT t, gram, count(*) AS k FROM rg GROUP BY t, gram),
hits AS (SELECT per.t, prof.lang, sum(per.k) AS hits FROM per JOIN prof ON prof.gram = per.gram GROUP BY per.t, prof.lang),
det AS (SELECT t, arg_min(lang, struct_pack(h := -hits, l := lang)) AS lang FROM hits GROUP BY t),
valid AS (SELECT r.*, {Q.norm('text')} AS ntext FROM requests_d r),
keyed AS (
  SELECT request_id, ts, ntext AS text, coalesce(det.lang, 'auto') AS source_lang, {Q.lang('target_lang')} AS target_lang,
         'openai' AS provider_name, {Q.first_nonempty('valid.model', 'p.default_model')} AS model, context, tone,
         (SELECT v FROM gl_version) AS glossary_version
  FROM valid LEFT JOIN det ON det.t = valid.ntext LEFT JOIN providers_d p ON p.provider = 'openai'
  WHERE ntext <> '' AND length(ntext) <= 10000),
keyed2 AS (
  SELECT *, {Q.key('text', 'source_lang', 'target_lang', 'provider_name', 'model', 'context', 'tone', 'glossary_version')} AS key_hash,
         row_number() OVER (PARTITION BY {Q.key('text', 'source_lang', 'target_lang', 'provider_name', 'model', 'context', 'tone', 'glossary_version')}
                            ORDER BY ts NULLS FIRST, request_id) AS rn
  FROM keyed),
targets AS (SELECT DISTINCT target_lang FROM keyed2),
{GLOSS_RANK.strip()},
engine AS (
  SELECT k.key_hash, list_reduce(coalesce(g.gl, []), lambda acc, e: replace(acc, e.ph, e.tr),
         'translated:' || list_reduce(coalesce(g.gl, []), lambda acc, e: regexp_replace(acc, e.p, e.ph, 'g'), k.text)) AS translation
  FROM keyed2 k LEFT JOIN gl_lists g ON g.target_lang = k.target_lang WHERE k.rn = 1)
SELECT k.request_id, k.key_hash, sha256(e.translation) AS translation_hash, k.source_lang AS source_language,
       k.target_lang AS target_language, k.provider_name AS provider, k.model, k.rn > 1 AS cached,
       round(0.9, 6) AS confidence, {Q.tokens('e.translation')} AS est_output_tokens, CAST(NULL AS VARCHAR) AS error
FROM keyed2 k JOIN engine e ON e.key_hash = k.key_hash
UNION ALL
{REFUSED.strip()}""")
