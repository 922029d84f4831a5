"""DuckDB SQL fragments mirroring the Spark column functions (oracle side only)."""

from lingua_spark import constants as K

USP = r"[\s\x0B\x{85}\p{Z}]"


def trim_u(x: str) -> str:
    return f"regexp_replace({x}, '^{USP}+|{USP}+$', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace({trim_u(x)}, '[\\t\\n\\f\\r ]+', ' ', 'g')"


def tokens(x: str) -> str:
    return f"CAST(length({x}) // 4 + 1 AS BIGINT)"


CODES = ", ".join(f"'{c}'" for c in K.LANGUAGE_CODES)


def lang(x: str) -> str:
    lo = f"lower({trim_u(x)})"
    base = f"split_part({lo}, '-', 1)"
    return (f"(CASE WHEN coalesce({lo}, '') IN ('', 'auto') THEN 'auto' WHEN {lo} IN ({CODES}) THEN {lo} "
            f"WHEN {base} IN ({CODES}) THEN {base} ELSE {lo} END)")


def first_nonempty(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def key(text, src, tgt, prov, model, ctx, tone, ver) -> str:
    parts = ", ".join(f"coalesce({p}, '')" for p in (text, src, tgt, prov, model, ctx, tone))
    return f"sha256(concat_ws(chr(0), {parts}, CAST(coalesce({ver}, 0) AS VARCHAR)))"


def pattern(term: str, cs: str) -> str:
    return f"((CASE WHEN {cs} THEN '' ELSE '(?i)' END) || '\\b\\Q' || replace({term}, '\\E', '\\E\\\\E\\Q') || '\\E\\b')"


PROVIDERS_VALUES = ", ".join(f"('{p}', '{m}', {str(g).lower()})" for p, m, g in K.PROVIDERS)
LANG_VALUES = ", ".join("('{}', '{}')".format(c, n.replace("'", "''")) for c, n in K.LANGUAGES)


def derived_ctes(sel: set[str]) -> str:
    """Derived tables of sources/tables.py as CTEs (only those in `sel`, plus dependencies)."""
    ctes = {}
    ctes["requests_d"] = f"""requests_d AS (
  SELECT doc_id AS request_id, CAST(NULL AS TIMESTAMP) AS ts, coalesce(text, '') AS text,
         coalesce(lang, '') AS source_lang, CASE WHEN lang = 'es' THEN 'fr' ELSE 'es' END AS target_lang,
         '' AS provider, '' AS model, '' AS context, 'neutral' AS tone, true AS use_cache, 0 AS alternatives
  FROM documents)"""
    ctes["glossary_raw"] = """glossary_raw AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS entry_no, r_name AS source_term, '' AS target_lang,
         lower(r_name) AS translation, 'region' AS context, false AS case_sensitive FROM region
  UNION ALL
  SELECT CAST(n_nationkey + 6 AS BIGINT), n_name, CASE WHEN n_regionkey % 2 = 0 THEN 'es' ELSE 'fr' END,
         lower(n_name), 'nation', n_nationkey % 3 = 0 FROM nation
  UNION ALL
  SELECT CAST(min(item_id) + 100 AS BIGINT), w, 'es', CASE WHEN w = '' THEN '' ELSE '{' || lower(w) || '}' END,
         'benchmark', false
  FROM (SELECT item_id, regexp_extract(text, '^([A-Za-z]*)', 1) AS w FROM benchmark) GROUP BY w)"""
    ctes["glossary_d"] = """glossary_d AS (
  SELECT * FROM glossary_raw WHERE source_term <> '' AND translation <> '')"""
    ctes["gl_version"] = """gl_version AS (SELECT CAST(count(*) AS BIGINT) AS v FROM glossary_d)"""
    ctes["tm_d"] = """tm_d AS (
  SELECT CAST(item_id + 1 AS BIGINT) AS id, text AS source_text, 'translated:' || text AS target_text,
         'en' AS source_lang, 'es' AS target_lang FROM benchmark)"""
    ctes["call_log"] = """call_log AS (
  SELECT event_id AS call_id, ts, event_type AS tool, 'p' || CAST(user_id % 4 AS VARCHAR) AS provider,
         sha256(concat_ws(chr(0), CAST(user_id AS VARCHAR), event_type)) AS key_hash,
         event_type <> 'error' AS ok, event_type = 'view' AS cached, value / 100 AS latency_s,
         props AS input_text, event_type AS output_text,
         CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(400 + CAST(floor(value) AS BIGINT) % 100 AS VARCHAR)
         END AS error, user_id, value
  FROM events)"""
    ctes["providers_d"] = f"providers_d AS (SELECT * FROM (VALUES {PROVIDERS_VALUES}) t(provider, default_model, uses_glossary))"
    ctes["languages_d"] = f"languages_d AS (SELECT * FROM (VALUES {LANG_VALUES}) t(code, name))"
    deps = {"glossary_d": ["glossary_raw"], "gl_version": ["glossary_raw", "glossary_d"]}
    want = []
    for name in ctes:
        if name in sel or any(name in deps.get(s, []) for s in sel):
            want.append(name)
    return ",\n".join(ctes[n] for n in want)
