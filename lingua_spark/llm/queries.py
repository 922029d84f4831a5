"""Registered queries of this package, each over its whole table, with oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm.bpe import encode_digests
from lingua_spark.llm.chat import conflict_rows, conversation_digests
from lingua_spark.llm.common import read
from lingua_spark.llm.decontamination import decontaminate
from lingua_spark.llm.fingerprints import compare_with_edits
from lingua_spark.llm.lexical_search import search
from lingua_spark.llm.line_dedup import removed_lines
from lingua_spark.llm.lm_scoring import pseudo_likelihood
from lingua_spark.llm.near_dup import near_duplicates
from lingua_spark.llm.secrets import secret_digests
from lingua_spark.llm.substring_dedup import remove_repeats
from lingua_spark.llm.toxicity import toxicity
from lingua_spark.llm.warc import round_trip
from lingua_spark.llm.whitening import whiten


def word_tokenizer() -> str:
    """Place of the public word-level BPE file; any file of its kind may be passed to the operator."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), word_tokenizer())


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = removed_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
                        F.size("matched").cast("long").alias("n_matched"), "matched")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_digests(read(spark, sf_dir, "documents"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(rows.unionByName(conflict_rows(spark)))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(read(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return (remove_repeats(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def op7_secrets_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op7_secrets that SQL can express."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op9_fingerprints_edits(spark, sf_dir: str) -> DataFrame:
    """The columns of op9_fingerprints that SQL can express."""
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_chat": op8_chat,
    "op9_fingerprints": op9_fingerprints,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_substring_dedup": op13_substring_dedup,
    "op7_secrets_base": op7_secrets_base,
    "op9_fingerprints_edits": op9_fingerprints_edits,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _spans(kind: int, name: str, pattern: str, keep: str) -> str:
    """Rows (rid, k, name, s, e) of the matches of one kind, from the pieces between them."""
    return f"""
select rid, {kind} k, '{name}' name, e - length(m[i]) s, e from (
  select rid, m, o, i, list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) e
  from (select rid, m, o, p, unnest(range(1, len(m) + 1)) i from (
    select rid, regexp_extract_all(t, '{pattern}') m, regexp_extract_all(t, '{pattern}', {2 if kind == 0 else 0}) o, string_split_regex(t, '{pattern}') p from d)))
where {keep}"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE: dict[str, str] = {
    "op7_secrets_base": f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
found as ({_spans(0, "assign", _ASSIGN, "length(o[i]) >= 6")}
union all {_spans(1, "access", "AKIA[A-Z0-9]+", "length(m[i]) >= 20")}
union all {_spans(2, "hex", "[0-9a-f]+", "length(m[i]) >= 24")})
select doc_id, count(*) filter (where k = 0) n_assign, count(*) filter (where k = 1) n_access, count(*) filter (where k = 2) n_hex,
  sha256(coalesce(string_agg(name || ':' || s || ':' || e, ',' order by s, k), '')) base_sha256
from d left join found using (rid) group by rid, doc_id""",
    "op9_fingerprints_edits": """
with d as (
  select doc_id, coalesce(text, '') t, lead(coalesce(text, '')) over (order by doc_id) nx,
    first_value(coalesce(text, '')) over (order by doc_id) ft from documents)
select doc_id, length(t) n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(coalesce(nx, ft), 1, length(t) // 2)) edited_sha256
from d""",
    "op6_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h) payload_bytes, sha256(h) payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id > first then first end refers_to
from f""",
    "op2_minhash": rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') ws from documents),
sh as (
  select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) end) s from w),
n as (select doc_id, count(*) n from sh group by 1),
common as (select a.doc_id a, b.doc_id b, count(*) i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
both_ways as (select a, b from link union select b, a from link),
reach as (select doc_id root, doc_id node from documents
  union select r.root, l.b from reach r join both_ways l on l.a = r.node),
comp as (select root doc_id, min(node) component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id, d.doc_id = c.component_id kept
from documents d join comp c using (doc_id) left join n using (doc_id)""",
    "op8_chat": r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u as (
  select *, replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') as st,
    replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') as sr,
    contains(role, ':') or contains(role || chr(10) || text, '</turn>') or contains(role || chr(10) || text, '###')
      or regexp_matches(role || chr(10) || text, '\\[behc]') as odd
  from r)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('### : </turn>') + 1 + case when odd then length(sr) + length(st) else length(role) + length(text) end)::bigint as formatted_chars
from u group by conv_id""",
    "op12_lexical_search": rf"""
with dt as (
  select doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from documents),
bt as (
  select item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
lens as (select doc_id, count(*) n from dt group by 1),
total as (select count(*) nn, sum(n)::bigint ll from lens),
tf as (select doc_id, t, count(*) c from dt where t in (select t from bt) group by 1, 2),
w as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint w from tf, total group by t, nn),
imp as (select doc_id, t, w * ((1000000000 * c) // (1000 * c + 8 * (100 - 75 + ((75 * n * nn) // ll)))) s
  from tf join lens using (doc_id) join w using (t), total),
sc as (select item_id, doc_id, sum(s)::bigint score from bt join imp using (t) group by 1, 2),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) "rank" from sc where score > 0)
select item_id, "rank", doc_id, score from r where "rank" <= 10""",
    "op13_substring_dedup": r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select rid, unnest(range(1, len(ws) - 33)) i, unnest([array_to_string(ws[i:i+34], ' ') for i in range(1, len(ws) - 33)]) g from d where len(ws) >= 35),
again as (select g from win group by g having count(*) > 1),
gone as (select rid, list(distinct p) ps from (select rid, unnest(range(i, i + 35)) p from win join again using (g)) group by 1)
select doc_id, len(ws) n_words, coalesce(len(ps), 0) n_removed,
  sha256(array_to_string(case when ps is null then ws else [ws[p] for p in range(1, len(ws) + 1) if not list_contains(ps, p)] end, ' ')) kept_sha256
from d left join gone using (rid)""",
    "op10_decontamination": rf"""
with dw as (
  select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
iw as (
  select item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
win as (
  select distinct item_id, m, unnest([array_to_string(ws[i:i+m-1], ' ') for i in range(1, len(ws) - m + 2)]) g
  from (select *, least(10, len(ws)) m from iw where len(ws) > 0)),
lens as (select distinct m from win),
dg as (
  select doc_id, m, unnest(range(1, len(ws) - m + 2)) i, unnest([array_to_string(ws[i:i+m-1], ' ') for i in range(1, len(ws) - m + 2)]) g
  from dw, lens where len(ws) >= m),
hit as (select distinct dg.doc_id, dg.i, dg.m, win.item_id from dg join win on dg.g = win.g and dg.m = win.m),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + m)) p from (select distinct doc_id, i, m from hit)) group by 1),
it as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
  from (select distinct doc_id, cast(item_id as varchar) item_id from hit) group by 1)
select dw.doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join pos using (doc_id) left join it using (doc_id)""",
}
