"""Glossary: SRC-2 load, SE-1 get, JN-1 per-target ranking, JN-2 mask/restore, AG-7 version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark import constants as K
from lingua_spark.functions.text import normalize_language
from lingua_spark.operators.ids import range_sorted, sequential_ids
from lingua_spark.operators.windows import rank_results
from lingua_spark.session import cut_lineage, written_once

# ASCII word boundary (Go's \b) for Java regex, whose \b is Unicode-aware.
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def load_glossary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-2: entries need source_term, target_lang and translation; number them in input order
    (`added_at` where given, nulls first, then the order of the rows as read).

    Stored target languages are normalized ('' stays global), see D-5.
    """
    g = df
    for c in ("source_term", "target_lang", "translation", "context"):
        if c not in g.columns:
            g = g.withColumn(c, F.lit(""))
        g = g.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    if "case_sensitive" not in g.columns:
        g = g.withColumn("case_sensitive", F.lit(False))
    g = g.withColumn("case_sensitive", F.coalesce(F.col("case_sensitive"), F.lit(False)))
    if "added_at" not in g.columns:
        g = g.withColumn("added_at", F.lit(None).cast("timestamp"))
    bad = (F.col("source_term") == "") | (F.col("target_lang") == "") | (F.col("translation") == "")
    g = g.withColumn("error", F.when(bad, F.lit(
        f"{K.ERR_INVALID_INPUT}: source_term, target_language and translation required")))
    ok = g.filter(F.col("error").isNull()).drop("error")
    rejected = g.filter(F.col("error").isNotNull())
    if "entry_no" not in ok.columns:
        # the position in the input: unique and ascending over a scan's splits, fixed by the
        # checkpoint inside sequential_ids
        ok = ok.withColumn("_in", F.monotonically_increasing_id())
        ok = sequential_ids(ok, [F.col("added_at").asc_nulls_first(), "_in"], "entry_no", start=1).drop("_in")
    ok = ok.withColumn("target_lang", F.when(F.col("target_lang") == "", "")
                       .otherwise(normalize_language("target_lang")))
    return ok, rejected


def glossary_get(glossary: DataFrame, target: str) -> DataFrame:
    """SE-1: entries for `target` plus global ones in insertion order; blank target -> global only."""
    return glossary.filter(F.col("target_lang").isin("", target)).orderBy("entry_no")


def glossary_all(glossary: DataFrame) -> DataFrame:
    return glossary.orderBy("entry_no")


def term_pattern(term: Column, case_sensitive: Column) -> Column:
    """Whole-word pattern of a literal term: ASCII boundaries (Go's \\b), Unicode case folding
    when insensitive.

    The literal comes first so the matcher fails fast on the first character; the boundary
    at the start of the match is then checked with fixed-width look-behinds over the
    term's code-point length L: a word char exactly L+1 back XOR a word char exactly L back.
    This is the same match set as boundary + literal + boundary.
    """
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # case folding applies to the literal only: inside (?iu) Java's \\w would also fold
    # (the Kelvin sign would count as a word char), Go's \\b never does
    lit = F.when(case_sensitive, quoted).otherwise(F.concat(F.lit("(?iu:"), quoted, F.lit(")")))
    n = F.char_length(term).cast("string")
    n1 = (F.char_length(term) - 1).cast("string")
    before_word = F.concat(F.lit(r"\w[\s\S]{"), n, F.lit("}"))
    first_word = F.concat(F.lit(r"\w[\s\S]{"), n1, F.lit("}"))
    start = F.concat(F.lit("(?:(?<="), before_word, F.lit(")(?<!"), first_word, F.lit(")|(?<!"), before_word,
                     F.lit(")(?<="), first_word, F.lit("))"))
    # a match that surely begins with a word char needs one look back; the boundary at the end is the cheaper one
    plain = F.when(case_sensitive, term.rlike("^[A-Za-z0-9_]")).otherwise(term.rlike("^[A-HJLM-RT-Za-hjlm-rt-z0-9_]"))
    start = F.when(plain, F.concat(F.lit("(?<!"), before_word, F.lit(")"))).otherwise(start)
    return F.concat(lit, F.lit(ASCII_BOUNDARY), start)


# The only non-ASCII letters that case-fold onto ASCII letters (long s, dotless i, Kelvin
# sign, dotted capital I). Without them, a case-insensitive match of an ASCII word run is an
# ASCII word run of the lowered text, i.e. one of its tokens.
SPECIALS = "\u017f\u0131\u212a\u0130"


def prune_fold(c: Column) -> Column:
    """Lower case with the special letters mapped onto ASCII, so a case-insensitive term
    match implies that the folded term key is a substring of the folded text."""
    lowered = F.regexp_replace(F.lower(c), "\u0307", "")
    return F.translate(lowered, "\u017f\u0131\u212a", "sik")


def term_runs(term: Column) -> Column:
    """The ASCII word runs of the folded term."""
    return F.array_distinct(F.regexp_extract_all(prune_fold(term), F.lit("([a-z0-9_]+)"), 1))


def anchor_fold(c: Column) -> Column:
    """Case folding of one or two letters of any script: letters that match each other case-insensitively
    fold alike."""
    return F.translate(F.lower(F.upper(F.translate(c, "\u1e9e", "\u00df"))), "\u03c2", "\u03c3")


def placeholder(rank: Column) -> Column:
    return F.concat(F.lit(K.PLACEHOLDER_PREFIX), rank.cast("string"), F.lit(K.PLACEHOLDER_SUFFIX))


def ranked_entries(targets: DataFrame, glossary: DataFrame) -> DataFrame:
    """Rows (target_lang, rank, placeholder, pattern, term, translation, case_sensitive) for each target in `targets`.

    Each target looks up its own entries and the global ones through an equi join on a two-element key list, so no
    cross join is needed. Rank = byte length desc, entry_no asc; ranks come from range buckets, so a target with very
    many entries is not ranked by one task. The rows are written once.
    """
    keys = (targets.select("target_lang").distinct()
            .withColumn("gl_key", F.explode(F.array(F.col("target_lang"), F.lit("")))))
    g = glossary.select(F.col("target_lang").alias("gl_key"), "entry_no", "source_term", "translation",
                        "case_sensitive")
    ranked = rank_results(keys.join(g, "gl_key").withColumn("_bytes", F.octet_length("source_term")),
                          part="target_lang", score="_bytes", id_col="entry_no")
    return (ranked.withColumn("rank", (F.col("result_rank") - 1).cast("int"))
            .select("target_lang", "rank", placeholder(F.col("rank")).alias("placeholder"),
                    term_pattern(F.col("source_term"), F.col("case_sensitive")).alias("pattern"),
                    F.col("source_term").alias("term"), "translation", "case_sensitive"))


GLOSS_TYPE = "array<struct<rank:int,placeholder:string,pattern:string,term:string,translation:string>>"


def entry_anchors(ranked: DataFrame) -> DataFrame:
    """`ranked` with the lookup keys under which a text finds an entry (see text_anchors): the rarest of its ASCII
    word runs among the entries of the target, also as that run's first three characters; without a run, its first two
    characters. Each kind of key has its own prefix."""
    runs = ranked.select("target_lang", "rank", F.explode(term_runs(F.col("term"))).alias("_run"))
    often = runs.groupBy("target_lang", "_run").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (runs.join(often, ["target_lang", "_run"]).groupBy("target_lang", "rank")
              .agg(F.min_by("_run", F.struct("_n", -F.length("_run"), "_run")).alias("_run")))
    keyed = ranked.join(rarest, ["target_lang", "rank"], "left")
    by_run = F.array(F.concat(F.lit("t"), "_run"), F.concat(F.lit("g"), F.substring("_run", 1, 3)))
    by_start = F.array(F.concat(F.lit("a"), anchor_fold(F.substring("term", 1, 2))))
    keys = F.array_append(F.when(F.col("_run").isNotNull(), by_run).otherwise(by_start), F.concat(F.lit("p"), F.col("rank").cast("string")))
    return keyed.withColumn("_key", F.explode(keys)).drop("_run")


def text_anchors(text: Column) -> Column:
    """Keys of the entries that may match a text (a superset of those that do).

    A match begins and ends at an ASCII word boundary. So an entry with an ASCII word run has that run as one of the
    text's tokens; where the text holds a letter that folds onto ASCII (`SPECIALS`) its tokens may be cut, and the run is
    only known to occur, so its first three characters are looked up among the text's grams instead. An entry
    without such a run begins after a word character: one key per end of a token. Placeholders in the text keep their
    entries, since restoring replaces them."""
    tokens = F.transform(F.array_distinct(F.split(F.lower(text), r"\W+")), lambda x: F.concat(F.lit("t"), x))
    folded = prune_fold(text)
    grams = F.transform(F.flatten(F.array(*[F.regexp_extract_all(folded, F.lit(f"(?=([a-z0-9_]{{{k}}}))"), 1) for k in (1, 2, 3)])),
                        lambda x: F.concat(F.lit("g"), x))
    starts = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w(\W{1,2})"), 1))
    two = F.transform(starts, lambda x: F.concat(F.lit("a"), anchor_fold(x)))
    one = F.transform(starts, lambda x: F.concat(F.lit("a"), anchor_fold(F.substring(x, 1, 1))))
    marks = F.transform(F.regexp_extract_all(text, F.lit(f"{K.PLACEHOLDER_PREFIX}([0-9]+){K.PLACEHOLDER_SUFFIX}"), 1), lambda x: F.concat(F.lit("p"), x))
    by_run = F.when(text.rlike(f"[{SPECIALS}]"), grams).otherwise(tokens)
    return F.concat(by_run, F.array_distinct(F.concat(two, one)), marks)


def glossary_for(requests: DataFrame, glossary: DataFrame, out_col: str = "gloss", row_id: str | None = None,
                 text_col: str = "text", ranked: DataFrame | None = None) -> DataFrame:
    """JN-1: attach to each request the ranked entries of its target_lang that may match its text, as an array.

    One path for glossaries of any size: each text's anchors (see text_anchors) are looked up in the table of entry
    anchors by one equi join on (target, key), and the entries found are gathered per row. `row_id` names a unique
    column; without it the rows are numbered and written here. `ranked` takes the rows of ranked_entries, if they
    are there already."""
    if row_id is None:
        rows = cut_lineage(requests.withColumn("_row", F.monotonically_increasing_id()))
        return glossary_for(rows, glossary, out_col, "_row", text_col, ranked).drop("_row")
    if ranked is None:
        ranked = ranked_entries(requests, glossary)
    # written, so that its size is known: beside a small glossary the texts' keys stay where they are
    anchors = written_once(entry_anchors(ranked.select("target_lang", "rank", "term", "translation", "case_sensitive")))
    keys = requests.select(row_id, "target_lang", F.explode(text_anchors(F.col(text_col))).alias("_key"))
    found = keys.join(anchors, ["target_lang", "_key"]).groupBy(row_id).agg(
        F.array_sort(F.collect_set(F.struct("rank", "term", "translation", "case_sensitive"))).alias("_found"))
    entries = F.transform("_found", lambda e: F.struct(
        e["rank"].alias("rank"), placeholder(e["rank"]).alias("placeholder"), term_pattern(e["term"], e["case_sensitive"]).alias("pattern"),
        e["term"].alias("term"), e["translation"].alias("translation")))
    return (requests.join(found, row_id, "left")
            .withColumn(out_col, F.coalesce(entries, F.array().cast(GLOSS_TYPE))).drop("_found"))


def mask_terms(text: Column, gloss: Column) -> Column:
    """JN-2 mask: replace each entry's whole-word matches by its placeholder, in rank order."""
    return F.aggregate(gloss, text, lambda acc, e: F.regexp_replace(acc, e["pattern"], e["placeholder"]))


def restore_terms(text: Column, gloss: Column) -> Column:
    """JN-2 restore: literal placeholder -> translation, in rank order (entries whose
    placeholder does not occur are skipped; replacing them would be a no-op)."""
    present = F.filter(gloss, lambda e: F.instr(text, e["placeholder"]) > 0)
    return F.aggregate(present, text, lambda acc, e: F.replace(acc, e["placeholder"], e["translation"]))


def glossary_mask(df: DataFrame, text_col: str = "text", gloss_col: str = "gloss",
                  out_col: str = "masked") -> DataFrame:
    """JN-2 mask over the entries that JN-1 attached."""
    return df.withColumn(out_col, mask_terms(F.col(text_col), F.col(gloss_col)))


def glossary_restore(df: DataFrame, text_col: str = "translation", gloss_col: str = "gloss",
                     out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or text_col, restore_terms(F.col(text_col), F.col(gloss_col)))


def glossary_version_at(requests: DataFrame, glossary: DataFrame, ts_col: str = "ts",
                        out_col: str = "glossary_version") -> DataFrame:
    """AG-7: number of glossary adds at or before each request's time (as-of count).

    Adds with a null time count as added before everything; a request without a time sees
    the whole glossary. The add times and the distinct request times are range-sorted
    together; each request time takes the running count of adds before it (counts per range bucket, with the
    buckets' offsets), and the requests look their time up by an equi join, which Spark broadcasts where the
    times are few. No request is compared with more than its own time.
    """
    adds = glossary.groupBy(F.col("added_at").alias("_t")).agg(F.count(F.lit(1)).alias("_add"))
    times = requests.filter(F.col(ts_col).isNotNull()).select(F.col(ts_col).alias("_t")).distinct().withColumn("_add", F.lit(0).cast("long"))
    # adds sort before requests of the same time ("at or before"); null add times first
    order = [F.col("_t").asc_nulls_first(), F.col("_add").desc()]
    ev = range_sorted(adds.unionByName(times), order, "_pid")
    local = ev.withColumn("_c", F.sum("_add").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = local.groupBy("_pid").agg(F.sum("_add").alias("_n"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    versions = (local.filter(F.col("_add") == 0).join(F.broadcast(offsets), "_pid")
                .select(F.col("_t").alias("_at"), (F.col("_off") + F.col("_c")).cast("long").alias("_v")))
    total = glossary.agg(F.count(F.lit(1)).alias("_total"))
    return (requests.join(versions, F.col(ts_col) == F.col("_at"), "left").withColumn("_total", total.scalar())
            .withColumn(out_col, F.coalesce(F.when(F.col(ts_col).isNull(), F.col("_total")).otherwise(F.col("_v")),
                                            F.lit(0)).cast("long"))
            .drop("_at", "_v", "_total"))
