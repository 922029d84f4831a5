r"""Chat formatting by a grammar round trip (operator 8). DataFrame functions only.

    conversation := turn*
    turn         := "### " role ": " text "</turn>" LF
    role, text   := characters without the control strings "</turn>" and "###" (a role also without ":")

The parser splits at "</turn>" LF, reads role and text of each piece, refuses pieces that still hold a control string,
and replaces the escapes \e (</turn>), \h (###), \c (:) and \b (a backslash). Each turn is first rendered as it is and
parsed again; a turn that comes back different, or not at all, is rendered with its backslashes and control strings
escaped, which always comes back identical. A conversation is its turns' renderings in a row; what is reported is
parsed from that text, and a run stops if it differs from the source.

The loss mask covers the texts of assistant turns, as run lengths per turn: (characters skipped, characters in the loss).

Defined cases: null texts and roles are empty; rows of a conversation are ordered by turn (null first), then role, then text,
and repeated rows are turns of their own; rows without conv_id are one conversation; an empty table gives an empty
result; extra columns are ignored. A conversation is one text, so it is put together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

END = "</turn>"
HEAD = "###"
_ESCAPES = (("\\", "\\b"), (END, "\\e"), (HEAD, "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))


def _replace(c: Column, what: str, by: str) -> Column:
    return F.replace(c, F.lit(what), F.lit(by))


def escape(c: Column, role: bool = False) -> Column:
    for raw, code in _ROLE_ESCAPES if role else _ESCAPES:
        c = _replace(c, raw, code)
    return c


def unescape(c: Column) -> Column:
    """Every backslash of an escaped text begins a code; the backslash's own code is replaced last."""
    for raw, code in reversed(_ROLE_ESCAPES):
        c = _replace(c, code, raw)
    return c


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(f"{HEAD} "), role, F.lit(": "), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, skip, loss>> of a formatted text; a piece that breaks the grammar has null role and text.
    skip and loss: the piece's raw length before its text, and of its text."""
    pieces = F.split(formatted, f"{END}\n", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = rf"^{HEAD} ([^:]*): "

    def turn(p: Column) -> Column:
        start = F.length(F.regexp_extract(p, head, 0))
        role = F.regexp_extract(p, head, 1)
        text = F.substring(p, start + 1, F.length(p))
        good = (start > 0) & ~F.contains(role, F.lit(HEAD)) & ~F.contains(role, F.lit(END)) & ~F.contains(text, F.lit(HEAD)) & ~F.contains(text, F.lit(END))
        return F.struct(F.when(good, unescape(role)).alias("role"), F.when(good, unescape(text)).alias("text"), start.alias("skip"), F.length(text).alias("loss"))

    return F.transform(turns, turn)


def render_turns(rows: DataFrame) -> DataFrame:
    """rows(role, text, ...) with rendered: as it is if that parses back to the same turn, else escaped."""
    plain, safe = render(F.col("role"), F.col("text")), render(escape(F.col("role"), True), escape(F.col("text")))
    # only texts with a backslash or a control string, or such roles, can come back different
    odd = F.regexp_like(F.concat("role", F.lit("\n"), "text"), F.lit(rf"\\|{HEAD}|{END}")) | F.contains("role", F.lit(":"))
    back = parse(plain)
    same = (F.size(back) == 1) & F.get(back, F.lit(0))["role"].eqNullSafe(F.col("role")) & F.get(back, F.lit(0))["text"].eqNullSafe(F.col("text"))
    return rows.withColumn("rendered", F.when(~odd | same, plain).otherwise(safe))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, mask) per conversation: turns as parsed back, mask as run lengths."""
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = render_turns(clean).withColumn("sent", F.xxhash64("role", "text"))
    grouped = (turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "rendered", "sent"))).alias("t"))
               .withColumn("formatted", F.array_join(F.col("t.rendered"), "")).withColumn("sent", F.col("t.sent")).drop("t"))
    out = grouped.withColumn("turns", parse(F.col("formatted")))
    same = F.col("sent").eqNullSafe(F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    checked = out.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not parse back to its source"))))
    mask = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "assistant", t["skip"]).otherwise(t["skip"] + t["loss"] + len(END) + 1).alias("skip"),
                                                   F.when(t["role"] == "assistant", t["loss"]).otherwise(F.lit(0)).alias("loss")))
    return checked.withColumn("mask", mask).select("conv_id", "formatted", "turns", "mask")


def conversation_digests(rows: DataFrame) -> DataFrame:
    t = format_conversations(rows)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return t.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


def conflict_rows(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    return spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
