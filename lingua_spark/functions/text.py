"""Scalar text functions (FN-1..FN-6, FN-8, FN-10) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingua_spark import constants as K

# Unicode space of a trim: the ASCII white space with vertical tab, NEL and every character of category Z.
USPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Inner white space that is not one space already: ASCII controls and runs (no vertical tab).
WS_RUN_RE = r"[\t\n\f\r ]{2,}|[\t\n\f\r]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(_c(c), F.lit(USPACE))


def normalize_text(c) -> Column:
    """FN-1: Unicode trim, then collapse ASCII white-space runs to one space."""
    return F.regexp_replace(utrim(c), WS_RUN_RE, " ")


def truncate_text(c, n: int) -> Column:
    """FN-2: first n code points."""
    return F.substring(_c(c), 1, n)


def char_len(c) -> Column:
    return F.char_length(_c(c)).cast("long")


def estimate_tokens(c) -> Column:
    """FN-3: code points / 4 + 1 (integer division)."""
    return (F.floor(F.char_length(_c(c)) / 4) + 1).cast("long")


def split_paragraphs(c) -> Column:
    """FN-4: split on blank lines, trim each part, drop empties -> array<string>."""
    parts = F.split(_c(c), "\n\n", -1)
    return F.filter(F.transform(parts, lambda p: utrim(p)), lambda p: p != "")


def is_mostly_latin(c) -> Column:
    """FN-5: Latin-script letters / all letters > 0.5; no letters -> true."""
    latin = F.regexp_count(_c(c), F.lit(r"\p{IsLatin}"))
    letters = F.regexp_count(_c(c), F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(True)).otherwise(latin / letters > 0.5)


def normalize_language(c) -> Column:
    """FN-6: lower(trim); '' / auto -> auto; known code kept; else known base; else the code.

    Only all-lowercase codes can match after lowering, so region codes such as pt-BR
    collapse to their base.
    """
    code = F.lower(utrim(c))
    known = F.lit(K.LANGUAGE_CODES)
    base = F.substring_index(code, "-", 1)
    return (
        F.when(F.coalesce(code, F.lit("")).isin("", "auto"), F.lit("auto"))
        .when(F.array_contains(known, code), code)
        .when(F.array_contains(known, base), base)
        .otherwise(code)
    )


def first_nonempty(*cols) -> Column:
    """FN-10: first argument that is neither null nor ''; '' when none."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in cols], F.lit(""))


def mask_for_log(c, mask: bool = True) -> Column:
    """FN-8: <= 8 code points -> ***; else first 3 + ... + last 3."""
    if not mask:
        return _c(c)
    return F.when(F.char_length(_c(c)) <= 8, F.lit("***")).otherwise(
        F.concat(F.substring(_c(c), 1, 3), F.lit("..."), F.substring(_c(c), -3, 3))
    )
