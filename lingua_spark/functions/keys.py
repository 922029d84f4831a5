"""Cache key (FN-7), duration parsing (FN-9) and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cache_key(text, source_lang, target_lang, provider, model, context, tone, glossary_version) -> Column:
    """FN-7: lowercase hex sha256 over the eight fields joined by NUL.

    Nulls are read as '' (concat_ws would otherwise skip them and shift fields).
    """
    parts = [F.coalesce(_c(x).cast("string"), F.lit("")) for x in
             (text, source_lang, target_lang, provider, model, context, tone)]
    parts.append(F.coalesce(_c(glossary_version).cast("long"), F.lit(0)).cast("string"))
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


# Duration text: optional sign, then one or more <number><unit> (number needs a digit
# before or after the point). Units: ns, us (also with micro sign or Greek mu), ms, s, m, h.
_NUM = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_UNIT = "(?:ns|us|µs|μs|ms|h|m|s)"
DURATION_RE = rf"^[+-]?(?:{_NUM}{_UNIT})+$"
_TOKEN_RE = rf"{_NUM}{_UNIT}"


def ttl_seconds(c, fallback_seconds: float) -> Column:
    """FN-9: Go-style duration text -> seconds (double).

    '' and '0' and unparseable text give the fallback.
    """
    s = _c(c)
    toks = F.regexp_extract_all(s, F.lit(f"({_TOKEN_RE})"), 1)

    def tok_seconds(t):
        num = F.regexp_extract(t, r"^([0-9.]+)", 1).cast("double")
        unit = F.regexp_extract(t, r"([a-zµμ]+)$", 1)
        mult = (F.when(unit == "h", 3600.0).when(unit == "m", 60.0).when(unit == "s", 1.0)
                .when(unit == "ms", 1e-3).when(unit == "ns", 1e-9).otherwise(1e-6))
        return num * mult

    total = F.aggregate(toks, F.lit(0.0), lambda acc, t: acc + tok_seconds(t))
    signed = F.when(F.startswith(s, F.lit("-")), -total).otherwise(total)
    valid = s.rlike(DURATION_RE)
    return (F.when(s.isNull() | s.isin("", "0"), F.lit(float(fallback_seconds)))
            .when(valid, signed)
            .otherwise(F.lit(float(fallback_seconds))))


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(c, dtype=None) -> Column:
    """Microseconds since the epoch; wall-clock for TIMESTAMP_NTZ (no session-zone use)."""
    col = _c(c)
    if isinstance(dtype, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), col)
    return F.unix_micros(col)
