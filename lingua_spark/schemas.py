"""Explicit StructTypes of the engine's tables."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


STR, LONG, INT, DBL, BOOL, TS = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType(), TimestampType()

REQUESTS = _s(("request_id", LONG), ("ts", TS), ("text", STR), ("source_lang", STR), ("target_lang", STR),
              ("provider", STR), ("model", STR), ("context", STR), ("tone", STR), ("use_cache", BOOL),
              ("alternatives", INT))

RESPONSE_FIELDS = [("translation", STR), ("source_language", STR), ("target_language", STR), ("provider", STR),
                   ("model", STR), ("cached", BOOL), ("confidence", DBL), ("alternatives", ArrayType(STR)),
                   ("input_tokens", LONG), ("output_tokens", LONG)]
RESPONSE = _s(*RESPONSE_FIELDS)

GLOSSARY = _s(("entry_no", LONG), ("source_term", STR), ("target_lang", STR), ("translation", STR),
              ("context", STR), ("case_sensitive", BOOL), ("added_at", TS))

TM = _s(("id", LONG), ("source_text", STR), ("target_text", STR), ("source_lang", STR), ("target_lang", STR),
        ("domain", STR), ("project", STR), ("client", STR), ("tags", ArrayType(STR)), ("created_at", TS))

CACHE = _s(("key_hash", STR), ("response", RESPONSE), ("created_at", TS), ("expires_at", TS), ("tier", INT))

DOCUMENTS = _s(("doc_id", LONG), ("content", STR), ("format", STR), ("target_lang", STR), ("source_lang", STR))

PROVIDER_RESPONSES = _s(("key_hash", STR), ("provider", STR), ("model", STR), ("status", INT), ("body", STR),
                        ("ts", TS))

CALL_LOG = _s(("ts", TS), ("tool", STR), ("provider", STR), ("key_hash", STR), ("ok", BOOL), ("cached", BOOL),
              ("latency_s", DBL), ("input_text", STR), ("output_text", STR))

REQUEST_STRING_COLS = ["text", "source_lang", "target_lang", "provider", "model", "context", "tone"]
