"""Document fingerprints by one-permutation MinHash (operator 9).

A text is the set of its five-word shingles (words as in the near-duplicate operator). Each shingle is hashed
once; the top bits choose one of BINS bins and the smallest hash of a bin is its value. Empty bins are filled
by optimal densification: each one has its own fixed random order of the bins and takes the value of the first
that is filled. Of every value BITS low bits are stored, packed and written as hexadecimal digits.
Likeness is the share m of equal bins, corrected for chance matches of BITS bits: (m - c) / (1 - c) with
c = 2^-BITS, held within 0 and 1.

`compare_with_edits` pairs every text with the next one (ascending doc_id, the first after the last) in one
range-partitioned, streamed pass. Rows at the partitions' ends are paired afterwards, over one row per partition.

Defined cases: null texts are empty; a text without words has the empty fingerprint, which is like (1.0) only
another empty one; rows with equal doc_id follow each other by text, rows without doc_id come first; repeated
rows each get a row; a single document is its own next one; an empty table gives an empty result; extra columns
are ignored. A text is processed whole, so memory in a task is bounded by a batch or the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import cut_lineage

BINS, BITS = 256, 4

_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
#: Each bin hashes its value once more, so chance matches of bins that hold the same value are independent.
_SALT = np.random.default_rng(978).integers(0, 2**63, BINS, dtype=np.uint64)
#: For each bin, the order in which it tries the others.
_ORDER = np.argsort(np.random.default_rng(977).random((BINS, BINS)), axis=1)


def fingerprint(words: np.ndarray) -> bytes:
    """Packed low-order bits of the densified bin minima; b"" without words."""
    s = np.sort(tk.shingles(words))
    if not len(s):
        return b""
    bins = (s >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    value = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    value[bins[first]] = s[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        value[empty] = value[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    low = (tk.mix(value ^ _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    m = (np.count_nonzero(x >> 4 == 0) + np.count_nonzero(x & 15 == 0)) / BINS
    c = 2.0 ** -BITS
    return min(1.0, max(0.0, (m - c) / (1 - c)))


def fingerprints_of(texts: pa.Array) -> list[bytes]:
    return [fingerprint(c.words[c.bounds[i]:c.bounds[i + 1]])
            for c in tk.chunks(texts, tk.NOT_SPACE) for i in range(len(c.rows))]


def edit(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_FIELDS = [("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
           ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
           ("text", pa.string())]
_DDL = ("part int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, text string")


def _paired(ids: list, texts: list[str], prints: list[bytes], following: list[str], next_prints: list[bytes], part: int) -> pa.RecordBatch:
    edited = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    edited_prints = fingerprints_of(pa.array(edited, pa.large_string()))
    columns = [[part] * len(ids), [0] * len(ids), ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited],
               [p.hex() for p in prints], [p.hex() for p in edited_prints],
               [likeness(a, b) for a, b in zip(prints, edited_prints, strict=True)],
               [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)], [None] * len(ids)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _end(part: int, kind: int, doc_id, text: str, print_: bytes) -> pa.RecordBatch:
    row = {"part": part, "kind": kind, "doc_id": doc_id, "fingerprint": print_.hex(), "text": text}
    return pa.RecordBatch.from_pylist([row], pa.schema(_FIELDS))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows -> each with its next one (kind 0); the first (kind 1) and last (kind 2) row of the partition with their texts."""
    part = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            piece = batch.slice(at, 1000)
            column = piece.column(1).fill_null("")
            ids, texts, prints = piece.column(0).to_pylist(), column.to_pylist(), fingerprints_of(column)
            if held is None:
                yield _end(part, 1, ids[0], texts[0], prints[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                yield _paired(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:], part)
    if held is not None:
        yield _end(part, 2, *held)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        own, following = ([bytes.fromhex(x) for x in d[k]] for k in ("fingerprint", "next_fingerprint"))
        if own:
            yield _paired(d["doc_id"], d["text"], own, d["next_text"], following, 0)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = cut_lineage(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_stream, _DDL))
    parts = sorted(r[0] for r in done.where("kind = 1").select("part").collect())  # a number per partition with rows
    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if not parts:
        return done.select(*result)
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, next_part int")
    firsts = done.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                                           F.col("fingerprint").alias("next_fingerprint"))
    lasts = (done.where("kind = 2").join(following, "part").join(firsts, "next_part")
             .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_ends, _DDL))
    return done.where("kind = 0").select(*result).union(lasts.select(*result))
