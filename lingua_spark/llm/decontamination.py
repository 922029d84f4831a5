"""Benchmark decontamination by winnowing (operator 10).

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z as a-z. A *window* is WINDOW
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Both sides keep
the smallest K-word hash of every WINDOW - K + 1 consecutive ones (the rightmost of equals). Equal windows
hold equal K-gram hashes, so both sides select the same one of them at the same place: joining the
fingerprints finds every shared window, and comparing the WINDOW - K words on each side of a hit extends
it to every window around it. Nothing shorter than a window counts.

Items shorter than WINDOW are looked up whole: for each such length m (at most nine) the documents' m-grams
are the fingerprints, that is winnowing with a window of one gram.

Scale: documents are read once; only fingerprints that a fixed-size filter of the benchmark's lets pass
leave the scan, each with its neighbouring word hashes, and are joined by a shuffle. A filter filled by a
very large benchmark lets all pass and the result stays the same.

Defined cases: a null or wordless text or item has no words and no hits; repeated documents each get their
row; repeated items count once per item_id, an item without an id counts as hit text but not as an item;
empty tables give empty hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import cut_lineage, fresh, member, membership

WINDOW = 10
K = 5

FINGERPRINT = "array<struct<h: bigint, m: int, pos: int, ctx: array<bigint>>>"


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: the rightmost smallest hash of every w consecutive ones."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    views = sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + w - 1 - views.argmin(axis=1))


def _around(words: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Word hashes from WINDOW - K before to WINDOW - K after each K-gram; 0 beyond the ends."""
    side = WINDOW - K
    padded = np.concatenate([np.zeros(side, np.uint64), words, np.zeros(side, np.uint64)])
    return sliding_window_view(padded, 2 * side + K)[pos]


def fingerprints(words: np.ndarray, short: tuple[int, ...], bitmap: np.ndarray | None, item: bool
                 ) -> list[tuple[int, int, int, list[int]]]:
    """(hash, word count, position, surrounding words) of one text; only those in the bitmap, if given.

    An item shorter than WINDOW has one fingerprint, its whole text; a document has, besides its winnowed
    K-grams, all grams of the lengths in `short`.
    """
    out = []
    n = len(words)
    if item and 0 < n < WINDOW:
        return [(int(tk.signed(tk.grams(words, n))[0]), n, 0, [])]
    if n >= WINDOW:
        grams = tk.grams(words, K)
        pos = winnow(grams, WINDOW - K + 1)
        if bitmap is not None:
            pos = pos[member(bitmap, tk.signed(grams[pos]))]
        if len(pos):
            out += zip(tk.signed(grams[pos]).tolist(), [0] * len(pos), pos.tolist(),
                       tk.signed(_around(words, pos)).tolist(), strict=True)
    for m in short:
        grams = tk.signed(tk.grams(words, m))
        pos = np.flatnonzero(member(bitmap, grams)) if bitmap is not None else np.arange(len(grams))
        out += [(h, m, p, []) for h, p in zip(grams[pos].tolist(), pos.tolist(), strict=True)]
    return out


def _text_key(data: np.ndarray) -> int:
    """What Spark's xxhash64(text) gives."""
    h = xxhash.xxh64_intdigest(data, seed=42)
    return h - (1 << 64) if h >> 63 else h


def _scan(id_column: str, id_type: pa.DataType, short=(), bitmap=None, item=False):
    fp = pa.list_(pa.struct([("h", pa.int64()), ("m", pa.int32()), ("pos", pa.int32()), ("ctx", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            ids = batch.column(0)
            for c in tk.chunks(batch.column(1), tk.ALNUM):
                n_words, keys, found = [], [], []
                for i in range(len(c.rows)):
                    words = c.words[c.bounds[i]:c.bounds[i + 1]]
                    n_words.append(len(words))
                    keys.append(_text_key(c.data[c.offsets[i]:c.offsets[i + 1]]))
                    found.append([dict(zip(("h", "m", "pos", "ctx"), x, strict=True))
                                  for x in fingerprints(words, short, bits, item)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.rows.start, len(c.rows)).cast(id_type), pa.array(keys, pa.int64()),
                     pa.array(n_words, pa.int64()), pa.array(found, fp)], [id_column, "text_key", "n_words", "fps"])
    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scanned, hits): scanned has a row (doc_id, text_key, n_words) per document; hits has
    (doc_id, text_key, item_id, first, last) per shared stretch, word positions with `last` exclusive.
    Stretches overlap; their union is what is shared."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    items = cut_lineage(
        benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
        .mapInArrow(_scan("item_id", pa.string(), item=True), f"item_id string, text_key long, n_words long, fps {FINGERPRINT}")
        .select("item_id", F.explode("fps").alias("f")).select("item_id", "f.h", "f.m", "f.ctx").distinct())
    short = tuple(sorted(r[0] for r in items.where("m > 0").select("m").distinct().collect()))  # nine at most
    bitmap = membership(items, "h")
    scanned = cut_lineage(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_scan("doc_id", pa.int64(), short, bitmap), f"doc_id long, text_key long, n_words long, fps {FINGERPRINT}"))
    side, width = WINDOW - K, 2 * WINDOW - K
    d = (scanned.where("size(fps) > 0").select("doc_id", "text_key", F.explode("fps").alias("f"))
         .select("doc_id", "text_key", "f.h", "f.m", "f.pos", F.col("f.ctx").alias("d")).distinct())
    pairs = d.join(items.withColumnRenamed("ctx", "i"), ["h", "m"])
    same = [f"(d[{j}] = i[{j}] and d[{j}] <> 0)" for j in range(width)]
    left = "case " + " ".join(f"when not {same[side - 1 - j]} then {j}" for j in range(side)) + f" else {side} end"
    right = "case " + " ".join(f"when not {same[side + K + j]} then {j}" for j in range(side)) + f" else {side} end"
    hits = (pairs.withColumn("l", F.expr(f"case when m > 0 then 0 else {left} end"))
            .withColumn("r", F.expr(f"case when m > 0 then 0 else {right} end"))
            .where("m > 0 or (" + " and ".join(same[side:side + K]) + f" and l + r + {K} >= {WINDOW})")
            .select("doc_id", "text_key", F.col("item_id").cast(item_type),
                    (F.col("pos") - F.col("l")).alias("first"),
                    F.expr(f"pos + case when m > 0 then m else {K} + r end").alias("last")))
    return scanned.drop("fps"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, item_ids sorted as strings, contaminated) per document."""
    scanned, hits = benchmark_hits(docs, benchmark)
    hits = cut_lineage(hits.distinct())
    # n_hit: a running end of the stretches so far tells how much each one adds to their union
    spans = hits.select("doc_id", "text_key", "first", "last").distinct()
    before = F.expr("max(last) over (partition by doc_id, text_key order by first, last rows between unbounded preceding and 1 preceding)")
    words = (spans.withColumn("seen", before)
             .groupBy("doc_id", "text_key")
             .agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce("seen", F.lit(0))))).cast("long").alias("n_hit")))
    items = (hits.where("item_id is not null").groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    per_doc = (words.join(items, on=[words.doc_id.eqNullSafe(items.doc_id), words.text_key == items.text_key], how="left")
               .select(words.doc_id.alias("d"), words.text_key.alias("k"), "n_hit", "item_ids"))
    return (scanned.join(per_doc, on=[scanned.doc_id.eqNullSafe(per_doc.d), scanned.text_key == per_doc.k], how="left")
            .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(F.coalesce("item_ids", F.array().cast("array<string>"))).cast("long").alias("n_items"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark window."""
    found = decontaminate(docs, benchmark).where("contaminated")
    key, text = fresh(docs, "hit", "hit_text")
    hit = found.select(F.col("doc_id").alias(key), F.col("text_key").alias(text)).distinct()
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left_anti")
