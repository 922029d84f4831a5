"""Language detection: LD-1 n-gram profiles (Cavnar & Trenkle 1994), LD-2 detection.

The reference asks a remote model; here a profile of the most frequent character n-grams
per language is trained on labelled rows and each text is scored by integer hit counts.
Every rune of every text counts, in training and in detection. Grams are counted where the texts are, a few texts at
a time, as integers (up to 3 code points in 63 bits): no row per gram is made or shuffled. A detection row holds its own
text's answer, also where ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lingua_spark.functions.text import normalize_language
from lingua_spark.session import small_batches

#: Code points of the texts whose grams are in memory together (a longer text comes alone), and their number at most.
CHUNK_RUNES, CHUNK_TEXTS = 1 << 18, 256
#: Longest grams: so many code points of 21 bits are one integer.
MAX_GRAM = 3


def _check(n: int) -> None:
    if not 1 <= n <= MAX_GRAM:
        raise ValueError(f"grams have 1 to {MAX_GRAM} code points")


def _keys(code: np.ndarray, n: int) -> np.ndarray:
    """One integer for each run of n code points."""
    m = max(0, len(code) - n + 1)
    key = np.zeros(m, np.int64)
    for j in range(n):
        key = (key << 21) | code[j:j + m]
    return key


def _chunks(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, grams, text of each gram counted from the first) for a few texts at a time; null has no gram."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    i = 0
    while i < len(size):
        j = max(i + 1, min(i + CHUNK_TEXTS, int(np.searchsorted(total, total[i] + CHUNK_RUNES, side="right")) - 1))
        code = np.frombuffer("".join(t or "" for t in texts.slice(i, j - i).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        key = _keys(code, n)
        text = np.repeat(np.arange(j - i), size[i:j])
        own = text[:len(key)] == text[n - 1:]  # not across the end of a text
        yield i, j, key[own], text[:len(key)][own]
        i = j


def _count_grams(n: int):
    """Grams of rows (lang, text) with their counts, one row per gram and language of a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.fill_null(len(langs.dictionary)).to_numpy(zero_copy_only=False)
            names = [*langs.dictionary.to_pylist(), None]
            for i, j, key, text in _chunks(batch.column(1), n):
                of = code[i:j][text]
                for k in np.unique(of):
                    grams, count = np.unique(key[of == k], return_counts=True)
                    spelt = np.empty((len(grams), n), np.uint32)
                    for p in range(n):
                        spelt[:, p] = (grams >> (21 * (n - 1 - p))) & 0x1FFFFF
                    joined = spelt.tobytes().decode("utf-32-le")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[k]] * len(grams), pa.string()), pa.array([joined[x:x + n] for x in range(0, len(joined), n)], pa.string()),
                         pa.array(count.astype(np.int64))], ["lang", "gram", "cnt"])
    return run


def train_language_profiles(docs: DataFrame, n: int = 3, top: int = 300, text_col: str = "text",
                            lang_col: str = "lang") -> DataFrame:
    """LD-1: (lang, gram, cnt, rank): the `top` most frequent grams per language
    (ties by gram). Every chunk of texts counts its own grams, a grouped aggregate adds them up."""
    _check(n)
    small_batches(docs.sparkSession)
    counts = (docs.select(normalize_language(lang_col).alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text"))
              .mapInArrow(_count_grams(n), "lang string, gram string, cnt long").groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt")))
    w = Window.partitionBy("lang").orderBy(F.col("cnt").desc(), F.col("gram"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def detect_language(df: DataFrame, profiles: DataFrame, id_col: str = "row_id", text_col: str = "text",
                    n: int = 3) -> DataFrame:
    """LD-2: (id, language, confidence). Hits = grams of the text found in a language's
    profile (with multiplicity); best = most hits, ties by code; confidence = best / all hits.
    No hit -> ('auto', 0.0). The profile table (languages x top) is small and goes to every task."""
    _check(n)
    small_batches(df.sparkSession)
    rows = profiles.select("lang", "gram").distinct().collect()
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, x))
    grams = sorted({r["gram"] for r in rows if r["gram"] is not None and len(r["gram"]) == n})
    known = np.array([_keys(np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.int64), n)[0] for g in grams], np.int64)
    order = np.argsort(known)
    at = {grams[g]: i for i, g in enumerate(order)}
    listed = np.zeros((len(grams), len(langs)))
    for r in rows:
        if r["gram"] in at:
            listed[at[r["gram"]], langs.index(r["lang"])] = 1
    known = known[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, confidence = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for i, j, key, text in _chunks(batch.column(1), n) if len(known) else ():
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[place] == key
                hits = np.bincount(text[hit] * len(known) + place[hit], minlength=(j - i) * len(known)).reshape(j - i, -1) @ listed
                some = hits.any(axis=1)
                best[i:j] = np.where(some, hits.argmax(axis=1), -1)  # the first of the best
                confidence[i:j] = np.divide(hits.max(axis=1), hits.sum(axis=1), out=np.zeros(j - i), where=some)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([langs[k] if k >= 0 else None for k in best], pa.string()), pa.array(confidence)], [id_col, "language", "confidence"])

    out = StructType([df.schema[id_col], *StructType.fromDDL("language string, confidence double").fields])
    return (df.select(id_col, F.lower(F.col(text_col).cast("string")).alias("text")).mapInArrow(run, out)
            .select(id_col, F.coalesce("language", F.lit("auto")).alias("language"), "confidence"))
