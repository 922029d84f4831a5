"""Ranked lexical search with range-maximum queries over posting lists (operator 12).

Terms are runs of ASCII digits and letters (A-Z as a-z) and non-ASCII characters. A document's score is the sum over an
item's terms, repeats included, of weight(term) * impact(term, document), all integers (see `impacts`, `weights`).

Items come in blocks of at most BLOCK_TERMS different terms (a longer item is a block of its own), each answered by two
scans of all documents; a scan holds one block at a time:
1. document frequencies of the block's terms, and number and length of documents, summed by Spark;
2. the search. A task lays its documents out in shards of SHARD_DOCS, by length, and builds for every term of the block a
   posting list with a sparse table of range maxima over the impacts. A document interval is bounded by the sum, over the
   item's terms, of the weighted maximum inside it. The best intervals of every item come first: each is split at its
   document of maximum impact, which is scored exactly, and both remaining parts are bounded anew. Intervals bounded below
   the K-th best score that the task has seen are dropped; equal bounds stay, since a smaller doc_id wins a tie. So a
   task returns its exact best K per item, and Spark ranks those of all tasks, first per (item, salt), then per item.

Terms are known by 64-bit hashes: two of m different terms fall together with probability m^2 / 2^65.

Defined cases: null and empty texts have no terms, are no documents in N and match nothing; rows with the same doc_id are
documents of their own, and each may be ranked; a row without doc_id is ranked like others, after all ids in a tie; items
without terms return nothing; rows with the same or no item_id are items of their own whose ranks each begin at 1;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import cut_lineage, stored

TOP = 10
#: Different terms of a block of items at most (what a scan holds), unless one item has more.
BLOCK_TERMS = 1 << 16
#: Documents of a shard: their numbers take 11 bits beside an impact of at most 10^6, so both fit 31 bits.
SHARD_DOCS, DOC_BITS = 2048, 11
#: Postings at which a shard is closed before it is full.
SHARD_POSTINGS = 1 << 20
#: Intervals of one item that are split in one step.
BEAM = 32
SALTS = 64
NO_ID = np.iinfo(np.int64).max


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        m = (25 + 75 * n.astype(object) * documents // length).astype(np.int64)
    else:
        m = 25 + 75 * n * documents // max(length, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, terms, counts) per item with terms, by row; terms ascending as unsigned numbers."""
    for batch in batches:
        for c in tk.chunks(batch.column(1), tk.ALNUM):
            at, terms, counts = [], [], []
            for i in range(len(c.rows)):
                t, k = np.unique(c.words[c.bounds[i]:c.bounds[i + 1]], return_counts=True)
                if len(t):
                    at.append(c.rows.start + i)
                    terms.append(t)
                    counts.append(k.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), tk.long_lists(terms), tk.long_lists(counts)],
                                             ["item", "terms", "counts"])


class Block:
    """Items searched together: their terms, and for each item its terms' numbers and repeats, one after the other."""

    def __init__(self, items: list) -> None:
        lists = [np.array(r["terms"], np.int64).view(np.uint64) for r in items]
        self.items = [r["item"] for r in items]
        self.terms = np.unique(np.concatenate(lists))
        self.term = np.concatenate([np.searchsorted(self.terms, t) for t in lists])
        self.repeats = np.concatenate([np.array(r["counts"], np.int64) for r in items])
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in lists])])


def blocks(items: DataFrame, most: int) -> Iterator[Block]:
    """The items, read one after the other from a written table, in blocks of at most `most` different terms."""
    held, seen = [], set()
    for row in items.toLocalIterator():
        new = seen.union(row["terms"])
        if held and len(new) > most:
            yield Block(held)
            held, new = [], set(row["terms"])
        held.append(row)
        seen = new
    if held:
        yield Block(held)


def _postings(c: tk.Chunk, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the chunk, term number, tf) of the terms' occurrences."""
    at = np.searchsorted(terms, c.words)
    at[at == len(terms)] = 0
    hit = np.flatnonzero(terms[at] == c.words)
    doc = np.searchsorted(c.bounds, hit, side="right") - 1
    key, tf = np.unique(doc * len(terms) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), tf.astype(np.int64)


def _frequencies(block):
    """Per task: (term number, documents with it); (-1, documents with terms); (-2, their terms with repeats)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value.terms
        df, documents, length = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for c in tk.chunks(batch.column(0), tk.ALNUM):
                n = np.diff(c.bounds)
                documents += int((n > 0).sum())
                length += int(n.sum())
                df += np.bincount(_postings(c, terms)[1], minlength=len(terms))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [documents, length]))], ["t", "c"])
    return run


class Shard:
    """Posting lists of some documents, numbered by length, with sparse tables of range maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int) -> None:
        order = np.lexsort((doc, term))
        doc, term, impact = doc[order], term[order], impact[order]
        self.size = size
        self.present, first = np.unique(term, return_index=True)
        self.key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term)))) * (size + 1) + doc
        self.levels = [(impact.astype(np.int64) << DOC_BITS | doc).astype(np.int32)]  # the document is part of the maximum
        longest = int(np.diff(np.append(first, len(term))).max(initial=0))
        while 2 << (len(self.levels) - 1) <= longest:
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            # ranges that run over a list's end are never asked for
            self.levels.append(np.maximum(last, np.append(last[half:], np.repeat(last[-1:], half))))
        self.table = np.concatenate(self.levels)

    def maxima(self, lists: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Largest impact << DOC_BITS | document of list i's documents in [lo, hi); 0 without any."""
        base = lists * (self.size + 1)
        a, b = np.searchsorted(self.key, base + lo), np.searchsorted(self.key, base + hi)
        n = b - a
        some = n > 0
        level = np.frexp(np.maximum(n, 1))[1] - 1
        row = level * len(self.key)
        a, b = np.where(some, a, 0), np.where(some, b - (1 << level), 0)
        return np.where(some, np.maximum(self.table[row + a], self.table[row + b]), 0)


class Search:
    """A block's best documents so far: per item up to TOP of (score, doc_id), and the least score that counts."""

    def __init__(self, block: Block, weight: np.ndarray, top: int) -> None:
        self.block, self.weight, self.top = block, weight, top
        self.score = np.zeros((len(block.items), top), np.int64)  # 0: none
        self.doc = np.full((len(block.items), top), NO_ID)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Take in scored documents; per item the best stay, equal scores by ascending doc_id."""
        item = np.concatenate([np.repeat(np.arange(len(self.score)), self.top), item])
        score, doc = np.concatenate([self.score.ravel(), score]), np.concatenate([self.doc.ravel(), doc])
        order = np.lexsort((doc, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.score)))  # every item has its own TOP entries at least
        best = order[first[:, None] + np.arange(self.top)]
        self.score, self.doc = score[best], doc[best]

    def run(self, shard: Shard, ids: np.ndarray) -> None:
        """Search a shard whose document number d is ids[d]."""
        b = self.block
        number = np.searchsorted(shard.present, b.term)
        number[number == len(shard.present)] = 0
        here = np.flatnonzero(shard.present[number] == b.term)  # the items' terms that the shard holds
        lists, times = number[here], (self.weight[b.term] * b.repeats)[here]
        first = np.searchsorted(here, b.first)

        def bounds(item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bound of each interval, and its document of largest weighted impact."""
            n = (first[1:] - first[:-1])[item]
            start = np.cumsum(n) - n
            each = np.repeat(np.arange(len(item)), n)
            at = np.arange(len(each)) - start[each] + first[item][each]
            best = shard.maxima(lists[at], lo[each], hi[each]).astype(np.int64)
            part = times[at] * (best >> DOC_BITS)
            total = np.add.reduceat(np.append(part, 0), start) * (n > 0)
            peak = np.maximum.reduceat(np.append(part << DOC_BITS | best & ((1 << DOC_BITS) - 1), 0), start)
            return total, peak & ((1 << DOC_BITS) - 1)

        item = np.flatnonzero(first[1:] > first[:-1])
        lo, hi = np.zeros(len(item), np.int64), np.full(len(item), shard.size)
        bound, peak = bounds(item, lo, hi)
        while len(item):
            keep = np.flatnonzero(bound >= np.maximum(self.score[:, -1], 1)[item])
            order = keep[np.lexsort((-bound[keep], item[keep]))]
            if not len(order):
                return
            rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            now, later = order[rank < BEAM], order[rank >= BEAM]
            whose, at = item[now], peak[now]
            single = hi[now] - lo[now] == 1
            exact = bound[now].copy()  # the bound of one document is its score
            exact[~single] = bounds(whose[~single], at[~single], at[~single] + 1)[0]
            self.add(whose, exact, ids[at])
            parts = [(whose, lo[now], at), (whose, at + 1, hi[now])]
            new = [np.concatenate(x) for x in zip(*parts, strict=True)]
            some = new[1] < new[2]
            new = [x[some] for x in new]
            new_bound, new_peak = bounds(*new)
            item, lo, hi = (np.concatenate([x[later], y]) for x, y in zip((item, lo, hi), new, strict=True))
            bound, peak = np.concatenate([bound[later], new_bound]), np.concatenate([peak[later], new_peak])


def _search(block, weight, documents: int, length: int, top: int):
    """Per task: (item number, doc_id, score) of its best documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(block.value, weight.value, top)
        held: list[tuple] = []

        def close() -> None:
            if not held:
                return
            ids, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            doc = np.concatenate([h[2] + s for h, s in zip(held, np.cumsum([0] + [len(h[0]) for h in held[:-1]]), strict=True)])
            term, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            held.clear()
            order = np.lexsort((ids, n))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            if len(doc):
                found.run(Shard(place[doc], term, impacts(tf, n[doc], documents, length), len(ids)), ids[order])

        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for c in tk.chunks(batch.column(1), tk.ALNUM):
                doc, term, tf = _postings(c, block.value.terms)
                matched, doc = np.unique(doc, return_inverse=True)  # documents without any term of the block can't score
                n = np.diff(c.bounds)[matched]
                row = ids[c.rows.start + matched]
                for at in range(0, len(matched), SHARD_DOCS):
                    mine = (doc >= at) & (doc < at + SHARD_DOCS)
                    piece = (row[at:at + SHARD_DOCS], n[at:at + SHARD_DOCS], doc[mine] - at, term[mine], tf[mine])
                    if sum(len(h[0]) for h in held) + len(piece[0]) > SHARD_DOCS or sum(len(h[2]) for h in held) > SHARD_POSTINGS:
                        close()
                    held.append(piece)
        close()
        item, rank = np.nonzero(found.score)
        doc = found.doc[item, rank]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == NO_ID), pa.array(found.score[item, rank])], ["i", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): per item of items(item_id, text, ...) its `top` best documents of docs(doc_id, text, ...)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    queries = stored(items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
                     .mapInArrow(item_terms, "item long, terms array<long>, counts array<long>"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in blocks(queries, block_terms):
        block = sc.broadcast(b)
        got = rows.select("text").mapInArrow(_frequencies(block), "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).toPandas()
        count = dict(zip(got["t"].tolist(), got["c"].tolist(), strict=True))  # at most the block's terms and two
        documents, length = count.pop(-1, 0), count.pop(-2, 0)
        df = np.zeros(len(b.terms), np.int64)
        df[list(count)] = list(count.values())
        weight = sc.broadcast(weights(documents, df))
        best = cut_lineage(rows.mapInArrow(_search(block, weight, documents, length, top), "i long, doc_id long, score long"))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salted = best.withColumn("s", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        few = (salted.withColumn("r", F.row_number().over(W.partitionBy("i", "s").orderBy(*order))).where(f"r <= {top}").drop("r", "s"))
        ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(*order))).where(f"rank <= {top}")
        names = spark.createDataFrame(list(enumerate(b.items)), "i long, item_id long")  # the block's items
        out = out.unionByName(ranked.join(names, "i").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out
