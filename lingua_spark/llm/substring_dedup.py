"""Removal of repeated passages by prefix-partitioned suffix trees (operator 13).

Words are runs of characters other than ASCII white space, unchanged. A window is WINDOW consecutive words of one
document; every word inside a window that also starts anywhere else, in the same document too, is removed. Windows are
judged on the input.

The suffixes of all documents (those with WINDOW words at least) are split by prefixes of variable length into groups that
fit in memory, one suffix tree each:
- the group of a suffix is named by the smallest RUN-word run of its first WINDOW words (by a hash, the first one of equal
  ones). Suffixes that share a window share that run, at the same place, so no repeat is split; consecutive suffixes
  mostly share it too, so they travel as one piece of text and not as a copy each. A first scan counts the runs: those
  that occur once have no repeat, and a fixed-size filter of the others keeps them in the scan;
- small groups are packed into trees of about GROUP pieces. The suffixes of a tree are sorted by prefix doubling and their
  common prefixes come from the doubling's names: an internal node of depth >= WINDOW is a stretch of the sorted
  suffixes with that much in common, and all its leaves are repeated windows (the maximal repeats are their unions);
- a group of more than HEAVY pieces (a passage that very many documents share) gets its prefixes extended to the whole
  window: a window is then a node or a leaf of its own. Blocks of a scan combine equal windows before the shuffle,
  so such a group costs a row per block and window, wherever its copies lie.
Ranges found are gathered per text (equal texts have equal ranges) and cut out where the text is read again.

Words and windows are compared by hashes of 64 and 128 bits: two of m different words fall together with probability
m^2 / 2^65, two of m windows of heavy groups with m^2 / 2^129.

Defined cases: null and empty texts have no words and nothing is removed; texts of fewer than WINDOW words stay as they
are; rows with the same doc_id, or without one, are places of their own, so repeated rows remove each other's windows; very
long texts are scanned alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import cut_lineage, member, membership, release

WINDOW = 35
RUN = 8
#: Pieces of a tree, about, and pieces beyond which a group is split by whole windows: what a task holds in memory (a piece
#: has 48 words on average, 62 at most, and a word takes about 100 bytes while a tree is sorted).
GROUP, HEAVY = 4096, 8192
#: Windows of heavy groups that a scan combines at a time.
COMBINE = 1 << 17
#: Bits of a filter per member, and at most (16 MB). A filter that fills up lets more pass; the result stays the same.
BITS_EACH, MOST_BITS = 32, 1 << 27


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, u, text): t and u name a text by 128 bits."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"), text.alias("text"))


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest of every `width` consecutive hashes."""
    value, at, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        n = len(value) - step
        left = value[:n] <= value[step:]
        value, at, have = np.where(left, value[:n], value[step:]), np.where(left, at[:n], at[step:]), have + step
    return at


def _windows(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words after the last one's start, document, run hash) of each group of windows, in order, that share
    their smallest run: windows first .. last of a document."""
    none = np.zeros(0, np.int64)
    if len(c.words) < WINDOW:
        return none, none, none, none.view(np.uint64)
    runs = tk.grams(c.words, RUN)
    at = _smallest(runs, WINDOW - RUN + 1)
    doc = np.repeat(np.arange(len(c.rows)), np.diff(c.bounds))
    inside = np.flatnonzero(doc[:len(at)] == doc[WINDOW - 1:])
    if not len(inside):
        return none, none, none, none.view(np.uint64)
    at, doc = at[inside], doc[inside]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    return inside[new], inside[np.append(new[1:], len(inside)) - 1], doc[new], runs[at[new]]


def _scanned(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, tk.Chunk]]:
    for batch in batches:
        for c in tk.chunks(batch.column(column), tk.NOT_SPACE, table=tk.CASED):
            yield batch, c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c): runs that name groups, with their pieces, combined per chunk."""
    for _, c in _scanned(batches, 0):
        key, n = np.unique(_windows(c)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tk.signed(key)), pa.array(n.astype(np.int64))], ["key", "c"])


def _names(batch: pa.RecordBatch, c: tk.Chunk, doc: np.ndarray) -> list[np.ndarray]:
    rows = c.rows.start + doc
    return [batch.column(i).to_numpy()[rows] for i in (1, 2)]


def _pieces(shared, heavy):
    """(key, t, u, first, n, piece): the text of the windows first .. first + n - 1 of each small group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, apart = shared.value, heavy.value
        for batch, c in _scanned(batches, 0):
            first, last, doc, key = _windows(c)
            key = tk.signed(key)
            k = np.flatnonzero(member(wanted, key) & ~member(apart, key))
            if not len(k):
                continue
            first, last, doc = first[k], last[k], doc[k]
            # up to the next word's start, or the document's end
            ends = np.append(c.start, len(c.data))[last + WINDOW]
            begin, end = c.start[first], np.minimum(ends, c.offsets[1:][doc])
            data = c.data.tobytes()
            piece = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            t, u = _names(batch, c, doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[k]), pa.array(t), pa.array(u), pa.array(first - c.bounds[doc]), pa.array(last - first + 1), pa.array(piece, pa.binary())],
                ["key", "t", "u", "first", "n", "piece"])
    return run


def suffix_order(words: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that begin at `starts` and end with their piece (pieces begin at bounds): their order, and how many words,
    up to twice the largest power of two within WINDOW, each has in common with the one before it.

    Prefix doubling: names[k][i] numbers the 2^k words at i among all such runs; runs cut by a piece's end differ
    from all longer ones."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(words))
    names = [np.unique(words, return_inverse=True)[1] + 1]
    while 1 << len(names) <= WINDOW:
        half = 1 << (len(names) - 1)
        after = np.zeros(len(words), np.int64)
        ok = place + half < end
        after[ok] = names[-1][place[ok] + half]
        names.append(np.unique(names[-1] * (len(words) + 1) + after, return_inverse=True)[1] + 1)
    top = 1 << (len(names) - 1)
    at = starts + top
    after = np.where(at < end[starts], names[-1][np.minimum(at, len(words) - 1)], 0)
    order = np.lexsort((after, names[-1][starts]))
    a, b = starts[order][:-1], starts[order][1:]
    common = np.zeros(len(a), np.int64)
    for level in range(len(names) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x + (1 << level) <= end[a]) & (y + (1 << level) <= end[b])
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        common += np.where(fits & (names[level][x] == names[level][y]), 1 << level, 0)
    return order, np.concatenate([[0], common])


def repeated_windows(words: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the suffixes are leaves of a node of depth >= WINDOW."""
    order, common = suffix_order(words, bounds, starts)
    deep = common >= WINDOW
    out = np.zeros(len(starts), bool)
    out[order] = deep | np.append(deep[1:], False)
    return out


def _tree(pieces: pa.Table) -> pa.Table:
    """(t, u, a, b): runs a .. b of repeated windows in the pieces of one tree."""
    t, u, first, n = (pieces.column(x).to_numpy() for x in ("t", "u", "first", "n"))
    column = pieces.column("piece").combine_chunks().cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    start, words, _ = tk.word_scan(np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0], tk.NOT_SPACE, table=tk.CASED)
    bounds = np.searchsorted(start, offsets - offsets[0])
    piece = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(repeated_windows(words, bounds, bounds[piece] + inner))
    if not len(hit):
        return pa.table({x: pa.array([], pa.int64()) for x in "tuab"})
    piece, inner = piece[hit], inner[hit]
    new = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (inner[1:] != inner[:-1] + 1))))
    last = np.append(new[1:], len(hit)) - 1
    p = piece[new]
    return pa.table({"t": t[p], "u": u[p], "a": first[p] + inner[new], "b": first[p] + inner[last]})


def _whole(heavy):
    """Windows of heavy groups, COMBINE at a time: runs (t, u, a, b) of those that repeat inside the block, without n; and
    a row (g, f, n) per different window, n being 2 if it repeats, else 1, with its place."""
    names = ["g", "f", "n", "t", "u", "a", "b"]

    def combined(held: list) -> pa.RecordBatch:
        g, f, t, u, a = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((f, g))
        g1, f1 = g[order], f[order]
        new = np.concatenate(([True], (g1[1:] != g1[:-1]) | (f1[1:] != f1[:-1])))
        size = np.diff(np.append(np.flatnonzero(new), len(g1)))
        again = np.empty(len(g), bool)
        again[order] = np.repeat(size > 1, size)
        at = np.flatnonzero(again)  # in reading order, so windows of a text follow each other
        cut = np.flatnonzero(np.concatenate(([True], (t[at][1:] != t[at][:-1]) | (u[at][1:] != u[at][:-1]) | (a[at][1:] != a[at][:-1] + 1)))[:len(at)])
        last = (np.append(cut[1:], len(at)) - 1)[:len(cut)]
        runs = [t[at[cut]], u[at[cut]], a[at[cut]], a[at[last]]]
        one = order[new]
        many = size > 1
        none = np.ones(len(cut), bool)
        place = [np.concatenate([r, np.where(many, 0, x[one])]) for r, x in zip(runs, (t, u, a, a), strict=True)]
        masks = np.concatenate([np.zeros(len(cut), bool), many])
        key = [pa.array(np.concatenate([np.zeros(len(cut), np.int64), x[one]]), mask=np.concatenate([none, np.zeros(len(one), bool)])) for x in (g, f)]
        n = pa.array(np.concatenate([np.zeros(len(cut), np.int64), np.where(many, 2, 1)]))
        return pa.RecordBatch.from_arrays([*key, n, *(pa.array(x, mask=masks) for x in place)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, held, many = heavy.value, [], 0
        for batch, c in _scanned(batches, 0):
            first, last, doc, key = _windows(c)
            k = np.flatnonzero(member(apart, tk.signed(key)))
            if not len(k):
                continue
            first, n, doc = first[k], (last - first + 1)[k], doc[k]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            g, f = (tk.signed(tk.grams(w, WINDOW)[at]) for w in (c.words, tk.mix(c.words ^ np.uint64(0x5851F42D4C957F2D))))
            for i in range(0, len(at), COMBINE):
                s = slice(i, i + COMBINE)
                held.append((g[s], f[s], *_names(batch, c, doc[s]), at[s] - c.bounds[doc[s]]))
                many += len(at[s])
                if many >= COMBINE:
                    yield combined(held)
                    held, many = [], 0
        if held:
            yield combined(held)
    return run


def repeats(rows: DataFrame) -> DataFrame:
    """(t, u, ranges) per text with repeated windows: ranges of the first words a .. b of such windows, in any order."""
    spark = rows.sparkSession
    text = rows.select("text", "t", "u")
    shared = cut_lineage(text.select("text").mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where("c > 1"))
    large = F.col("c") > HEAVY
    size = shared.agg(F.count("*").alias("keys"), F.sum(F.when(~large, F.col("c"))).alias("pieces"), F.count_if(large).alias("heavy")).first()

    def bits(members: int) -> int:
        return 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * members).bit_length()))

    wanted = membership(shared, "key", bits(size["keys"]))
    apart = membership(shared.where(large), "key", bits(size["heavy"]))
    trees = max(1, -(-(size["pieces"] or 0) // GROUP))
    found = (text.mapInArrow(_pieces(wanted, apart), "key long, t long, u long, first long, n long, piece binary")
             .withColumn("tree", F.pmod(F.xxhash64("key"), F.lit(trees))).groupBy("tree").applyInArrow(_tree, "t long, u long, a long, b long"))
    if size["heavy"]:
        whole = cut_lineage(text.mapInArrow(_whole(apart), "g long, f long, n long, t long, u long, a long, b long"))
        release(spark)
        several = whole.where("n > 0").groupBy("g", "f").agg(F.sum("n").alias("c")).where("c > 1").select("g", "f")
        found = found.unionByName(whole.where("n = 0").select("t", "u", "a", "b")).unionByName(
            whole.where("n = 1").join(several, ["g", "f"], "left_semi").select("t", "u", "a", "b"))
    out = cut_lineage(found.distinct().groupBy("t", "u").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    release(spark)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, removed, kept) from (text, doc_id, ranges); without ranges nothing goes."""
    for batch, c in _scanned(batches, 0):
        covered = np.zeros(len(c.words) + 1, np.int64)
        if batch.num_columns > 2:
            lists = batch.column(2).slice(c.rows.start, len(c.rows))
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            a, b = (c.bounds[owner] + flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(covered, a, 1)
            np.add.at(covered, b + WINDOW, -1)
        gone = np.cumsum(covered[:-1]) > 0
        doc = np.repeat(np.arange(len(c.rows)), np.diff(c.bounds))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))  # a removed stretch ends with its document at the latest
        cuts = np.unique(np.concatenate([edge, c.bounds]))
        begins, ends = cuts[:-1], cuts[1:]
        mine = gone[begins] if len(begins) else np.zeros(0, bool)
        begins, ends = begins[mine], ends[mine]
        of = doc[begins]
        spans = pa.StructArray.from_arrays([pa.array(x - c.bounds[of]) for x in (begins, ends)], ["start", "end"])
        at = np.searchsorted(of, np.arange(len(c.rows) + 1))
        # kept words' bytes, each with the byte before it as its space unless it is its document's first
        inside = tk.NOT_SPACE[c.data]
        word = np.cumsum(np.bincount(c.start, minlength=len(c.data) + 1)[:len(c.data)]) - 1
        left = ~gone
        take = inside & left[np.maximum(word, 0)] if len(c.words) else np.zeros(len(c.data), bool)
        kept = np.flatnonzero(left)
        later = kept[1:][doc[kept[1:]] == doc[kept[:-1]]]
        data = c.data.copy()
        data[c.start[later] - 1] = 32
        take[c.start[later] - 1] = True
        size = np.concatenate(([0], np.cumsum(take)))[c.offsets]
        body = pa.LargeStringArray.from_buffers(len(c.rows), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[take])).cast(pa.string())
        n_words = np.diff(c.bounds)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).slice(c.rows.start, len(c.rows)), pa.array(n_words), pa.array(np.bincount(doc[gone], minlength=len(c.rows))),
             pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans), body], ["doc_id", "n_words", "n_removed", "removed", "kept"])


def _having(bitmap):
    """Rows (text, doc_id, t, ...) whose text the filter may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            yield batch.filter(pa.array(member(bits, batch.column(2).to_numpy())))
    return run


def _uncut(bitmap):
    """Results of all other rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            left = batch.filter(pa.array(~member(bits, batch.column(2).to_numpy())))
            yield from _cut(iter([left.select(["text", "doc_id"])]))
    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) for every row of docs(doc_id, text, ...): `removed` are word ranges
    [start, end), `kept` is the text of the words left, joined by one space."""
    rows = _rows(docs)
    found = repeats(rows)
    kind = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
    with_repeats = membership(found, "t", 1 << 25)
    columns = rows.select("text", "doc_id", "t", "u")
    clean = columns.mapInArrow(_uncut(with_repeats), kind)
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    others = (columns.mapInArrow(_having(with_repeats), columns.schema).join(found, ["t", "u"], "left")
              .select("text", "doc_id", F.coalesce("ranges", none).alias("ranges")).mapInArrow(_cut, kind))
    return clean.unionByName(others)
