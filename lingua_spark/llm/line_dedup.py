"""Near-duplicate lines by an exact set-similarity join (operator 3).

A line (between line feeds) is the set of its five-word shingles, words being runs of bytes other than ASCII
white space, A-Z as a-z. A line of one to four words is the set of one shingle, its whole word sequence; lines without
words are left alone. A line goes when an earlier one, by (doc_id, line number), has Jaccard >= 0.75 with it, whether
or not that one stays itself.

Join: exact copies fall to one line per set first (a grouped minimum). Shingles are ordered by rarity (corpus counts
in COUNT_SLOTS hashed slots, then the hash). Two lines at the threshold share a shingle among the first
n - ceil(0.75 n) + 1 of each, so only those are posted, and of these only shingles that more than one line posts: a
first, narrow shuffle of 32 bits each finds them, a fixed-size filter of the shared ones lets the others stay in the scan. In each
posting list every line is compared with the list's earliest one; only lines without a match yet go on to the next FAN
entries, then to twice as many, and so on, so a group of near copies costs one comparison each, while every list is worked through for
the lines that need it. Comparisons pass a length, a positional and a parity filter (64 bits of a set, which bound from below
how many shingles only one of two lines has) and are verified on the full shingle sets, read again for the lines in question alone. Filters that fill up let more pass; the result stays the same.

Defined cases: null and empty texts have no lines to remove; rows without doc_id are neither removed from nor a
reason for removal; rows with the same doc_id are one document: they never match each other's same line, and a line
number removed goes from all of them; an empty table gives empty results; extra columns are kept, whatever their names. A very
long text is scanned alone, in memory that follows its length. Lines and shingles are compared by 128- and 64-bit hashes: two of
m shingles fall together with probability m^2 / 2^65.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import cut_lineage, delete_folder, fresh, member, membership, release, scratch_folder

THRESHOLD = 75
#: Slots of the corpus counts that order shingles; a fixed table of 0.5 MB.
COUNT_SLOTS = 1 << 16
FAN = 32
#: Bits of the filter of shared shingles: 4 MB, whatever their number.
KEY_BITS = 1 << 25
#: Pairs up to which verifying waits for later rounds.
WAITING_PAIRS = 1 << 17
#: Slices of that filter, made in one place each, and shingles that a scan holds before it hands them on.
SLICES, HELD_KEYS = 1 << 9, 1 << 20


def _line_shingles(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line of each shingle, shingle hashes, document of each line, number of each line in its document)."""
    newline = np.flatnonzero(c.data == 10) + 1
    begins = np.unique(np.concatenate([c.offsets[:-1], newline]))
    begins = begins[begins < len(c.data)]  # documents without text have no words
    doc = np.searchsorted(c.offsets, begins, side="right") - 1
    # an empty document shares its offset with the next one and has no words
    number = np.arange(len(begins)) - np.searchsorted(begins, c.offsets[doc])
    line = np.searchsorted(begins, c.start, side="right") - 1
    h = tk.grams(c.words, tk.SHINGLE)
    whole = line[:len(h)] == line[tk.SHINGLE - 1:] if len(h) else np.zeros(0, bool)
    lines, hashes = [line[:len(h)][whole]], [h[whole]]
    first = _starts(line) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(line)))
    for k in range(1, tk.SHINGLE):  # short lines: their words alone, one after the other
        at = first[size == k]
        lines.append(line[at])
        hashes.append(tk.grams(c.words[(at[:, None] + np.arange(k)).ravel()], k)[::k])
    return np.concatenate(lines), np.concatenate(hashes), doc, number


def _ordered(line: np.ndarray, h: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, shingle), by line, then rarity: the count's leading digits, then the hash."""
    order = np.argsort(h)
    line, h = line[order], h[order]
    if counts is not None:
        line, h = _by_16_bits(_digits(counts)[(h & np.uint64(COUNT_SLOTS - 1)).astype(np.int64)], line, h)
    line, h = _by_16_bits(line & 0xFFFF, line, h)
    if len(line) and line.max() > 0xFFFF:  # of one very long text
        order = np.argsort(line, kind="stable")
        line, h = line[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return line[new], h[new]


def _by_16_bits(by: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """Arrays in stable order of 16-bit numbers, which numpy sorts digit by digit."""
    order = np.argsort(by.astype(np.uint16), kind="stable")
    return [a[order] for a in arrays]


def _digits(counts: np.ndarray) -> np.ndarray:
    """Counts to 9 binary digits, as 16-bit numbers in the same order."""
    return (counts.astype(np.float32).view(np.uint32) >> np.uint32(15)).astype(np.uint16)


def _starts(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, line, n, s, t) per line with shingles, s and t being its set hash; and, without doc, the count slots, three to a
    row: n, s and t count slots 3 * line and the next two. Lines of documents without an id are counted only."""
    names = ["doc", "line", "n", "s", "t"]
    counts = np.zeros(COUNT_SLOTS, np.int64)
    for batch in batches:
        ids, ok = _ids(batch)
        for c in tk.chunks(batch.column(1), tk.NOT_SPACE):
            line, h, doc, number = _line_shingles(c)
            counts += np.bincount((h & np.uint64(COUNT_SLOTS - 1)).astype(np.int64), minlength=COUNT_SLOTS)
            line, h = _ordered(line, h, None)
            if not len(h):
                continue
            first = _starts(line)
            s, t = (np.add.reduceat(tk.mix(h ^ np.uint64(x)), first) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            at, size = line[first], np.diff(np.append(first, len(h)))
            row = doc[at] + c.rows.start
            k = ok[row]
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (ids[row], number[at], size, tk.signed(s), tk.signed(t))], names)
    threes = np.append(counts, np.zeros(-COUNT_SLOTS % 3, np.int64)).reshape(-1, 3)
    row = np.flatnonzero(threes.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.nulls(len(row), pa.int64()), pa.array(row), *(pa.array(x) for x in threes[row].T)], names)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids (0 for none), and which there are."""
    return (batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False),
            batch.column(0).is_valid().to_numpy(zero_copy_only=False))


def shingle_counts(lines: DataFrame) -> Broadcast:
    """Corpus counts of all line shingles, in a table of fixed size."""
    got = lines.where("doc is null").groupBy("line").agg(*(F.sum(c).alias(c) for c in "nst")).toPandas()  # COUNT_SLOTS / 3 rows at most
    counts = np.zeros((-(-COUNT_SLOTS // 3), 3), np.int64)
    counts[got["line"].to_numpy(np.int64)] = got[["n", "s", "t"]].to_numpy(np.int64)
    return lines.sparkSession.sparkContext.broadcast(counts.ravel()[:COUNT_SLOTS])


def _post(counts: Broadcast, copies: Broadcast, rescued: Broadcast, shared: Broadcast | None):
    """Postings of all lines that are no copies: the shingle alone, or, given the shared ones, full entries of those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, copy, keep_anyway = counts.value, copies.value, rescued.value
        bits = shared.value if shared is not None else None
        for batch in batches:
            ids, ok = _ids(batch)
            for c in tk.chunks(batch.column(1), tk.NOT_SPACE):
                line, h, doc, number = _line_shingles(c)
                row = doc + c.rows.start
                key = _line_key(ids[row], number)
                mine = (ok[row] & (~member(copy, key) | member(keep_anyway, key)))[line]
                line, h = _ordered(line[mine], h[mine], table)
                if not len(h):
                    continue
                first = _starts(line)
                size = np.diff(np.append(first, len(h)))
                pos = np.arange(len(h)) - np.repeat(first, size)
                each, size = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
                keep = pos < size - -(-THRESHOLD * size // 100) + 1
                if bits is None:
                    yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h[keep]))], ["key"])
                    continue
                keep &= member(bits, tk.signed(h))
                parity = _parity(h, first)[each[keep]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (tk.signed(h[keep]), ids[row[line[keep]]], number[line[keep]], size[keep], pos[keep], tk.signed(parity))],
                    ["key", "doc", "line", "n", "pos", "parity"])
    return run


def _parity(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits of each set, bit i telling whether it has an odd number of elements that fall to i. Every bit in which two
    sets differ takes an element that only one of them has."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), first)


def _shared_keys(rows: DataFrame, counts: Broadcast, copies: Broadcast, rescued: Broadcast) -> Broadcast:
    """Filter of the shingles that several lines post, as `membership` gives it with KEY_BITS.

    Each of SLICES keys of the shuffle owns a slice of the filter. A shingle is 32 bits there, those of its place in the
    slice and others of its hash; shingles that agree in slice and bits count as one, which lets a few more through."""
    scan, filter_bits, most_held = _post(counts, copies, rescued, None), KEY_BITS, HELD_KEYS
    width = max(64, filter_bits // SLICES)
    place = width.bit_length() - 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in scan(batches):
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= most_held:
                yield by_slice(np.concatenate(held))
                held, size = [], 0
        if held:
            yield by_slice(np.concatenate(held))

    def by_slice(h: np.ndarray) -> pa.RecordBatch:
        at = h & np.uint64(filter_bits - 1)
        part = (at >> np.uint64(place)).astype(np.int32)
        small = (at & np.uint64(width - 1) | h // np.uint64(filter_bits) << np.uint64(place)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        part, small = part[order], small[order]
        first = _starts(part)
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([x.tobytes() for x in np.split(small, first[1:])], pa.binary())],
                                          ["part", "keys"])

    def merged(table: pa.Table) -> pa.Table:
        small = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]))
        bits = np.zeros(width, np.uint8)
        bits[small[1:][small[1:] == small[:-1]] & np.uint32(width - 1)] = 1
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((filter_bits // width, width // 64), np.uint64)
    for r in (rows.mapInArrow(packed, "part int, keys binary").groupBy("part").applyInArrow(merged, "part int, bits binary")).collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint64)
    return rows.sparkSession.sparkContext.broadcast(out.ravel())


def _line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return tk.signed(tk.mix(tk.mix(doc.view(np.uint64)) + line.view(np.uint64)))


def _line_filter(lines: DataFrame, documents: bool = False) -> Broadcast:
    """Filter of lines(doc, line); with documents, of their documents too, as line -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, line = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            h = [_line_key(doc, line)] + [_line_key(doc, np.full(len(doc), -1, np.int64))] * documents
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h))], ["h"])
    return membership(lines.select("doc", "line").mapInArrow(run, "h long"), "h")


def _passing(bitmap: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            yield b.filter(pa.array(member(bits, _line_key(*(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))))))
    return run


def _sets(bitmap: Broadcast):
    """Shingle sets of the lines in the bitmap (documents are in it as line -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            ids, ok = _ids(batch)
            keep = member(bits, _line_key(ids, np.full(len(ids), -1, np.int64))) & ok
            if not keep.any():
                continue
            batch, ids = batch.filter(pa.array(keep)), ids[keep]
            for c in tk.chunks(batch.column(1), tk.NOT_SPACE):
                line, h, doc, number = _line_shingles(c)
                row = ids[doc + c.rows.start]
                wanted = member(bits, _line_key(row, number))
                mine = wanted[line]
                line, h = _ordered(line[mine], h[mine], None)
                if not len(h):
                    continue
                first = _starts(line)
                at = line[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[at]), pa.array(number[at]), tk.long_lists(np.split(h, first[1:]))], ["doc", "line", "items"])
    return run


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs(doc, line, e_doc, e_line) those at the threshold, by their full shingle sets."""
    lines = pairs.select("doc", "line").union(pairs.select("e_doc", "e_line")).distinct()
    bitmap = _line_filter(lines, documents=True)
    # both sides of the join read one shuffle of the sets
    sets = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(_sets(bitmap), "doc long, line long, items array<long>").repartition("doc", "line").dropDuplicates(["doc", "line"]))
    early = sets.select(F.col("doc").alias("e_doc"), F.col("line").alias("e_line"), F.col("items").alias("e_items"))
    shared = F.size(F.array_intersect("items", "e_items"))
    return (pairs.join(sets, ["doc", "line"]).join(early, ["e_doc", "e_line"]).withColumn("i", shared)
            .where(100 * F.col("i") >= THRESHOLD * (F.size("items") + F.size("e_items") - F.col("i")))
            .select(*pairs.columns))


def _found(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, line, e_doc, e_line): the lines of pairs(doc, line, e_doc, e_line, turn) with a match, and the earliest of the first
    turn that has one."""
    return cut_lineage(_verified(docs, pairs).groupBy("doc", "line").agg(F.min(F.struct("turn", "e_doc", "e_line")).alias("e"))
                       .select("doc", "line", "e.e_doc", "e.e_line"))


def _possible() -> str:
    """Length, positional and parity filter at a shared posting: what can still be shared suffices."""
    most = "least(n - pos, e_n - e_pos)"
    return (f"100 * least(n, e_n) >= {THRESHOLD} * greatest(n, e_n) and "
            f"100 * {most} >= {THRESHOLD} * (n + e_n - {most}) and not (doc = e_doc and line = e_line) and "
            f"{100 + THRESHOLD} * bit_count(parity ^ e_parity) <= {100 - THRESHOLD} * (n + e_n)")


def later_matches(docs: DataFrame) -> DataFrame:
    """(doc, line, e_doc, e_line): every line to remove, with an earlier line that it matches."""
    pair = ["doc", "line", "e_doc", "e_line"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # as Parquet: a third of a checkpoint's disk, and each step below reads the columns it needs
    folder, scanned = f"{scratch_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}", rows.mapInArrow(_lines, "doc long, line long, n long, s long, t long")
    scanned.write.parquet(folder)
    lines = docs.sparkSession.read.schema(scanned.schema).parquet(folder)
    counts = shingle_counts(lines)
    named = lines.where("doc is not null")
    again = named.groupBy("s", "t", "n").agg(F.min(F.struct("doc", "line")).alias("e"), F.count("*").alias("rows")).where("rows > 1")
    copies = cut_lineage(named.join(again, ["s", "t", "n"]).select("doc", "line", F.col("e.doc").alias("e_doc"), F.col("e.line").alias("e_line"))
                         .where("not (doc = e_doc and line = e_line)").groupBy("doc", "line").agg(F.min(F.struct("e_doc", "e_line")).alias("e"))
                         .select("doc", "line", "e.*"))
    copy = _line_filter(copies)
    # lines that the filter of copies holds only by chance
    rescued = _line_filter(named.select("doc", "line").mapInArrow(_passing(copy), "doc long, line long")
                           .join(copies.select("doc", "line"), ["doc", "line"], "left_anti"))
    release(docs.sparkSession)
    shared = _shared_keys(rows, counts, copy, rescued)
    posted = rows.mapInArrow(_post(counts, copy, rescued, shared), "key long, doc long, line long, n long, pos long, parity long")

    by_key = W.partitionBy("key").orderBy("doc", "line")
    entry = F.struct(*(F.col(c).alias(f"e_{c}") for c in ("doc", "line", "n", "pos", "parity")))
    lists = cut_lineage(posted.withColumn("rank", F.row_number().over(by_key))
                        .withColumn("more", F.lead(F.lit(True)).over(by_key))
                        .withColumn("e", F.first(entry).over(by_key))
                        .where("rank > 1 or more").drop("more").select("*", "e.*").drop("e"))
    delete_folder(docs.sparkSession, folder)
    release(docs.sparkSession)
    removed = copies
    waiting, n_waiting, turn = None, 0, 0
    tested = cut_lineage(lists.where("rank > 1").where(_possible()).select(*pair).distinct())
    first, fan = 2, FAN
    while True:
        # a few pairs wait for those of later rounds: verifying reads the documents again
        n_waiting, turn = n_waiting + tested.count(), turn + 1
        tested = tested.withColumn("turn", F.lit(turn))
        waiting = tested if waiting is None else waiting.union(tested)
        if n_waiting > WAITING_PAIRS:
            removed = removed.union(_found(docs, waiting))
            waiting, n_waiting = None, 0
            release(docs.sparkSession)
        todo = cut_lineage(lists.where(f"rank > {first}").select("key", "doc", "line", "n", "pos", "parity", "rank")
                           .join(removed.select("doc", "line"), ["doc", "line"], "left_anti"))
        if todo.isEmpty():
            return removed.union(_found(docs, waiting)) if n_waiting else removed
        early = lists.where(f"rank >= {first} and rank < {first + fan}").select(
            "key", F.col("rank").alias("e_rank"), *(F.col(c).alias(f"e_{c}") for c in ("doc", "line", "n", "pos", "parity")))
        tested = cut_lineage(todo.join(early, "key").where("rank > e_rank").where(_possible()).select(*pair).distinct())
        first, fan = first + fan, 2 * fan


def removed_lines(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, removed (line numbers, ascending), matched (doc_ids of the earlier lines, ascending)."""
    gone = (later_matches(docs).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("removed"),
                                                  F.array_sort(F.collect_set("e_doc")).alias("matched")))
    none = F.array().cast("array<bigint>")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(gone, F.col("doc_id") == gone["doc"], "left")
            .select("doc_id", F.coalesce("removed", none).alias("removed"), F.coalesce("matched", none).alias("matched")))


def drop_later_lines(docs: DataFrame) -> DataFrame:
    """docs with their later near-duplicate lines taken out of text; a document left without any line goes.

    Of the columns of documents, n_chars follows the new text; all others stay.
    """
    key, gone = fresh(docs, "doc", "removed")
    found = (later_matches(docs).withColumnRenamed("doc", key).groupBy(key)
             .agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias(gone)))
    lines = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    untouched = F.col(gone).isNull()
    out = (docs.join(found, F.col("doc_id").cast("long") == F.col(key), "left")
           .where(untouched | (F.size(gone) < F.size(lines)))
           .withColumn("text", F.when(untouched, F.col("text")).otherwise(F.array_join(left, "\n"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
