"""Near-duplicate documents by circulant MinHash (operator 2).

Words are runs of bytes other than ASCII white space, A-Z as a-z; a document is the set of its five-word
shingles (fewer words: the whole sequence as one). Two documents are linked at Jaccard >= 0.75, checked on
the full sets; components of links are the groups, named by their smallest doc_id.

Circulant MinHash: shingles are 32-bit points, sigma and pi two fixed permutations of that ring, and
coordinate k of a signature is the minimum of pi(sigma(x) + k): pi shifted circularly by k. One permutation
shuffles, the other one, shifted, gives every coordinate.

Steps:
1. one scan gives set size, a 128-bit set hash and ROWS-coordinate bands; equal sets become one class;
2. in each band bucket every class is compared with the smallest one (a star, never all pairs); verified
   links give components;
3. members of buckets that still hold several components get the rest of their comparisons, each pair once for all
   buckets: a prefix-filtered join of their shingle sets. Shingles are ordered by rarity (counts in COUNT_SLOTS
   hashed slots); of a pair at the threshold the smaller set has one of its n - ceil(6/7 n) + 1 rarest among the
   n - ceil(0.75 n) + 1 rarest of the larger. Lists of one component are dropped, a length and a positional
   filter apply. So documents that merely share a passage, however many, do not meet: what is rare in them is their own;
4. before the full sets of a pair are fetched and compared, SKETCH coordinates must agree well enough.
A pair at the threshold is missed by all bands with probability (1 - 0.75^ROWS)^BANDS = 5e-6, and only if no other path
links it. Sets are known by 128-bit and shingles by 64-bit hashes: two of m shingles fall together with probability m^2 / 2^65.

Defined cases: texts without words, and null texts, link with nothing; rows with the same doc_id are one node;
a row without doc_id links with nothing, has a null component and is kept; repeated rows each get a row;
an empty table gives an empty result; extra columns are ignored. A very long text is scanned alone, in memory that
follows its length. Of rows with one doc_id and different texts, `keep_one_of_each` keeps the smallest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import connected_components, cut_lineage, fresh, member, membership, release

#: Jaccard threshold as a fraction of integers: 100 * intersection >= 75 * union.
THRESHOLD = 75
BANDS, ROWS = 32, 4
#: Slots of the shingle counts that order sets by rarity: a table of 1 MB, whatever the number of shingles.
COUNT_SLOTS = 1 << 18
#: Bits of the filter that lets band keys of buckets with more than one class pass: 4 MB, whatever their number.
KEY_BITS = 1 << 25
#: Coordinates (one byte each) by which candidate pairs are looked at before their sets are fetched, and how many must agree:
#: at the threshold 192 +- 6.9 do, so a linked pair is turned away with probability below 1e-9.
SKETCH, ALIKE = 256, 150

_M1, _M2, _M3, _M4 = (np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x7FEB352D, 0x846CA68B))


def _sigma(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * _M1
    x = x ^ (x >> np.uint32(13))
    x = x * _M2
    return x ^ (x >> np.uint32(16))


def _pi(x: np.ndarray) -> np.ndarray:
    """In place: x is a scratch block."""
    y = x >> np.uint32(16)
    x ^= y
    x *= _M3
    np.right_shift(x, np.uint32(15), out=y)
    x ^= y
    x *= _M4
    np.right_shift(x, np.uint32(16), out=y)
    x ^= y
    return x


def signature(shingle_hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of a non-empty set, in blocks of bounded size."""
    x = _sigma((shingle_hashes >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(coordinates, dtype=np.uint32)
    out = np.full(coordinates, np.uint32(0xFFFFFFFF))
    step = max(1, 32768 // coordinates)
    for i in range(0, len(x), step):
        block = _pi(shifts[:, None] + x[None, i:i + step])
        np.minimum(out, block.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    parts = sig.astype(np.uint64).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        h = tk.mix(h ^ parts[:, r]) + np.uint64(r)
    return tk.signed(tk.mix(h))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """Order-free 128-bit hash of a set."""
    return (int(tk.signed(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True))[0]),
            int(tk.signed(tk.mix(s ^ np.uint64(0x14057B7EF767814F)).sum(keepdims=True))[0]))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in tk.chunks(batch.column(1), tk.NOT_SPACE):
            n, s1, s2, bands, sketches = [], [], [], [], []
            for i in range(len(c.rows)):
                s = tk.shingle_set(c.words[c.bounds[i]:c.bounds[i + 1]])
                n.append(len(s))
                a, b = _set_hash(s) if len(s) else (0, 0)
                s1.append(a)
                s2.append(b)
                sig = signature(s, SKETCH) if len(s) else np.zeros(0, np.uint32)
                bands.append(band_keys(sig[:BANDS * ROWS], BANDS, ROWS) if len(s) else np.zeros(0, np.int64))
                sketches.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.rows.start, len(c.rows)).cast(pa.int64()), pa.array(n, pa.int64()),
                 pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), tk.long_lists(bands), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])


def _sets(bitmap):
    """Shingle sets of the documents that the bitmap lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            keep = member(bits, tk.signed(tk.mix(ids.view(np.uint64)))) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            for c in tk.chunks(batch.column(1), tk.NOT_SPACE):
                s1, values = [], []
                for i in range(len(c.rows)):
                    s = tk.shingle_set(c.words[c.bounds[i]:c.bounds[i + 1]])
                    s1.append(_set_hash(s)[0] if len(s) else 0)
                    values.append(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.rows.start, len(c.rows)).cast(pa.int64()),
                     pa.array(s1, pa.int64()), tk.long_lists(values)], ["id", "s1", "items"])
    return run


def _mixed(ids: DataFrame) -> DataFrame:
    """ids(id) with the hash under which `_sets` looks them up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(tk.mix(v.view(np.uint64))))], ["h"])
    return ids.select("id").mapInArrow(run, "h long")


def _items_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, s1, items) of the documents in nodes(id), from one filtered scan of all."""
    bitmap = membership(_mixed(nodes), "h")
    found = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
             .mapInArrow(_sets(bitmap), "id long, s1 long, items array<long>"))
    return found.join(nodes.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "s1"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        keep = pa.array((x == y).sum(axis=1) >= ALIKE)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) of doc_ids those linked by their full sets; sketches(id, sketch) turn most others away."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("sketch").alias(f"{side}_sketch")), side)
    pairs = pairs.select("a", "b", "a_sketch", "b_sketch").mapInArrow(_agree, "a long, b long").distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("items").alias(f"{side}_items")), side)
    shared = F.size(F.array_intersect("a_items", "b_items"))
    return (pairs.withColumn("i", shared)
            .where(100 * F.col("i") >= THRESHOLD * (F.size("a_items") + F.size("b_items") - F.col("i"))).select("a", "b"))


def _close(m: str, o: str):
    """Sizes that allow the threshold."""
    return 100 * F.least(m, o) >= THRESHOLD * F.greatest(m, o)


def _rows(bitmap=None):
    """Classes with their band keys -> a row per key, only those that the bitmap lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            keys = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            row = np.repeat(np.arange(len(lists)), np.diff(offsets))
            if bits is not None:
                keep = member(bits, keys)
                keys, row = keys[keep], row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["key", "id", "n"])
    return run


def _members(classes: DataFrame) -> DataFrame:
    """classes(id, n, keys) -> members of buckets with more than one: (key, id, n, size, c_id, c_n), c being the smallest id."""
    kind = "key long, id long, n long"
    classes = classes.select("id", "n", "keys")
    buckets = (classes.mapInArrow(_rows(), kind).groupBy("key")
               .agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("c")).where("size > 1"))
    buckets = cut_lineage(buckets.select("key", "size", F.col("c.id").alias("c_id"), F.col("c.n").alias("c_n")))
    return classes.mapInArrow(_rows(membership(buckets, "key", KEY_BITS)), kind).join(buckets, "key")


def _stars(members: DataFrame) -> DataFrame:
    """Every member with its bucket's smallest one."""
    return members.where("id <> c_id").where(_close("n", "c_n")).select(F.col("id").alias("a"), F.col("c_id").alias("b")).distinct()


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of the members of buckets that hold several components."""
    labelled = cut_lineage(members.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
                           .withColumn("label", F.coalesce("label", "id")))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return labelled.join(mixed, "key", "left_semi").select("id", "label").distinct()


def _post(counts):
    """(id, label, items) -> a row (h, id, label, n, pos, small) per shingle of the longer prefix, rarest first; small: it
    is in the shorter one, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            h = lists.values.to_numpy()[off[0]:off[-1]]
            row = np.repeat(np.arange(len(lists)), np.diff(off))
            order = np.lexsort((h, table[h & (COUNT_SLOTS - 1)], row))
            h = h[order]  # rows stay together
            n = np.diff(off)[row]
            pos = np.arange(len(h)) - (off[:-1] - off[0])[row]
            keep = pos < n - -(-THRESHOLD * n // 100) + 1
            small = pos < n - -(-2 * THRESHOLD * n // (100 + THRESHOLD)) + 1
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), batch.column(0).take(at), batch.column(1).take(at), pa.array(n[keep]), pa.array(pos[keep]), pa.array(small[keep])],
                                             ["h", "id", "label", "n", "pos", "small"])
    return run


def _shingle_counts(sets: DataFrame):
    """Counts of the shingles of all sets in hashed slots, as a broadcast table of fixed size."""
    got = (sets.select(F.explode("items").alias("h")).select(F.col("h").bitwiseAND(COUNT_SLOTS - 1).alias("slot"))
           .groupBy("slot").agg(F.count("*").alias("n")).toPandas())  # COUNT_SLOTS rows at most
    counts = np.zeros(COUNT_SLOTS, np.int32)
    counts[got["slot"].to_numpy(np.int64)] = np.minimum(got["n"].to_numpy(np.int64), (1 << 31) - 1)
    return sets.sparkSession.sparkContext.broadcast(counts)


def _candidates(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of left(id, label) of different labels that the prefix, length and positional filters let pass."""
    mine = sets.join(left, "id").select("id", "label", "items")
    posted = cut_lineage(mine.mapInArrow(_post(_shingle_counts(mine)), "h long, id long, label long, n long, pos long, small boolean"))
    lists = (posted.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("small").alias("found"))
             .where("lo <> hi and found").select("h"))
    posted = cut_lineage(posted.join(lists, "h", "left_semi"))
    small = posted.where("small").select("h", F.col("id").alias("a"), F.col("label").alias("a_label"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"))
    large = posted.select("h", F.col("id").alias("b"), F.col("label").alias("b_label"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"))
    most = "least(a_n - a_pos, b_n - b_pos)"
    near = (f"a_label <> b_label and (a_n < b_n or a_n = b_n and a < b) and 100 * a_n >= {THRESHOLD} * b_n "
            f"and {100 + THRESHOLD} * {most} >= {THRESHOLD} * (a_n + b_n)")
    return small.join(large, "h").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...)."""
    signed = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                         .mapInArrow(_sign, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    first = cut_lineage(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")))
    again = cut_lineage(real.select("doc_id", "s1", "s2", "n_shingles").join(first.where("rows > 1"), ["s1", "s2", "n_shingles"])
                        .where("doc_id <> id").select("doc_id", "s1", "id").distinct())
    copies = again.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    classes = (real.join(again.select("doc_id", "s1"), ["doc_id", "s1"], "left_anti")
               .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("bands").alias("keys")))
    members = cut_lineage(_members(classes))
    release(docs.sparkSession)
    ids = cut_lineage(members.select("id").distinct())
    sets = cut_lineage(_items_of(docs, ids))
    sketches = cut_lineage(real.select(F.col("doc_id").alias("id"), "sketch").join(ids, "id", "left_semi").distinct())
    release(docs.sparkSession)

    links = cut_lineage(_verified(_stars(members), sketches, sets).distinct())
    labels = cut_lineage(connected_components(links))
    release(docs.sparkSession)
    left = cut_lineage(_unresolved(members, labels))
    if not left.isEmpty():
        pairs = cut_lineage(_candidates(left, sets))
        release(docs.sparkSession)
        links = links.union(cut_lineage(_verified(pairs, sketches, sets).distinct()))
        release(docs.sparkSession)

    # copies join their class's component; a doc_id in several classes unites them
    by_id = connected_components(links.union(copies))
    return (signed.select("doc_id", "n_shingles").join(by_id.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not kept; of rows with the same doc_id, one."""
    found = cut_lineage(near_duplicates(docs))
    (key,) = fresh(docs, "gone")
    gone = found.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
    repeated = cut_lineage(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    if repeated.isEmpty():
        return left
    same = F.col("doc_id").cast("long") == F.col(key)
    every, (whole,) = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), fresh(docs, "row")
    one = (left.join(repeated, same, "left_semi").groupBy(F.col("doc_id").cast("long"))
           .agg(F.min_by(every, F.struct("text", F.to_json(every))).alias(whole)).select(f"{whole}.*"))
    return left.join(repeated, same, "left_anti").unionByName(one)
