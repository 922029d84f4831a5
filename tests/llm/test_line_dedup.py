import random

import numpy as np

from helpers import SCHEMA, edge_docs, edge_rows, later_lines, no_docs, prose, row
from lingua_spark.llm import line_dedup
from lingua_spark.llm.common import membership


def removed(rows):
    """Brute force; rows with the same doc_id are one document."""
    return later_lines(sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=str))


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = removed(rows)
    got = {(r["doc"], r["line"]) for r in line_dedup.later_matches(docs).collect()}
    assert got == want
    return docs, want


def test_edge_documents(spark):
    docs, gone = check(spark, edge_rows())
    assert gone
    want = []
    for r in edge_rows():
        lines = (r[1] or "").split("\n")
        out = [k for k in range(len(lines)) if (r[0], k) not in gone]
        if not out:
            continue
        text = r[1] if len(out) == len(lines) else "\n".join(lines[k] for k in out)
        want.append((r[0], text, *r[2:4], r[4] if len(out) == len(lines) else len(text), *r[5:]))
    left = line_dedup.drop_later_lines(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    per_doc = line_dedup.removed_lines(docs).collect()
    assert len(per_doc) == len(edge_rows())
    assert {(r["doc_id"], k) for r in per_doc for k in r["removed"]} == gone


def test_long_posting_lists(spark, monkeypatch):
    """Lines that share a stretch and few of which match, over more than one round of list entries."""
    monkeypatch.setattr(line_dedup, "FAN", 2)
    rng = random.Random(5)
    stretch = prose(rng, 30).split()
    rows = []
    for i in range(40):
        w = stretch[:]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(5)}"
        rows.append(row(i, prose(rng, 9) + "\n" + " ".join(w) + "\n" + prose(rng, 3)))
    check(spark, rows)


def test_empty_table(spark):
    assert line_dedup.removed_lines(no_docs(spark)).count() == 0
    assert line_dedup.drop_later_lines(no_docs(spark)).columns == no_docs(spark).columns


def test_prefixes(spark):
    """A line posts n - ceil(0.75 n) + 1 shingles."""
    rows = edge_docs(spark).select("doc_id", "text")
    lines = rows.mapInArrow(line_dedup._lines, "doc long, line long, n long, s long, t long")
    none = line_dedup._line_filter(lines.where("false"))
    post = line_dedup._post(line_dedup.shingle_counts(lines), none, none, None)
    want = sum(r["n"] - -(-75 * r["n"] // 100) + 1 for r in lines.where("doc is not null").collect())
    assert rows.mapInArrow(post, "key long").count() == want


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEY_BITS", 64)
    monkeypatch.setattr(line_dedup, "membership", lambda df, c, bits=64: membership(df, c, 64))
    check(spark, edge_rows())


def test_shared_keys_cross_as_packed_bits(spark, monkeypatch):
    """The filter of shared shingles holds those of several lines, found without a row per shingle."""
    monkeypatch.setattr(line_dedup, "HELD_KEYS", 50)
    rng = random.Random(7)
    same = prose(rng, 30)
    docs = spark.createDataFrame([row(i, prose(rng, 200) + f"\n{same} only{i}") for i in range(30)], SCHEMA).repartition(3).select("doc_id", "text")
    lines = docs.mapInArrow(line_dedup._lines, "doc long, line long, n long, s long, t long")
    none, counts = line_dedup._line_filter(lines.where("false")), line_dedup.shingle_counts(lines)
    posted = [r["key"] for r in docs.mapInArrow(line_dedup._post(counts, none, none, None), "key long").collect()]
    shared = line_dedup._shared_keys(docs, counts, none, none).value
    keys = np.array(sorted(set(posted)))
    several = np.array([posted.count(k) > 1 for k in keys.tolist()])
    held = line_dedup.member(shared, keys)
    assert several.any() and held[several].all() and held.sum() - several.sum() < 5


def test_parity_bounds_the_difference():
    """The filter never drops a pair at the threshold, and drops pairs that the posted places alone let through."""
    rng = np.random.default_rng(3)
    dropped = 0
    for _ in range(2000):
        n, out, new = rng.integers(1, 120), rng.integers(0, 40), rng.integers(0, 40)
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[min(out, n - 1):], rng.integers(0, 2**63, new, dtype=np.uint64)])
        i = len(np.intersect1d(a, b))
        p, q = (int(line_dedup._parity(x, np.array([0]))[0]) for x in (a, b))
        keep = (100 + 75) * (p ^ q).bit_count() <= (100 - 75) * (len(a) + len(b))
        assert keep or 100 * i < 75 * (len(a) + len(b) - i)
        dropped += not keep
    assert dropped > 500


def test_few_pairs_are_verified_together(spark, monkeypatch):
    """Rounds with few pairs don't read the documents again, each for itself."""
    monkeypatch.setattr(line_dedup, "FAN", 2)
    calls, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda docs, pairs: calls.append(1) or verified(docs, pairs))
    rng = random.Random(5)
    stretch = prose(rng, 30).split()
    rows = []
    for i in range(40):
        w = stretch[:]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(5)}"
        rows.append(row(i, " ".join(w)))
    check(spark, rows)
    assert len(calls) == 1
