import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import SCHEMA, edge_rows, no_docs, prose, row
from lingua_spark.llm import lexical_search as ls

ITEMS = "item_id long, text string, doc_id long, score long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, top=10):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    big_n, big_l = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m = 25 + 75 * n * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def check(spark, rows, items, parts=4, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    bench = spark.createDataFrame([(*i, 0, 0) for i in items], ITEMS).repartition(2)
    got = ls.search(docs, bench, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, items), key=str)


def test_edge_documents(spark):
    texts = [r[1] for r in edge_rows() if r[1]]
    items = [(1, " ".join(texts[10].split()[5:40])), (2, texts[11]), (3, "One w1 w1"), (4, None), (5, "..."), (6, "w17 É été ÉTÉ été 9"), (1, "two"), (None, "w3 w4")]
    check(spark, edge_rows(), items)


@pytest.mark.parametrize("vocabulary", [3, 40, 3000])
def test_random_texts(spark, monkeypatch, vocabulary):
    """Small shards and beams, so that intervals are split often; few different words give ties."""
    monkeypatch.setattr(ls, "SHARD_DOCS", 64)
    monkeypatch.setattr(ls, "BEAM", 2)
    rng = random.Random(vocabulary)
    rows = [row(i % 280, prose(rng, rng.randrange(0, 60), vocabulary)) for i in range(300)] + [row(None, prose(rng, 30, vocabulary))]
    items = [(i, prose(rng, rng.randrange(1, 30), vocabulary)) for i in range(25)]
    check(spark, rows, items, 3)


def test_blocks_of_items(spark):
    rng = random.Random(9)
    rows = [row(i, prose(rng, 40, 200)) for i in range(100)]
    check(spark, rows, [(i, prose(rng, 12, 200)) for i in range(20)], block_terms=30)


def test_range_maxima():
    rng = np.random.default_rng(1)
    doc, term = (x.ravel() for x in np.nonzero(rng.random((50, 9)) < 0.3))
    impact = rng.integers(1, 1000, len(doc))
    shard = ls.Shard(doc, term, impact, 50)
    for t in range(9):
        for lo in range(0, 50, 3):
            for hi in range(lo + 1, 51, 5):
                want = max(((int(x) << ls.DOC_BITS) | int(d) for d, k, x in zip(doc, term, impact, strict=True) if k == t and lo <= d < hi), default=0)
                got = shard.maxima(np.searchsorted(shard.present, [t]), np.array([lo]), np.array([hi]))[0] if t in shard.present else 0
                assert got == want


def test_few_intervals_are_scored(monkeypatch):
    """Documents that can't reach the best ones are left out by their interval's bound."""
    rng = np.random.default_rng(2)
    block = ls.Block([{"item": 0, "terms": [5, 6, 7], "counts": [1, 1, 1]}])
    doc = np.concatenate([np.arange(2000), np.arange(0, 2000, 7), np.arange(0, 2000, 100)])
    term = np.concatenate([np.zeros(2000, int), np.ones(286, int), np.full(20, 2)])
    search = ls.Search(block, np.array([1, 50, 900]), 10)
    scored = []
    add = search.add
    search.add = lambda i, s, d: (scored.append(len(d)), add(i, s, d))
    search.run(ls.Shard(doc, term, rng.integers(1, 1000, len(doc)), 2000), np.arange(2000))
    assert sum(scored) < 400


def test_large_statistics():
    n, documents, length = np.array([10**7, 5]), 10**12, 10**15
    assert ls.impacts(np.array([3, 2]), n, documents, length).tolist() == [
        10**9 * t // (1000 * t + 8 * (25 + 75 * k * documents // length)) for t, k in ((3, 10**7), (2, 5))]


def test_empty_tables(spark):
    rows = [row(1, "a b"), row(2, None)]
    assert ls.search(no_docs(spark), spark.createDataFrame([(1, "a", 0, 0)], ITEMS)).collect() == []
    assert ls.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], ITEMS)).collect() == []
