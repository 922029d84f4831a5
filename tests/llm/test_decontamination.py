import random

import pytest

from helpers import SCHEMA, contamination, edge_docs, edge_rows, no_docs, prose, row
from lingua_spark.llm import decontamination as dec

ITEMS = "item_id long, text string, h long, m int"


def check(spark, rows, items):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    bench = spark.createDataFrame([(*i, 0, 0) for i in items], ITEMS).repartition(2)
    got = dec.decontaminate(docs, bench).collect()
    want = [(r[0], *contamination(r[1], items)) for r in rows]
    assert sorted(((g["doc_id"], g["n_words"], g["n_hit"], g["item_ids"]) for g in got), key=str) == sorted(want, key=str)
    assert all(g["contaminated"] == (g["n_hit"] > 0) and g["n_items"] == len(g["item_ids"]) for g in got)
    left = dec.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(w[0]) for w in want if not w[2])


def test_edge_documents(spark):
    texts = [r[1] for r in edge_rows()]
    items = [(1, " ".join(texts[10].split()[5:40])), (2, texts[11]), (3, "One"), (4, "zwei drei vier"), (5, None), (6, "..."), (7, "a B c d e"),
             (1, texts[12][30:200]), (None, texts[13]), (8, "w1 " * 12), (9, " ".join(texts[14].split()[:9])), (10, " ".join(texts[15].split()[:10]))]
    check(spark, edge_rows(), items)


def test_repetitive_texts(spark):
    """Few different words, so that equal hashes and overlapping windows abound."""
    rng = random.Random(6)
    rows = [row(i, prose(rng, rng.randrange(0, 120), 3)) for i in range(30)]
    items = [(i, prose(rng, rng.randrange(5, 30), 3)) for i in range(12)]
    check(spark, rows, items)


def test_empty_tables(spark):
    check(spark, edge_rows(), [])
    bench = spark.createDataFrame([(1, "some text", 0, 0)], ITEMS)
    assert dec.decontaminate(no_docs(spark), bench).count() == 0


def test_every_window_shares_a_fingerprint():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(100):
        h = rng.integers(0, 4, 60).astype(np.uint64)
        kept = set(dec.winnow(h, 6).tolist())
        assert all(kept & set(range(i, i + 6)) for i in range(55))
        for i in range(55):  # a window alone keeps the same place
            assert i + int(dec.winnow(h[i:i + 6], 6)[0]) in kept
