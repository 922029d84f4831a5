import hashlib
import random

import numpy as np
import pytest

from helpers import SCHEMA, changed, edge_rows, no_docs, prose, row, shingles
from lingua_spark.llm import fingerprints as fp


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = fp.compare_with_edits(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for r, n in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = r[1] or "", n[1] or ""
        half = len(t) // 2
        want.append((r[0], len(t), hashlib.sha256((t[:len(t) - half] + u[:half]).encode()).hexdigest()))
    assert sorted((tuple(g)[:3] for g in got), key=str) == sorted(want, key=str)
    return {g["doc_id"]: g for g in got}, {a: (b[1] or "", c[1] or "") for a, b, c in zip([r[0] for r in ordered], ordered, ordered[1:] + ordered[:1])}


def test_edits_and_likeness(spark):
    got, texts = check(spark, edge_rows())
    by_print = {}
    for d, g in got.items():
        own, following = texts[d]
        edited = fp.edit(own, following)
        assert g["near_next"] == pytest.approx(jaccard(own, following), abs=0.2)
        assert g["near_edited"] == pytest.approx(jaccard(own, edited), abs=0.2)
        if own == edited:
            assert g["near_edited"] == 1.0 and g["fingerprint"] == g["edited_fingerprint"]
        by_print.setdefault(own, set()).add(g["fingerprint"])
    assert all(len(v) == 1 for v in by_print.values())


def test_small_tables(spark):
    check(spark, [row(4, "a b c d e f g h i")])
    check(spark, [row(4, "a b c"), row(2, None)])
    check(spark, [row(i, f"t{i} é😀 x") for i in range(30)])
    assert fp.compare_with_edits(no_docs(spark)).count() == 0


def test_estimate_is_unbiased():
    rng = random.Random(1)
    import pyarrow as pa
    for share, n in ((0.02, 400), (0.1, 400), (0.05, 60), (1.0, 200)):
        errors = []
        for _ in range(60):
            a = prose(rng, n, 10**6)
            b = changed(rng, a, share)
            x, y = fp.fingerprints_of(pa.array([a, b]))
            errors.append(fp.likeness(x, y) - jaccard(a, b))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09
