import zlib

import numpy as np
import pytest

from helpers import edge_docs, edge_rows, no_docs
from lingua_spark.llm import toxicity as tox


def brute_segments(w):
    """Maximal scoring segments by definition: best segment first, then either side of it."""
    out = []

    def best(lo, hi):
        top, at = 0.0, None
        for i in range(lo, hi):
            s = 0.0
            for j in range(i, hi):
                s += w[j]
                if s > top + 1e-12:
                    top, at = s, (i, j + 1)
        if at:
            best(lo, at[0])
            out.append((*at, top))
            best(at[1], hi)

    best(0, len(w))
    return out


def test_segments():
    rng = np.random.default_rng(1)
    for _ in range(150):
        w = rng.normal(-0.3, 1.5, rng.integers(0, 40))
        got, want = tox.segments(w), brute_segments(w)
        assert [g[:2] for g in got] == [x[:2] for x in want]
        np.testing.assert_allclose([g[2] for g in got], [x[2] for x in want], atol=1e-9)


def auc(y, s):
    order = np.argsort(np.argsort(s))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = tox.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels.dropna(subset=["toxic"]).toPandas(), on="doc_id")
    held = both[both.held_out]
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.85


@pytest.mark.parametrize("least", [18, 25, 40])
def test_curve_of_classes_that_lie_apart(least):
    """The fit ends at the least loss: the slope is zero there, and toxic texts rank above clean ones."""
    rng = np.random.default_rng(least)
    clean, toxic = rng.exponential(1.0, 18_000), least + rng.exponential(30.0, 2_000)
    weak = np.where(rng.random(len(clean)) < 0.05, rng.uniform(3, 8, len(clean)), 0.0)
    x = np.concatenate([np.column_stack([np.ones(len(clean)), clean, np.log1p(weak), np.sqrt(weak / 40)]),
                        np.column_stack([np.ones(len(toxic)), np.minimum(toxic, 40), np.log1p(toxic), np.minimum(1, np.sqrt(toxic / 60))])])
    y = np.repeat([0.0, 1.0], [len(clean), len(toxic)])
    for copies in (1, 10, 100):
        w = np.concatenate([np.arange(len(clean)), np.tile(np.arange(len(clean), len(y)), copies)])
        b = tox._logistic(x[w], y[w])
        p = 1 / (1 + np.exp(-x[w] @ b))
        assert np.abs(x[w].T @ (y[w] - p) - np.array([1e-6, 1e-2, 1e-2, 1e-2]) * b).max() < 1e-3
        assert auc(y, x @ b) > 0.999


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - toxic else toxic end toxic")
    a, b = (sorted(map(tuple, tox.toxicity(docs, x).collect())) for x in (labels, other))
    assert a == b


def test_edge_cases(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] == pytest.approx(0.0, abs=1e-9) for r in tox.toxicity(docs, none).collect())
    one = spark.createDataFrame([(10, 1), (20, None), (None, 1)], "doc_id long, toxic int")
    assert all(r["score"] == pytest.approx(1.0, abs=1e-9) for r in tox.toxicity(docs, one).collect())
    some = spark.createDataFrame([(r[0], int("w12" in (r[1] or ""))) for r in edge_rows()] + [(90, 1), (None, 0), (100, None)], "doc_id long, toxic int")
    got = tox.toxicity(docs, some).collect()
    assert len(got) == len(edge_rows()) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert tox.toxicity(no_docs(spark), some).count() == 0
    left = tox.drop_toxic(docs, tox.fit(docs, some))
    assert left.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in got if r["score"] < tox.REJECT)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == want
