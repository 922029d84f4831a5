import math
import random
from fractions import Fraction

import numpy as np

from lingua_spark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, w double, component int"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in vectors], SCHEMA).repartition(parts)


def usable(vectors):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(spark, vectors, dimension):
    """Against exact integers for n and deviation, and a covariance by definition for the rest."""
    got = whitening.whiten(table(spark, vectors)).collect()
    kept = [(i, v) for i, v in usable(vectors) if len(v) == dimension]
    x = [[math.floor(Fraction(c) * 1024) + 100000 for c in v] for _, v in kept]
    n = len(x)
    s = [sum(col) for col in zip(*x, strict=True)]
    k = min(8, dimension)
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1))
    assert all(r["n"] == n for r in got)
    want = sorted((i if i is not None else -1, sum((n * a - b)**2 for a, b in zip(row, s, strict=True))) for (i, _), row in zip(kept, x, strict=True))
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"]) for r in got if r["component"] == 1) == want
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s, strict=True)] for row in x])
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for c in range(1, k + 1):
        rows = [r for r in got if r["component"] == c]
        assert np.allclose([r["explained"] for r in rows], e[c - 1] / e.sum(), rtol=1e-8, atol=1e-12)
        mine = {i: sorted(r["whitened"] for r in by[i][c]) for i in by}
        hand = {}
        for (i, _), row in zip(kept, centred @ vec[:, c - 1] / math.sqrt(e[c - 1]), strict=True):
            hand.setdefault(i, []).append(row)
        same = all(np.allclose(mine[i], sorted(hand[i]), atol=1e-6) for i in hand)
        flipped = all(np.allclose(mine[i], sorted(-v for v in hand[i]), atol=1e-6) for i in hand)
        assert same or flipped
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for u in (rng.integers(-300, 300, (1000, 7)), rng.integers(0, 2, (65, 3)), np.full((5, 4), -7), rng.integers(-(1 << 62), 1 << 62, (130, 3)),
              np.array([[1 << 62, -(1 << 62)], [-(1 << 62), 1 << 62]])):
        sums, cross = whitening.scatter(u.astype(np.int64))
        o = u.astype(object)
        assert list(sums) == list(o.sum(axis=0)) and (cross == o.T.dot(o)).all()


def test_against_definition(spark):
    rng = random.Random(5)
    base = [(i, [rng.gauss(0, 0.3 * (j + 1)) for j in range(12)]) for i in range(300)]
    odd = [(400, None), (401, [float("nan")] + [0.0] * 11), (402, [float("inf")] * 12), (403, [None] + [0.1] * 11), (404, [0.1] * 3), (405, []), (None, base[0][1]),
           (0, base[1][1]), *base[:40]]
    check(spark, base + odd, 12)


def test_few_dimensions_and_wide_values(spark):
    rng = random.Random(6)
    check(spark, [(i, [rng.uniform(-5e2, 5e2), rng.uniform(-1, 1), 1e1 * rng.random()]) for i in range(50)], 3)


def test_without_spread(spark):
    got = whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(2, 0, None, None, None)] * 4
    line = whitening.whiten(table(spark, [(i, [float(i), float(i)]) for i in range(4)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9


def test_beyond_a_long(spark):
    got = whitening.whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.5])])).collect()
    assert all(r["deviation"] is None for r in got if r["vec_id"] != 3) and all(r["n"] == 3 for r in got)


def test_empty(spark):
    for vectors in ([], [(1, None), (2, [])]):
        got = whitening.whiten(table(spark, vectors))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_query(spark):
    from lingua_spark.llm.queries import QUERIES
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 500 * 8 and got[0]["identity_error"] < 1e-9
