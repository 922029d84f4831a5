"""Embedding whitening by bit-sliced scatter (operator 11).

Entries become integers x = floor(1024 c) + 100000. A task packs, per dimension, the bit planes of x (shifted by the
batch's minimum of that dimension, so that few planes are needed) across the rows into 64-bit words. The number of
rows with plane p of dimension i and plane q of dimension j is a popcount of two words ANDed; weighted by 2^(p + q)
these counts give exact cross-products, which are moved back to the common origin as integers. Sums of all tasks are
added in Spark as decimals, the scatter matrix n * sum(x x') - S S' is centred as Python integers, and only then goes to
`eigh` as doubles. Rows are projected from n * x - S, an integer as well, so no digits cancel.

Defined cases: a row whose vector is null or holds a null or non-finite entry is dropped; so is one whose vector is
shorter or longer than the most common length (of lengths equally common, the longest). Entries whose x does not fit are
held within +-2^62. Repeated rows and rows without vec_id count and are returned like others; vectors of length 0 and
empty tables give an empty result; columns other than the two named are ignored. A component whose eigenvalue is zero up
to rounding has no direction: its `whitened` is null and it is left out of `identity_error`; `explained` is null where
the trace is zero. `deviation` is null where the exact sum does not fit a long. With equal eigenvalues any basis may come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm.common import stored

SCALE, ORIGIN = 1024, 100_000
COMPONENTS = 8
#: Rows that are packed at a time.
BLOCK = 8192
#: Exact sums travel as hi * LIMB + lo, two decimals(38, 0).
LIMB = 10**18


def vectors(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, entries as doubles) of the usable vectors of a batch, in column 1."""
    column = batch.column(1)
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False))
    rows = np.flatnonzero(fits)
    if not len(rows):
        return rows, np.zeros((0, dimension))
    flat = pc.list_flatten(column.take(pa.array(rows)))
    c = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dimension)
    good = np.isfinite(c).all(axis=1)
    return rows[good], c[good]


def offsets_of(c: np.ndarray) -> np.ndarray:
    """x - ORIGIN of every entry."""
    u = np.floor(c * SCALE)
    edge = float(1 << 62)
    wide = np.abs(u) >= edge
    out = np.where(wide, 0, u).astype(np.int64)
    out[wide] = np.where(u[wide] > 0, 1 << 62, -(1 << 62)).astype(np.int64)
    return out


def scatter(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of integer rows, exact, as Python integers: cross-products from bit planes."""
    n, d = u.shape
    low = u.min(axis=0)
    y = (u.astype(np.uint64) - low.astype(np.uint64))  # modulo 2^64, so also right for the widest range
    planes = []
    for p in range(int(y.max()).bit_length()):
        bits = (y >> np.uint64(p)).astype(np.uint8) & np.uint8(1)
        packed = np.packbits(bits.T, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        planes.append(np.ascontiguousarray(packed).view(np.uint64))
    by_weight: dict[int, np.ndarray] = {}
    for p, a in enumerate(planes):
        for q in range(p + 1):
            counts = np.empty((d, d), np.int64)
            for i in range(d):  # one dimension against all: the temporary is d words lists
                counts[i] = np.bitwise_count(a[i] & planes[q]).sum(axis=1, dtype=np.int64)
            by_weight[p + q] = by_weight.get(p + q, 0) + (counts if p == q else counts + counts.T)
    cross = np.zeros((d, d), object)
    for weight, counts in by_weight.items():
        cross += counts.astype(object) << weight
    ones = np.zeros(d, object)
    for p, a in enumerate(planes):
        ones += np.bitwise_count(a).sum(axis=1, dtype=np.int64).astype(object) << p
    m = low.astype(object)
    sums = ones + n * m
    return sums, cross + np.outer(m, ones) + np.outer(ones, m) + n * np.outer(m, m)


def _moments(dimension: int):
    """Per task: (i, j, hi, lo) of the cross-products, j >= i; (i, -1, ...) of the sums; (-1, -1, ...) of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            u = offsets_of(vectors(batch, dimension)[1])
            for at in range(0, len(u), BLOCK):
                s, x = scatter(u[at:at + BLOCK])
                n, sums, cross = n + len(u[at:at + BLOCK]), sums + s, cross + x
        if not n:
            return
        cells = [(-1, -1, n), *((i, -1, int(s)) for i, s in enumerate(sums)),
                 *((i, j, int(cross[i, j])) for i in range(dimension) for j in range(i, dimension))]
        kind = pa.decimal128(38, 0)
        from decimal import Decimal
        hi, lo = zip(*(divmod(v, LIMB) for _, _, v in cells), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
                                          pa.array(map(Decimal, hi), kind), pa.array(map(Decimal, lo), kind)], ["i", "j", "hi", "lo"])
    return run


def fit(rows: DataFrame, dimension: int) -> tuple[int, list[int], np.ndarray, np.ndarray, float]:
    """(n, S - n * ORIGIN, eigenvalues, unit eigenvectors as columns, trace), by falling eigenvalue, over all rows.

    The driver receives dimension^2 / 2 sums, whatever the number of rows."""
    cells = (rows.mapInArrow(_moments(dimension), "i int, j int, hi decimal(38,0), lo decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect())
    value = {(c["i"], c["j"]): int(c["hi"]) * LIMB + int(c["lo"]) for c in cells}
    n = value.get((-1, -1), 0)
    if not n:
        return 0, [], np.zeros(0), np.zeros((0, 0)), 0.0
    s = [value[i, -1] for i in range(dimension)]
    v = np.empty((dimension, dimension))
    trace = 0
    for i in range(dimension):
        for j in range(i, dimension):
            centred = n * value[i, j] - s[i] * s[j]
            v[i, j] = v[j, i] = centred / (n * n)  # integers, divided with one rounding
            trace += centred if i == j else 0
    e, vec = np.linalg.eigh(v)
    return n, s, e[::-1], vec[:, ::-1], trace / (n * n)


def _project(dimension: int, n: int, s: list[int], e: np.ndarray, vec: np.ndarray):
    """(vec_id, deviation, w) per usable row; w has a null for a component without direction."""
    s_long = np.array(s, object)
    narrow = all(abs(x) < 1 << 61 for x in s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, c = vectors(batch, dimension)
            if not len(rows):
                continue
            u = offsets_of(c)
            if narrow and int(np.abs(u).max()) < (1 << 61) // n:
                centred = n * u - s_long.astype(np.int64)
                apart = centred.astype(np.float64) / n
                wide = (centred.astype(np.float64)**2).sum(axis=1) >= float(1 << 62)
                deviation = np.where(wide, 0, (np.where(wide[:, None], 0, centred)**2).sum(axis=1))
            else:
                exact = n * u.astype(object) - s_long
                apart = (exact / n).astype(np.float64)
                wide = np.ones(len(rows), bool)
                deviation = np.zeros(len(rows), np.int64)
            at = np.flatnonzero(wide)
            if len(at):  # Python integers where 64 bits may not do
                long = ((n * u[at].astype(object) - s_long)**2).sum(axis=1)
                fits = np.array([x < 1 << 63 for x in long])
                deviation[at[fits]] = long[fits].astype(np.int64)
                wide[at[fits]] = False
            w = apart @ vec
            known = e > 0
            w[:, known] /= np.sqrt(e[known])
            flat = pa.array(w.ravel(), pa.float64(), mask=np.tile(~known, len(rows)))
            at = pa.array(np.arange(len(rows) + 1) * len(e), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array(deviation, pa.int64(), mask=wide), pa.ListArray.from_arrays(at, flat)],
                ["vec_id", "deviation", "w"])
    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row of
    embeddings(vec_id, embedding, ...) and component."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    entry_ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    common = (rows.where(F.col("v").isNotNull() & entry_ok).groupBy(F.size("v").alias("d")).count()
              .orderBy(F.desc("count"), F.desc("d")).first())
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dimension = common["d"] if common else 0
    if not dimension:
        return spark.createDataFrame([], result)
    n, s, e, vec, trace = fit(rows, dimension)
    k = min(components, dimension)
    least = max(trace, 0.0) * dimension * np.finfo(float).eps
    e = np.where(e > least, e, 0.0)[:k]
    wide = stored(rows.mapInArrow(_project(dimension, n, s, e, vec[:, :k]), "vec_id long, deviation long, w array<double>"))
    real = [i for i in range(k) if e[i] > 0]
    error = None
    if real:
        w = [F.get("w", F.lit(i)) for i in range(k)]
        pairs = [(i, j) for i in real for j in real if i <= j]
        got = wide.agg(*(F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*(F.lit(float(x / trace) if trace > 0 else None).cast("double") for x in e))
    return (wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error")))
