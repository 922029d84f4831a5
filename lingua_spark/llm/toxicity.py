"""Toxicity by maximum-scoring segments (operator 4).

Tokens: a word (a run of ASCII letters, digits and non-ASCII characters, A-Z as a-z) and its first 4, 5 and 6 bytes.

Fit (on the labelled rows whose crc32(doc_id) mod 4 is not 2, at most MAX_TRAIN of them, those with the smallest
hash of their id): the documents of both classes that hold a token give its log-odds with a Dirichlet prior (Monroe et
al.): each class is smoothed by pseudo-documents spread as in all training text. Tokens whose log-odds stand Z standard
errors from zero and are at least LEAST_ODDS are kept, all of them. A word then counts as its most specific kept token
(whole, then the longest prefix), or as "other", and these counts, smoothed the same way, give the weights: log ratios
of two distributions, so the expected weight in clean text is negative.

Score: one linear scan over a text's weights finds all maximal scoring segments (Ruzzo and Tompa). Over n clean
words the number of segments of score >= S is Poisson with mean K n exp(-lambda S) (Karlin and Altschul); lambda
solves E[exp(lambda w)] = 1 over clean training words, K is the rate seen there. Segments with a mean of at most
ALPHA are significant passages. A logistic curve over the calibrated surprise of the best segment, of all
significant ones together, and their share of the text maps to the probability of label 1.

Label, language, source and doc_id never enter a score.

Defined cases: null and wordless texts get the score of a text without passages; null labels do not count, several
labels of one doc_id count as their maximum; without labelled rows, or with one class only, every score is the
share of toxic labels (0 without any); repeated rows each get a row; rows without doc_id are scored and not held out;
an empty table gives an empty result; extra columns are ignored, `drop_toxic` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import cut_lineage

#: Bound on labelled training rows; up to it all are used.
MAX_TRAIN = 20_000
#: Pseudo-documents and pseudo-words of the prior, as a share of those seen.
PRIOR = 0.01
#: Standard errors and size of the log-odds from which on a token is kept.
Z = 2.0
LEAST_ODDS = 1.1
PREFIXES = (6, 5, 4)
ALPHA = 0.05
REJECT = 0.3


@dataclass
class Model:
    tokens: np.ndarray    # sorted uint64 token hashes
    weights: np.ndarray   # their weights, and last that of all other words
    lam: float
    log_k: float
    curve: np.ndarray     # logistic coefficients over `features`


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a weight sequence, in order, in linear time."""
    total = np.concatenate(([0.0], np.cumsum(weights)))
    positive = weights > 0
    first = np.flatnonzero(positive & ~np.concatenate(([False], positive[:-1])))
    end = np.flatnonzero(positive & ~np.concatenate((positive[1:], [False]))) + 1
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, end, last entry with a smaller left sum
    for f, e in zip(first.tolist(), end.tolist(), strict=True):
        left, right = float(total[f]), float(total[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, f, e, j))
                break
            left, f = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, right - left) for left, right, f, e, _ in stack]


def features(weights: np.ndarray, lam: float, log_k: float) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Calibrated features of one text, and its significant segments."""
    n = max(1, len(weights))
    base = log_k + np.log(n)
    found = [(f, e, lam * s - base) for f, e, s in segments(weights)]  # -log of the expected number in clean text
    strong = [x for x in found if x[2] >= -np.log(ALPHA)]
    best = max((x[2] for x in found), default=-base)
    surprise = -np.log(-np.expm1(-np.exp(-min(best, 600.0))) + 1e-300)  # -log P(best of a clean text is as high)
    return [1.0, min(surprise, 40.0), np.log1p(sum(x[2] for x in strong)),
            np.sqrt(sum(e - f for f, e, _ in strong) / n)], strong


def chunks(texts: pa.Array) -> Iterator[tk.Chunk]:
    return tk.chunks(texts, tk.ALNUM, PREFIXES)


def assign(c: tk.Chunk, tokens: np.ndarray) -> np.ndarray:
    """Index of each word's most specific kept token; len(tokens) for none."""
    out = np.full(len(c.words), len(tokens))
    if len(tokens):
        for h in (*reversed(c.prefixes), c.words):  # the shortest first, overwritten by longer ones
            at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
            out = np.where(tokens[at] == h, at, out)
    return out


def _weighed(texts: pa.Array, model: Model) -> Iterator[np.ndarray]:
    """The weights of each text's words."""
    for c in chunks(texts):
        w = model.weights[assign(c, model.tokens)]
        for i in range(len(c.rows)):
            yield w[c.bounds[i]:c.bounds[i + 1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in chunks(batch.column(0)):
            doc = np.searchsorted(c.bounds, np.arange(len(c.words)), side="right") - 1
            token = np.concatenate([c.words, *c.prefixes])
            doc = np.concatenate([doc] * (1 + len(PREFIXES)))
            order = np.lexsort((doc, token))
            token, doc = token[order], doc[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
            token, label = token[new & (token != 0)], toxic[doc[new & (token != 0)] + c.rows.start]
            token, back = np.unique(token, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tk.signed(token)), pa.array(np.bincount(back, 1 - label, len(token)).astype(np.int64)),
                 pa.array(np.bincount(back, label, len(token)).astype(np.int64))], ["token", "clean", "toxic"])


def _train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most MAX_TRAIN labelled rows (text, toxic) for fitting; their ids are few enough to broadcast."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
           .where("id is not null and toxic is not null").where("pmod(crc32(cast(cast(id as string) as binary)), 4) <> 2")
           .groupBy("id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64(F.lit(7), F.col("id")), "id").limit(MAX_TRAIN))
    return (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(ids), "id").select("text", F.least("toxic", F.lit(1)).alias("toxic")))


def telling_tokens(counts: DataFrame, clean: int, toxic: int) -> np.ndarray:
    """Sorted hashes of the tokens kept, from counts(token, clean, toxic) of documents."""
    prior = PRIOR * (clean + toxic)
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(clean + toxic)) * F.lit(prior)
    y_c, y_t = F.col("clean") + F.col("share"), F.col("toxic") + F.col("share")
    n_c, n_t = F.lit(clean + prior + 1e-6), F.lit(toxic + prior + 1e-6)
    delta = F.log(y_t / (n_t - y_t)) - F.log(y_c / (n_c - y_c))
    best = (counts.withColumn("share", share).withColumn("z", F.abs(delta) / F.sqrt(1 / y_t + 1 / y_c))
            .where((F.col("z") >= Z) & (F.abs(delta) >= LEAST_ODDS)).select("token").toPandas())
    return np.sort(best["token"].to_numpy(np.int64).view(np.uint64))


def _histogram(tokens: np.ndarray):
    """How often each kept token, and any other word, occurs in either class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, len(tokens) + 1), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(0)):
                label = toxic[np.searchsorted(c.bounds, np.arange(len(c.words)), side="right") - 1 + c.rows.start]
                at = assign(c, tokens)
                for k in (0, 1):
                    got[k] += np.bincount(at[label == k], minlength=len(tokens) + 1)
        some = np.flatnonzero(got.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(got[0, some]), pa.array(got[1, some])], ["at", "clean", "toxic"])
    return run


def _lambda(weights: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(lambda w)] = 1."""
    def f(x: float) -> float:
        return float(np.log(share @ np.exp(np.minimum(x * weights, 700.0))))
    if not (weights > 0).any() or weights @ share >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(w, model.lam, model.log_k)[0] for w in _weighed(batch.column(0), model)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps, each halved until the penalised loss falls enough: whole steps run away where the classes lie apart."""
    b = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((np.logaddexp(0.0, z) - y * z).sum() + 0.5 * (keep * c * c).sum())

    now = loss(b)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope = x.T @ (y - p) - keep * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), slope)
        gain, part = float(slope @ step), 1.0
        while part > 1e-9 and not (then := loss(b + part * step)) <= now - 1e-4 * part * gain:
            part /= 2
        if part <= 1e-9:
            break
        b, now = b + part * step, then
        if gain < 1e-10:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = cut_lineage(_train_rows(docs, labels))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model(np.zeros(0, np.uint64), np.zeros(1), 1.0, 0.0, np.array([np.log(max(share, 1e-12) / max(1 - share, 1e-12)), 0, 0, 0]))
    counts = cut_lineage(rows.mapInArrow(_count, "token long, clean long, toxic long").groupBy("token").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    tokens = telling_tokens(counts, n[0], n[1])
    got = (rows.mapInArrow(_histogram(tokens), "at int, clean long, toxic long").groupBy("at")
           .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas())  # a row per kept token
    seen = np.zeros((2, len(tokens) + 1))
    seen[:, got["at"].to_numpy(np.int64)] = got[["clean", "toxic"]].to_numpy(np.float64).T
    prior = PRIOR * (1 + seen.sum(axis=0)) / (len(tokens) + 1 + seen.sum()) * max(1.0, seen[1].sum())
    clean, toxic = ((x + prior) / (x + prior).sum() for x in seen)
    model = Model(tokens, np.log(toxic) - np.log(clean), 1.0, 0.0, np.zeros(4))
    model.lam = _lambda(model.weights, clean)
    rate = rows.where("toxic = 0").mapInArrow(_segment_rate(model), "n double, k double").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    model.log_k = float(np.log(max(rate["k"] or 0.0, 0.5) / max(rate["n"] or 0.0, 1.0)))
    got = rows.mapInArrow(_feature_rows(model), "x array<double>, toxic int").toPandas()  # MAX_TRAIN rows at most
    model.curve = _logistic(np.array(got["x"].tolist()), got["toxic"].to_numpy(np.float64))
    return model


def _segment_rate(model: Model):
    """Words, and segments from the median positive weight on, brought to score 0 by exp(lambda S), as K needs."""
    at_least = float(np.median(model.weights[model.weights > 0])) if (model.weights > 0).any() else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = k = 0.0
        for batch in batches:
            for w in _weighed(batch.column(0), model):
                n += len(w)
                k += sum(s >= at_least for _, _, s in segments(w))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([k * np.exp(min(model.lam * at_least, 600.0))])], ["n", "k"])
    return run


def _curve(x: list[float], m: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.dot(x, m.curve), -500, 500))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): passages are (start, end) word positions of the significant segments."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for w in _weighed(batch.column(1), m):
                x, strong = features(w, m.lam, m.log_k)
                scores.append(_curve(x, m))
                passages.append([{"start": f, "end": e} for f, e, _ in strong])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "score", "passages"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, score double, passages array<struct<start: int, end: int>>"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score is REJECT or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([_curve(features(w, m.lam, m.log_k)[0], m) < REJECT for w in _weighed(batch.column(at), m)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.coalesce(F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"), F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) per document."""
    model = fit(docs, labels)
    return (score(docs, model)
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"),
                    F.size("passages").alias("n_passages")))
