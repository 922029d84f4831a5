"""Document scores by a masked pseudo-likelihood language model (operator 5).

Every word of a text is predicted from SIDE words on either side by a small network trained here in numpy: one
embedding per context place and class, a tanh layer, a softmax over CLASSES word classes, the slot's share of its class,
and the word's share of its slot. The sum of the conditional log-probabilities is the document's score.

Words are runs of bytes other than ASCII white space, A-Z as a-z, told apart by 64-bit hashes. Every distinct word of the
corpus is counted, in a distributed table. Words fall into SLOTS slots; the slots' counts give the classes (the most
frequent ones have their own, the others share classes of equal size by rank) and the shares within them, the words' own
counts the shares within a slot. Scoring finds the counts of at most FREQUENT frequent words in a broadcast of fixed size;
occurrences of all others are joined with the table of words, each of which then has few. Class 0 stands beyond the ends of
a text.

Training sees every word of the corpus: in each of the ROUNDS rounds all partitions start from the same weights, take
Adagrad steps over their own texts, each round over another part of the positions, and a distributed mean over partitions,
weighted by the positions each one saw, gives the next weights. What is gathered grows with the input; the
model and what reaches the driver have a fixed size.

Defined cases: null and empty texts have 0 words, log_prob 0.0 and no mean; a one-word text is predicted from the ends
alone; texts are scored whole; repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm import textkernel as tk
from lingua_spark.llm.common import stored

SLOTS = 1 << 16
FREQUENT = 1 << 18  # words whose counts a scoring task holds
UNSEEN = 0.5        # occurrences that a slot keeps for words not counted
CLASSES = 128
OWN = 96          # classes of a single slot
SIDE = 2
WIDTH = 32
ROUNDS = 2
STEP = 512        # words of a training step
POOL = 1 << 20    # words mixed before training, so that a step sees many texts
BATCH = 4096      # words scored at once
RATE = 0.1
_PLACES = [o for o in range(-SIDE, SIDE + 1) if o]


@dataclass
class Net:
    embed: np.ndarray   # (2 * SIDE, CLASSES + 1, WIDTH)
    bias: np.ndarray    # (WIDTH,)
    out: np.ndarray     # (WIDTH, CLASSES)
    out_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.bias, self.out, self.out_bias)])

    @staticmethod
    def of(flat: np.ndarray) -> Net:
        shapes = [(2 * SIDE, CLASSES + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,)]
        at = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        return Net(*(np.ascontiguousarray(flat[a:b], np.float32).reshape(s) for a, b, s in zip(at[:-1], at[1:], shapes, strict=True)))


@dataclass
class Vocabulary:
    classes: np.ndarray  # int16 class (1 to CLASSES) of each slot
    share: np.ndarray    # float32 log-probability of each slot within its class
    prior: np.ndarray    # log-probability of each class
    mass: np.ndarray | None = None  # occurrences of each slot, UNSEEN included


def slots(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SLOTS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), a word once per POOL words or so."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

    for batch in batches:
        for c in tk.chunks(batch.column(0), tk.NOT_SPACE):
            held.append(np.unique(c.words, return_counts=True))
            if sum(len(w) for w, _ in held) >= POOL:
                held = [merged()]
                if len(held[0][0]) >= POOL // 2:
                    yield _word_rows(*held.pop())
    if held:
        yield _word_rows(*merged())


def _word_rows(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tk.signed(words)), pa.array(n)], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of every distinct word of the texts, by its hash."""
    return stored(docs.select(F.col("text").cast("string")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(words, ascending, and their counts) of the most frequent words, FREQUENT at most: those above a quarter of an octave."""
    level = F.floor(4 * F.log2("n"))
    least, held = None, 0
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 256 levels at most
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["level"]
    got = words.where(level >= least if least is not None else F.lit(False)).toPandas()
    word = got["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], got["n"].to_numpy(np.int64)[order]


def vocabulary(words: DataFrame) -> Vocabulary:
    slot = F.col("word").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    got = words.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    n = np.full(SLOTS, UNSEEN)
    n[got["slot"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    order = np.lexsort((np.arange(SLOTS), -n))
    classes = np.zeros(SLOTS, np.int16)
    classes[order[:OWN]] = np.arange(1, OWN + 1)
    mass = np.cumsum(n[order[OWN:]])
    classes[order[OWN:]] = OWN + 1 + np.minimum((mass / mass[-1] * (CLASSES - OWN)).astype(np.int64), CLASSES - OWN - 1)
    total = np.bincount(classes, n, CLASSES + 1)
    with np.errstate(divide="ignore"):
        return Vocabulary(classes, np.log(n / total[classes]).astype(np.float32), np.log((total[1:] + 1e-3) / (total[1:] + 1e-3).sum()).astype(np.float32), n)


def contexts(classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, 2 * SIDE) classes around each word; 0 beyond its text."""
    n = len(classes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first, last = bounds[:-1][doc], bounds[1:][doc]
    out = np.zeros((n, 2 * SIDE), np.int64)
    here = np.arange(n)
    for j, o in enumerate(_PLACES):
        at = here + o
        ok = (at >= first) & (at < last)
        out[ok, j] = classes[at[ok]]
    return out


def hidden(net: Net, around: np.ndarray) -> np.ndarray:
    h = net.embed[0][around[:, 0]]
    for j in range(1, 2 * SIDE):
        h += net.embed[j][around[:, j]]
    h += net.bias
    return np.tanh(h, out=h)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _exps(net: Net, z: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits z and its sums by row. Hidden units are at most 1, so logits of moderate weights need no shift; others
    are shifted in place by their rows' largest."""
    if (np.abs(net.out).sum(axis=0) + np.abs(net.out_bias)).max() > 60:
        z -= z.max(axis=1, keepdims=True)
    e = np.exp(z, out=out)
    return e, e @ np.ones(e.shape[1], e.dtype)


def word_log_probs(net: Net, vocab: Vocabulary, slot: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log P(word | both sides) of each word."""
    classes = vocab.classes[slot].astype(np.int64)
    around = contexts(classes, bounds)
    out = np.empty(len(slot), np.float32)
    for i in range(0, len(slot), BATCH):
        a = around[i:i + BATCH]
        z = hidden(net, a) @ net.out
        z += net.out_bias
        _, total = _exps(net, z)
        out[i:i + BATCH] = z[np.arange(len(a)), classes[i:i + BATCH] - 1] - np.log(total)
    return out + vocab.share[slot]


class Trainer:
    def __init__(self, net: Net):
        self.net = Net(*(x.copy() for x in (net.embed, net.bias, net.out, net.out_bias)))
        self.sums = [np.full_like(x, 1e-2) for x in (self.net.embed, self.net.bias, self.net.out, self.net.out_bias)]
        self.seen = 0

    def _step(self, k: int, value: np.ndarray, grad: np.ndarray) -> None:
        self.sums[k] += grad * grad
        value -= RATE * grad / np.sqrt(self.sums[k])

    def train(self, around: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step on the mean loss of a mini-batch (target classes from 0)."""
        net, n = self.net, len(target)
        h = hidden(net, around)
        p = h @ net.out
        p += net.out_bias
        _, total = _exps(net, p, out=p)
        p *= (1 / (n * total))[:, None]
        p[np.arange(n), target] -= 1 / n
        g = p @ net.out.T
        g *= 1 - h * h
        self._step(2, net.out, h.T @ p)
        self._step(3, net.out_bias, p.sum(axis=0))
        self._step(1, net.bias, g.sum(axis=0))
        grad = np.zeros_like(net.embed)
        for j in range(2 * SIDE):
            order = np.argsort(around[:, j].astype(np.int16), kind="stable")  # a radix sort
            cls = around[order, j]
            first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
            grad[j, cls[first]] = np.add.reduceat(g[order], first)
        self._step(0, net.embed, grad)
        self.seen += n


def _train(shared, vocab, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, v = Trainer(Net.of(shared.value)), vocab.value
        pool: list[np.ndarray] = []

        def train(rows: np.ndarray) -> None:
            rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))].astype(np.int64)
            for i in range(0, len(rows), STEP):
                t.train(rows[i:i + STEP, :-1], rows[i:i + STEP, -1])

        for batch in batches:
            for c in tk.chunks(batch.column(0), tk.NOT_SPACE):
                classes = v.classes[slots(c.words)].astype(np.int64)
                mine = np.arange(len(classes)) % ROUNDS == round_
                pool.append(np.column_stack([contexts(classes, c.bounds)[mine], classes[mine] - 1]).astype(np.int16))
                if sum(map(len, pool)) >= POOL:
                    train(np.concatenate(pool))
                    pool = []
        if any(map(len, pool)):
            train(np.concatenate(pool))
        if t.seen:
            w = t.net.flat().astype(np.float64) * t.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int32()), pa.array(w), pa.array(np.full(len(w), float(t.seen)))], ["i", "w", "n"])
    return run


def fit(docs: DataFrame, words: DataFrame | None = None) -> tuple[Net, Vocabulary]:
    """Train on all texts, whose word counts may be given. The mean over partitions is a map-side-combined sum per weight."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("text").cast("string"))
    vocab = vocabulary(word_counts(docs) if words is None else words)
    shared_vocab = sc.broadcast(vocab)
    rng = np.random.default_rng(5)
    net = Net((rng.standard_normal((2 * SIDE, CLASSES + 1, WIDTH)) * 0.1).astype(np.float32), np.zeros(WIDTH, np.float32),
              (rng.standard_normal((WIDTH, CLASSES)) * 0.1).astype(np.float32), vocab.prior.copy())
    for r in range(ROUNDS):
        got = (texts.mapInArrow(_train(sc.broadcast(net.flat()), shared_vocab, r), "i int, w double, n double")
               .groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas())  # one row per weight
        if not len(got):
            break
        flat = np.zeros(len(net.flat()))
        flat[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(np.float64)
        net = Net.of(flat)
    return net, vocab


def score(docs: DataFrame, net: Net, vocab: Vocabulary, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob, unigram_log_prob) per document. `words`: the counts (word, n) behind the
    vocabulary; without them the probabilities are those of the words' slots."""
    sc = docs.sparkSession.sparkContext
    weights, shared = sc.broadcast(net.flat()), sc.broadcast(vocab)
    frequent = sc.broadcast(frequent_words(words)) if words is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = Net.of(weights.value), shared.value
        log_mass = np.log(v.mass) if frequent is not None else None
        for batch in batches:
            for c in tk.chunks(batch.column(1), tk.NOT_SPACE):
                slot = slots(c.words)
                both = np.stack([word_log_probs(n, v, slot, c.bounds).astype(np.float64),
                                 (v.prior[v.classes[slot] - 1] + v.share[slot]).astype(np.float64)])
                rest = np.zeros(len(slot), bool)
                if frequent is not None:
                    known, log_n = _log_counts(c.words, *frequent.value)
                    both += log_n - log_mass[slot]
                    rest = ~known
                total = np.concatenate([np.zeros((2, 1)), np.cumsum(both, axis=1)], axis=1)
                total = total[:, c.bounds[1:]] - total[:, c.bounds[:-1]]
                at = np.concatenate([[0], np.cumsum(rest)])[c.bounds]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.rows.start, len(c.rows)).cast(pa.int64()), pa.array(np.diff(c.bounds).astype(np.int64)), pa.array(total[0]),
                     pa.array(total[1]), tk.long_lists(np.split(c.words[rest], at[1:-1]))], ["doc_id", "n_words", "log_prob", "unigram_log_prob", "rest"])

    scored = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
              .mapInArrow(run, "doc_id long, n_words long, log_prob double, unigram_log_prob double, rest array<long>"))
    if words is not None:
        # numbered and written once: both the join of the words left open and the rows themselves are read from it
        scored = stored(scored.withColumn("row", F.monotonically_increasing_id()))
        more = (scored.select("row", F.explode("rest").alias("word")).join(words, "word", "left")
                .groupBy("row").agg(F.sum(F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).alias("more")))
        scored = (scored.join(more, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
                  .withColumn("log_prob", F.col("log_prob") + F.col("more")).withColumn("unigram_log_prob", F.col("unigram_log_prob") + F.col("more")))
    return scored.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"),
                         "unigram_log_prob")


def _log_counts(words: np.ndarray, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among the known ones, and the logarithms of their counts, 0 for the others."""
    if not len(known):
        return np.zeros(len(words), bool), np.zeros(len(words))
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    found = known[at] == words
    return found, np.where(found, np.log(n)[at], 0.0)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    words = word_counts(docs)
    return score(docs, *fit(docs, words), words)
