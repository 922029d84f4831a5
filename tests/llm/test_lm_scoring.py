import numpy as np
import pytest

from helpers import edge_docs, edge_rows, no_docs, words
from lingua_spark.llm import lm_scoring as lm


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, *lm.fit(docs)


def test_scores_are_the_sum_of_conditionals(spark, fitted):
    _, net, vocab = fitted
    got = {r["doc_id"]: r for r in lm.score(edge_docs(spark), net, vocab).collect() if r["doc_id"] is not None}
    import pyarrow as pa
    from lingua_spark.llm import textkernel as tk
    for d, text in [(r[0], r[1]) for r in edge_rows() if r[0] is not None and len(r[1] or "") < 2000]:
        slot = np.concatenate([np.zeros(0, np.int64), *(lm.slots(c.words) for c in tk.chunks(pa.array([text], pa.string()), tk.NOT_SPACE))])
        cls = vocab.classes[slot]
        total = 0.0
        for i in range(len(slot)):
            h = net.bias.astype(float).copy()
            for j, o in enumerate([-2, -1, 1, 2]):
                h += net.embed[j][cls[i + o] if 0 <= i + o < len(slot) else 0]
            z = np.tanh(h) @ net.out + net.out_bias
            total += z[cls[i] - 1] - np.log(np.exp(z).sum()) + vocab.share[slot[i]]
        assert got[d]["n_words"] == len(words(text)) == len(slot)
        assert got[d]["log_prob"] == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert (got[d]["mean_log_prob"] is None) == (len(slot) == 0)
    # probabilities sum to one over all slots
    z = lm.log_softmax((np.tanh(net.bias) @ net.out + net.out_bias)[None])[0]
    assert np.exp(z[vocab.classes - 1].astype(float) + vocab.share).sum() == pytest.approx(1.0, rel=1e-3)


def test_gradient():
    rng = np.random.default_rng(0)
    net = lm.Net((rng.standard_normal((4, lm.CLASSES + 1, lm.WIDTH)) * 0.3).astype(np.float32), np.zeros(lm.WIDTH, np.float32),
                 (rng.standard_normal((lm.WIDTH, lm.CLASSES)) * 0.3).astype(np.float32), np.zeros(lm.CLASSES, np.float32))
    around, target = rng.integers(0, lm.CLASSES + 1, (64, 4)), rng.integers(0, lm.CLASSES, 64)

    def loss(n):
        return -lm.log_softmax(lm.hidden(n, around) @ n.out + n.out_bias)[np.arange(64), target].astype(float).mean()

    grads = {}
    t = lm.Trainer(net)
    t._step = lambda k, value, grad: grads.__setitem__(k, grad.copy())
    t.train(around, target)
    for k, name in enumerate(("embed", "bias", "out", "out_bias")):
        x = getattr(net, name)
        at = np.unravel_index(np.abs(grads[k]).argmax(), x.shape)
        old = x[at]
        x[at] = old + 1e-2
        up = loss(net)
        x[at] = old - 1e-2
        down = loss(net)
        x[at] = old
        assert (up - down) / 2e-2 == pytest.approx(grads[k][at], rel=0.05)


def test_beats_unigrams_on_other_documents(spark, fitted):
    docs, _, _ = fitted
    other = "pmod(xxhash64(doc_id), 5) = 0"
    model = lm.fit(docs.where(f"not {other}"))
    r = lm.score(docs.where(other), *model).selectExpr("sum(log_prob) a", "sum(unigram_log_prob) b").first()
    assert r["a"] > r["b"]


def test_empty_tables(spark):
    assert lm.pseudo_likelihood(no_docs(spark)).count() == 0
    got = {r["doc_id"]: r for r in lm.pseudo_likelihood(edge_docs(spark)).collect()}
    assert got[0]["n_words"] == 0 and got[0]["log_prob"] == 0.0 and got[0]["mean_log_prob"] is None
