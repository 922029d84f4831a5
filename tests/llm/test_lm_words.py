import math

import pyarrow as pa
import pytest

from lingua_spark.llm import lm_scoring as lm, textkernel as tk


def _pair():
    """Two words of one slot."""
    seen = {}
    for i in range(10**6):
        c = next(iter(tk.chunks(pa.array([f"w{i}"], pa.string()), tk.NOT_SPACE)))
        slot = int(lm.slots(c.words)[0])
        if slot in seen:
            return seen[slot], f"w{i}"
        seen[slot] = f"w{i}"


@pytest.mark.parametrize("frequent", [1 << 18, 1, 0])
def test_words_of_one_slot_keep_their_own_counts(spark, monkeypatch, frequent):
    """Whether a word's count is found in the broadcast or by the join, its probability is its own."""
    monkeypatch.setattr(lm, "FREQUENT", frequent, raising=False)
    often, seldom = _pair()
    texts = [often] * 29 + [seldom, f"{often} {seldom} {often}", None, "", "other words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.pseudo_likelihood(docs).collect()}
    assert len(got) == len(texts)
    ratio = math.log(31 / 2)
    for score in ("log_prob", "unigram_log_prob"):
        assert got[0][score] - got[29][score] == pytest.approx(ratio, rel=1e-5)
    both = got[30]
    assert both["unigram_log_prob"] == pytest.approx(2 * got[0]["unigram_log_prob"] + got[29]["unigram_log_prob"], rel=1e-5)
    assert both["mean_log_prob"] == pytest.approx(both["log_prob"] / 3)
    assert got[31]["log_prob"] == got[32]["log_prob"] == 0.0 and got[31]["mean_log_prob"] is None


def test_counts_of_all_words(spark, monkeypatch):
    """Counts that leave a task in several parts add up."""
    monkeypatch.setattr(lm, "POOL", 4)
    docs = spark.createDataFrame([(i, f"a b{i % 7} a c{i}") for i in range(50)], "doc_id long, text string")
    assert sorted(r["n"] for r in lm.word_counts(docs).collect()) == sorted([100] + [len(range(k, 50, 7)) for k in range(7)] + [1] * 50)
