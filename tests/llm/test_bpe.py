import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import edge_docs, edge_rows, no_docs
from lingua_spark.llm import bpe

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def test_matches_library_on_odd_texts(library):
    rng = random.Random(1)
    pool = [*"aAbBéÉ ßΣςσİıſK'stredvm  \n\t\x1c\x1f\x85\xa0　123٣४中文é😀ﬁ​\x00-_.!?", "<|endoftext|>", "<|startoftext|>", "<|", "'ll", "hello", "thth"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    mine = bpe.PairIndexBpe(PATH)
    for t, got in zip(texts, mine.encode_texts(texts)):
        assert got == expected(library, t), t
    ids = library.encode(texts[3], add_special_tokens=False).ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rank_order_does_not_depend_on_the_merge_table():
    """A made-up table in which a merge activates a lower rank than its own."""
    t = bpe.PairIndexBpe.__new__(bpe.PairIndexBpe)
    rng = random.Random(2)
    t.inner, t.last, t.width = list(range(256)), list(range(256)), 600
    any_order = 0
    for n in range(300):
        merges, new = [], 256
        symbols = [97, 98, 99]
        for _ in range(8):
            merges.append((rng.choice(symbols), rng.choice(symbols), new))
            symbols.append(new)
            new += 1
        if n % 3:
            rng.shuffle(merges)
        t.merges(merges, t.width)
        any_order += not t.ascending
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(20)]
        for w, got in zip(words, t.encode_words(words)):
            s = list(w.encode())
            while True:
                best = min(((t.rank.get(x * t.width + y, 10**9), i) for i, (x, y) in enumerate(zip(s, s[1:]))), default=(10**9, 0))
                if best[0] == 10**9:
                    break
                s[best[1]:best[1] + 2] = [merges[best[0]][2]]
            assert got == s
    assert 0 < any_order < 300


def test_documents(spark, library):
    got = sorted(map(tuple, bpe.encode_digests(edge_docs(spark), PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in edge_rows():
        n, ids, text = expected(library, r[1])
        want.append((r[0], n, sha(ids), sha(text)))
    assert got == sorted(want, key=str)
    full = bpe.encode(edge_docs(spark).where("doc_id = 60"), PATH).first()
    assert full["ids"] == library.encode(edge_rows()[6][1], add_special_tokens=False).ids
    assert bpe.encode_digests(no_docs(spark), PATH).count() == 0


def test_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    mine = bpe.PairIndexBpe(PATH)
    for t in ["some words here", "other words there and more words", "<|endoftext|> again words"] * 3:
        assert list(mine.encode_texts([t])) == [expected(library, t)]


def test_a_worker_keeps_little_per_stretch(library):
    """The caches stay in a Python worker after the stage: ids alone, not their texts."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh'0é") for _ in range(rng.randint(3, 9))) for _ in range(100)) for _ in range(50)]
    mine = bpe.PairIndexBpe(PATH)
    assert list(mine.encode_texts(texts)) == [expected(library, t) for t in texts]
    held = [x for v in mine.seen.values() for x in ([v, *v] if isinstance(v, tuple) else [v])]
    assert len(mine.seen) > 4000 and sum(map(sys.getsizeof, held)) < 80 * len(mine.seen)


def test_results_leave_in_small_batches(spark, library, monkeypatch):
    texts = [f"document {i} says " + "word " * i for i in range(40)] + ["", None]
    monkeypatch.setattr(bpe, "RESULT_CHARS", 100, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in bpe.encode(df, PATH).collect()}
    for i, t in enumerate(texts):
        n, ids, text = expected(library, t)
        assert (got[i]["n_tokens"], " ".join(map(str, got[i]["ids"])), got[i]["decoded"]) == (n, ids, text)


def test_a_worker_keeps_few_stretches_between_tasks(spark, library, monkeypatch):
    """The worker that ran a task goes on to other stages: large caches go with the task, small ones stay."""
    import pyarrow as pa

    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, ddl):
            return run

    monkeypatch.setattr(bpe, "KEPT_WORDS", 1000, raising=False)
    monkeypatch.setattr(bpe, "_loaded", {})
    rng = random.Random(4)
    for words, kept in ((200, True), (3000, False), (200, True)):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(words)), None, "<|endoftext|> again"]
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts, pa.string())], ["doc_id", "text"])
        got = [r for b in bpe.encode(Table(), PATH)(iter([batch])) for r in b.to_pylist()]
        assert [(r["n_tokens"], " ".join(map(str, r["ids"])), r["decoded"]) for r in got] == [expected(library, t) for t in texts]
        mine = bpe.tokenizer(PATH)
        assert not mine.older and (len(mine.seen) >= words if kept else not mine.seen)
