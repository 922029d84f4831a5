import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import SCHEMA, edge_rows, no_docs, prose, row
from lingua_spark.llm import substring_dedup as sd


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        out.append((r[0], len(w), len(gone), sorted(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def check(spark, rows, parts=4):
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == ["doc_id", "n_words", "n_removed", "removed", "kept"]
    flat = [(r["doc_id"], r["n_words"], r["n_removed"], [p for s in r["removed"] for p in range(s["start"], s["end"])], r["kept"]) for r in got.collect()]
    want = brute(rows, sd.WINDOW)
    assert sorted(flat, key=str) == sorted(want, key=str)
    return want


def mixed(seed, vocabulary=4000):
    """Passages around the window's length, shared within and between documents, with other white space and case."""
    rng = random.Random(seed)
    passages = [prose(rng, n, vocabulary) for n in (20, 34, 35, 36, 50, 90)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 50), vocabulary)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 12), vocabulary)]
        rows.append(row(i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [row(100, passages[4].upper()), row(101, passages[5].replace(" ", "\r\n")), row(3, rows[3][1]), row(None, rows[4][1]), row(102, passages[2]),
             row(103, f"{passages[3]} {passages[3]}"), row(104, "x " * 200), row(105, "éà " * 34), row(106, " ")]
    return rows


def test_edge_documents(spark):
    rows = edge_rows()
    check(spark, rows + [row(900, rows[10][1]), row(901, None)])


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(spark, seed):
    want = check(spark, mixed(seed))
    assert sum(w[2] > 0 for w in want) > 20 and any(0 < w[2] < w[1] for w in want)


def test_heavy_groups_and_small_trees(spark, monkeypatch):
    """Groups beyond HEAVY take whole windows, combined in small blocks; the others fill several trees."""
    monkeypatch.setattr(sd, "HEAVY", 3)
    monkeypatch.setattr(sd, "COMBINE", 50)
    monkeypatch.setattr(sd, "GROUP", 5)
    check(spark, mixed(3) + [row(200 + i, mixed(3)[7][1]) for i in range(20)])


def test_repetitive_texts(spark):
    """Few different words: equal runs everywhere, repeats that overlap themselves."""
    rng = random.Random(4)
    check(spark, [row(i, prose(rng, rng.randrange(0, 120), 2)) for i in range(40)] + [row(90, "a b " * 60), row(91, "b a " * 18)])


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "MOST_BITS", 64)
    monkeypatch.setattr(sd, "HEAVY", 3)
    real = sd.membership
    monkeypatch.setattr(sd, "membership", lambda df, column, bits: real(df, column, 64))
    check(spark, mixed(5))


def test_suffix_order():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 90, 200, 260])
    words = rng.integers(0, 2, 260).astype(np.uint64)
    words[100:180] = words[5:85]
    starts = np.concatenate([np.arange(0, 50), np.arange(90, 160), np.arange(200, 220)])
    order, common = sd.suffix_order(words, bounds, starts)
    ends = bounds[1:][np.searchsorted(bounds, starts, side="right") - 1]
    texts = [tuple(words[s:e]) for s, e in zip(starts, ends, strict=True)]
    assert [texts[i][:64] for i in order] == sorted(t[:64] for t in texts)
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == min(same, 63)


def test_empty_table(spark):
    assert sd.remove_repeats(no_docs(spark)).collect() == []
