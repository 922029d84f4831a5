"""Brute-force twins of the operators and small fixtures."""

from __future__ import annotations

import random
import re

WORDS2 = re.compile(r"[^\x20\x09-\x0D]+")
WORDS10 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, doc string, removed string, gone int, score double, hit long"


def words(text, rule=WORDS2):
    return rule.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, len(text) if text is not None else None, "own", "own", 1, 0.5, 3)


def edge_texts(seed=3):
    """Copies, near copies, shared passages, short, empty, null, very long and repeated texts."""
    rng = random.Random(seed)
    base = [prose(rng, 80) for _ in range(12)]
    passage = prose(rng, 60)
    out = [None, "", "   \n\t ", "One", "one  two\tthree", "ONE two THREE", "ÉTÉ été Été\n" * 3, "a b c d e", "A B c d e\nf g h i j k"]
    out += base
    out += [base[0], base[0].upper(), base[1], base[2] + " tail"]
    out += [changed(rng, base[3], p) for p in (0.01, 0.03, 0.03, 0.05, 0.08, 0.15, 0.4)]
    out += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 30)}" for _ in range(6)]
    out += [f"{prose(rng, 40)}\n{changed(rng, passage, 0.02)}" for _ in range(4)]
    out += [f"{passage} {prose(rng, 10)}", prose(rng, 30000), "\n".join([prose(rng, 12)] * 3 + [prose(rng, 12)])]
    return out


def edge_rows(seed=3):
    rows = [row(10 * i, t, None if i % 5 == 0 else "en") for i, t in enumerate(edge_texts(seed))]
    return rows + [rows[9], rows[30], row(None, rows[9][1]), row(None, None), row(-5, rows[12][1])]


def edge_docs(spark, seed=3):
    return spark.createDataFrame(edge_rows(seed), SCHEMA).repartition(5)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def components(rows):
    """{doc_id: smallest reachable doc_id} of (doc_id, text) rows."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            n = len(s & t)
            if s and t and 100 * n >= 75 * (len(s) + len(t) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in parent}


def line_sets(rows):
    out = {}
    for d, t in rows:
        if d is None:
            continue
        for k, line in enumerate((t or "").split("\n")):
            if words(line):
                out[d, k] = shingles(line)
    return out


def later_lines(rows):
    """{(doc_id, line)} with an earlier line at the threshold."""
    sets = line_sets(rows)
    keys = sorted(sets)
    return {b for i, b in enumerate(keys) for a in keys[:i]
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def contamination(text, items):
    """(words, hit words, item ids as text)"""
    w = words(text, WORDS10)
    hit, found = set(), set()
    for item, body in items:
        v = words(body, WORDS10)
        m = min(10, len(v))
        windows = {tuple(v[i:i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i:i + m]) in windows:
                hit.update(range(i, i + m))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)
