"""BPE encoding and decoding with a pair occurrence index (operator 1).

The words of a partition's batch that have not been seen yet are laid out as one linked list of symbols. An index
maps every adjacent pair to all its positions; the pairs that have a merge rank are active. Ranks are applied in
ascending order, each at all of its positions, and the neighbours' position lists are updated.
In a trained merge table a merge activates higher ranks only, so a rank's positions are merged at once, as arrays
(`merge_at_once`). For any other table they are merged from left to right, and a merge that activates a lower rank
puts the remaining positions back (`merge_in_turn`); that is what merging word by word gives.
Words that were encoded before come from a bounded cache.

The tokenizer file is a parameter: a `tokenizers` JSON of the kind BPE with an end-of-word suffix, the normalizers
NFC, white space and Lowercase, and a regular expression of kept pieces as pre-tokenizer. Special tokens inside
texts become their ids, as the library does. Encoding adds no special tokens; decoding keeps them.

Defined cases: null texts are empty, an empty text has no tokens; texts are processed whole; repeated rows each get
a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lingua_spark.llm.common import give_back

#: Entries of each of the two generations of a Python worker's cache. They bound memory and change no result.
CACHE_WORDS = 150_000
#: Entries up to which the newer generation stays between a worker's tasks.
KEPT_WORDS = 20_000
#: Characters whose new words are encoded together, and those whose results are made together.
BATCH_CHARS, RESULT_CHARS = 1 << 22, 1 << 19


def _byte_alphabet() -> list[str]:
    """Printable stand-ins of the 256 bytes, as byte-level BPE files write them."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        alphabet = _byte_alphabet()
        self.inner = [self.vocab[a] for a in alphabet]
        self.last = [self.vocab[a + suffix] for a in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        assert not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        made = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            made.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
        self.merges(made, max(self.tokens) + 1)
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pieces).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.numbers = {i: str(i) for i in self.tokens}
        #: white-space-free stretch of text -> its ids, as the bytes of 32-bit integers: what a worker keeps is small
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merges(self, made: list[tuple[int, int, int]], width: int) -> None:
        """Take over a merge table of (left, right, merged), by rank."""
        self.made, self.width = made, width
        self.rank: dict[int, int] = {}
        for r, (a, b, _) in enumerate(made):
            self.rank.setdefault(a * width + b, r)
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        last_made: dict[int, int] = {}
        for r, (_, _, c) in enumerate(made):
            last_made[c] = r
        self.ascending = all(last_made.get(x, -1) < r for r, (a, b, _) in enumerate(made) for x in (a, b))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each non-empty word, by one pair occurrence index over all of them."""
        if not words:
            return []
        ids, at = self._word_ids(words)
        ids = ids.tolist()
        return [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all words one after the other, and where each word's begin."""
        data = [w.encode() for w in words]
        size = np.array([len(b) for b in data])
        end = np.cumsum(size)
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbol = np.array(self.inner)[raw]
        symbol[end - 1] = np.array(self.last)[raw[end - 1]]
        if self.ascending:
            self.merge_at_once(symbol, end)
        else:
            symbol = np.array(self.merge_in_turn(symbol.tolist(), (end - size).tolist()))
        left = symbol >= 0
        return symbol[left].astype(np.int32), [0, *np.cumsum(left)[end - 1].tolist()]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 without one."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_at_once(self, symbol: np.ndarray, end: np.ndarray) -> None:
        """Apply the merges in place; symbols merged away become -1."""
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end - 1] = -1
        before[end[:-1]] = before[0] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(place: np.ndarray, rank: np.ndarray) -> None:
            have = rank >= 0
            place, rank = place[have], rank[have]
            if not len(place):
                return
            order = np.argsort(rank, kind="stable")
            place, rank = place[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, i, j in zip(rank[np.concatenate(([0], cut))].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(rank)], strict=True):
                if r in index:
                    index[r].append(place[i:j])
                else:
                    index[r] = [place[i:j]]
                    heapq.heappush(active, r)

        if len(self.keys):
            here = np.flatnonzero(after >= 0)
            add(here, self._rank_of(symbol[here], symbol[here + 1]))
        while active:
            r = heapq.heappop(active)
            a, b, c = self.made[r]
            found = index.pop(r)
            p = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            p = p[symbol[p] == a]
            q = after[p]
            good = (q >= 0) & (symbol[q] == b)
            p, q = p[good], q[good]
            if a == b and len(p) > 1:  # of overlapping pairs the first, the third, ...
                chosen, taken = [], -1
                for i, j in zip(p.tolist(), q.tolist(), strict=True):
                    if i != taken:
                        chosen.append((i, j))
                        taken = j
                p, q = (np.array(x) for x in zip(*chosen, strict=True))
            if not len(p):
                continue
            k = after[q]
            symbol[p], symbol[q] = c, -1
            after[p] = k
            some = k >= 0
            before[k[some]] = p[some]
            h = before[p]
            any_left = h >= 0
            k, h, pl = k[some], h[any_left], p[some]
            add(np.concatenate((pl, h)), self._rank_of(np.concatenate((symbol[pl], symbol[h])), np.concatenate((symbol[k], symbol[after[h]]))))

    def merge_in_turn(self, symbol: list[int], begins: list[int]) -> list[int]:
        """The same for tables in which a merge may activate a lower rank."""
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for s in begins:
            before[s] = -1
            if s:
                after[s - 1] = -1
        if n:
            after[n - 1] = -1
        width, rank, made = self.width, self.rank, self.made
        index: dict[int, list[int]] = {}
        for i in range(n):
            j = after[i]
            if j >= 0:
                r = rank.get(symbol[i] * width + symbol[j])
                if r is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            a, b, c = made[r]
            for at, i in enumerate(places):
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = c, -1
                k = after[i] = after[j]
                lower = False
                if k >= 0:
                    before[k] = i
                    s = rank.get(c * width + symbol[k])
                    if s is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(active, s)
                        lower = s < r
                p = before[i]
                if p >= 0:
                    s = rank.get(symbol[p] * width + c)
                    if s is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(active, s)
                        lower |= s < r
                if lower:
                    index.setdefault(r, []).extend(places[at + 1:])
                    heapq.heappush(active, r)
                    break
        return symbol

    def _stretch_words(self, stretch: str) -> list[str]:
        if not stretch.isascii():
            stretch = unicodedata.normalize("NFC", stretch).replace("Σ", "σ")  # no final-sigma rule
        return self.pieces(stretch.lower())

    def learn(self, stretches: set[str]) -> None:
        """Encode the stretches that are new, together."""
        if len(self.seen) > CACHE_WORDS:
            self.seen, self.older = {}, self.seen
        seen, older = self.seen, self.older
        new = []
        for s in stretches:
            if s not in seen:
                if s in older:
                    seen[s] = older[s]
                else:
                    new.append(s)
        if not new:
            return
        parts = [self._stretch_words(s) for s in new]
        words = list({w for p in parts for w in p})
        if not words:
            seen.update(dict.fromkeys(new, b""))
            return
        ids, at = self._word_ids(words)
        raw = ids.tobytes()
        coded = {w: raw[4 * i:4 * j] for w, i, j in zip(words, at[:-1], at[1:], strict=True)}
        for s, p in zip(new, parts, strict=True):
            seen[s] = coded[p[0]] if len(p) == 1 else b"".join([coded[w] for w in p])

    def rest(self) -> None:
        """Between tasks: keep few entries, since the worker goes on to other stages, and give back what is freed."""
        self.older = {}
        if len(self.seen) > KEPT_WORDS:
            self.seen = {}
        give_back()

    def stretches(self, text: str) -> list[str]:
        """White-space-free stretches in order; special tokens are stretches of their own."""
        if any(s in text for s in self.special):
            out: list[str] = []
            for p in self.at_special(text):
                out += [p] if p in self.special else self._split(p)
            return out
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        # str.split also parts at four control characters that are not white space to the tokenizer
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [p for p in regex.split(r"[^\S\x1c-\x1f]+", text) if p]
        return text.split()

    def encode_ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        # texts are split a second time below: the stretches of a batch would take several times its memory
        self.learn(set().union(*map(self.stretches, texts)) - self.special.keys())
        seen = self.seen
        for s, i in self.special.items():
            seen[s] = np.int32(i).tobytes()
        for t in texts:
            yield b"".join(map(seen.__getitem__, self.stretches(t)))

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(token count, ids joined by blanks, decoded text) of each text."""
        for raw in self.encode_ids(texts):
            ids = np.frombuffer(raw, np.int32).tolist()
            yield len(ids), " ".join(map(self.numbers.__getitem__, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that end where `most` is reached."""
    i = total = 0
    for j, n in enumerate(sizes):
        total += n
        if total >= most:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(sizes):
        yield i, len(sizes)


_loaded: dict[str, PairIndexBpe] = {}


def tokenizer(path: str) -> PairIndexBpe:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def _map(docs: DataFrame, path: str, ddl: str, columns: Callable) -> DataFrame:
    """`columns` makes the result's columns, doc_id aside, of a tokenizer and some texts' ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        try:
            for batch in batches:
                texts = batch.column(1).fill_null("").to_pylist()
                sizes = [len(x) for x in texts]
                for i, j in _groups(sizes, BATCH_CHARS):
                    ids = t.encode_ids(texts[i:j])
                    for k, m in _groups(sizes[i:j], RESULT_CHARS):
                        made = columns(t, list(islice(ids, m - k)))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + k, m - k).cast(pa.int64()), *made.values()], ["doc_id", *made])
        finally:
            batch = texts = ids = made = None  # noqa: F841 - they hold the last batch and the caches
            t.rest()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) per document."""
    def columns(t: PairIndexBpe, raw: list[bytes]) -> dict[str, pa.Array]:
        at = np.cumsum([0, *(len(r) // 4 for r in raw)])
        ids = np.frombuffer(b"".join(raw), np.int32)
        decoded = [t.decode(ids[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)]
        return {"n_tokens": pa.array(np.diff(at), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                "decoded": pa.array(decoded, pa.string())}
    return _map(docs, path, "doc_id long, n_tokens long, ids array<int>, decoded string", columns)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document."""
    def columns(t: PairIndexBpe, raw: list[bytes]) -> dict[str, pa.Array]:
        ids = [np.frombuffer(r, np.int32).tolist() for r in raw]
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([_sha256(" ".join(map(t.numbers.__getitem__, x))) for x in ids], pa.string()),
                "decoded_sha256": pa.array([_sha256(t.decode(x)) for x in ids], pa.string())}
    return _map(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
