"""Periodic runs of words: maximal stretches that repeat a period at least four times, found by internal pattern matching.

A run of period q holds whole aligned blocks of B words, B the power of two with B <= q < 2B, and such a block occurs
again q words on. So for every level B, each block asks where it occurs at distances B to 2B - 1. Its occurrences are an
interval of the suffix array (prefix doubling gives it with the ranks of all words of B letters), and a wavelet tree over
the suffix array answers the range successor: the first, second and last place from B on. Two places are two candidate
periods; more of them are a progression whose difference p is a period of the block, and then only the distances at which
the ends of the two p-periodic stretches meet can be a period (any other is a multiple of p). Candidates are extended both
ways by the doubling ranks, and those of one stretch keep the least, which is its smallest period.

Every text is searched where its row lies, without a shuffle; texts are taken in groups of WORDS words with a separator
each. A block asks only if each of the 2B words from its begin on comes again within less than 2B words, which is so in
every run of its level; texts without such a block, most of them, need no suffix array.

Defined results: a null or empty text has no words and no runs. Repeated rows each get the same result; in a text
of null doc_id nothing is planted. An empty table gives an empty table. Of the input's columns
only doc_id and text are read. Memory follows the longest text: some 4 bytes for each word and level of doubling.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text

#: Words that are searched together, at least (a text is never cut); repeats and words that make a stretch a run.
WORDS, TIMES, LEAST = 200_000, 4, 6
Run = tuple[int, int, int]


class WaveletTree:
    """Over an array of numbers below 2**bits, level by level from the highest bit (a wavelet matrix). A level is its bits,
    64 to a word, and the number of ones before each word."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in reversed(range(self.bits)):
            one = (values >> b) & 1 == 1
            padded = np.zeros(-(-(len(values) + 1) // 64) * 64, np.uint8)
            padded[: len(values)] = one
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, np.cumsum(ones) - ones, len(values) - int(ones.sum())))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before places."""
        low = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(low)

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values at lo to hi - 1 are less than a bound."""
        out, whole, full = np.zeros(len(lo), np.int64), hi - lo, bound >> self.bits > 0
        for k, (words, before, zeros) in enumerate(self.levels):
            bit = (bound >> (self.bits - 1 - k)) & 1 == 1
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            out += np.where(bit, (hi - b) - (lo - a), 0)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return np.where(full, whole, out)

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest (from 0) of the values at lo to hi - 1."""
        out = np.zeros(len(lo), np.int64)
        for words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            none = (hi - b) - (lo - a)
            bit = n >= none
            out = out * 2 + bit
            n = np.where(bit, n - none, n)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return out


class Factors:
    """The suffix array of a sequence, and for each level k the rank of the word of 2**k letters at each place. A rank is
    the place in the suffix array of the first suffix that begins with that word."""

    def __init__(self, letters: np.ndarray):
        n = self.n = len(letters)
        suffixes = np.argsort(letters, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        self.ranks: list[np.ndarray] = []
        begin = self._begins(letters[suffixes])
        rank[suffixes] = begin
        step = 1
        while True:
            self.ranks.append(rank)
            slots = np.flatnonzero(np.bincount(rank, minlength=n)[begin] > 1)
            if not len(slots):
                break
            # Only suffixes whose words are not unique yet are sorted further, each group within its own slots.
            some = suffixes[slots]
            next_ = np.where(some + step < n, rank[np.minimum(some + step, n - 1)].astype(np.int64) + 1, 0)
            key = rank[some].astype(np.int64) * (n + 1) + next_
            order = np.argsort(key, kind="stable")
            suffixes[slots] = some[order]
            key = key[order]
            new = np.append(True, key[1:] != key[:-1])
            begin[slots] = np.maximum.accumulate(np.where(new, slots, 0))
            rank = rank.copy()
            rank[some[order]] = begin[slots]
            step *= 2
        self.suffixes = suffixes

    @staticmethod
    def _begins(ordered: np.ndarray) -> np.ndarray:
        new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0)).astype(np.int32)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters from a and from b on are the same, a < b."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            inside = b + out < self.n
            x, y = np.minimum(a + out, self.n - 1), np.minimum(b + out, self.n - 1)
            out += np.where(inside & (self.ranks[k][x] == self.ranks[k][y]), 1 << k, 0)
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters before a and before b are the same, a < b."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            out += np.where((x >= 0) & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)]), 1 << k, 0)
        return out


def _distances(letters: np.ndarray) -> np.ndarray:
    """How far on each letter comes again; very far if it does not."""
    order = np.argsort(letters, kind="stable")
    out = np.full(len(letters), 1 << 40)
    same = letters[order[1:]] == letters[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _asking(distances: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each level its length B and the begins of the blocks in which a run of periods B to 2B - 1 can be found."""
    n, b = len(distances), 1
    while TIMES * b <= n:
        # The words from a block's begin to 2B further on.
        near = np.append(0, np.cumsum(distances < 2 * b))
        begins = np.arange(0, n - 2 * b + 1, b)
        begins = begins[near[begins + 2 * b] - near[begins] == 2 * b]
        if len(begins):
            yield b, begins
        b *= 2


def sequence_runs(letters: np.ndarray) -> list[Run]:
    """start, length, period of every run of a sequence whose last letter occurs nowhere else; by start, then period."""
    levels = list(_asking(_distances(letters)))
    if not levels:
        return []
    factors = Factors(letters)
    tree = WaveletTree(factors.suffixes)
    found: list[np.ndarray] = []
    for b, begins in levels:
        k = b.bit_length() - 1
        if k >= len(factors.ranks):
            break
        lo = factors.ranks[k][begins].astype(np.int64)
        size = np.bincount(factors.ranks[k], minlength=factors.n)[lo]
        begins, lo, size = begins[size > 1], lo[size > 1], size[size > 1]
        hi = lo + size
        top = np.minimum(begins + 2 * b, factors.n)
        first, stop = tree.below(lo, hi, begins + b), tree.below(lo, hi, top)
        hit = stop > first
        begins, lo, hi, first, stop = begins[hit], lo[hit], hi[hit], first[hit], stop[hit]
        if not len(begins):
            continue
        one = tree.nth(lo, hi, first)
        many = stop - first
        two = tree.nth(lo, hi, np.minimum(first + 1, stop - 1))
        few = many <= 2
        at, distance = [begins[few], begins[few]], [(one - begins)[few], (two - begins)[few]]
        a, x, last = begins[~few], one[~few], tree.nth(lo[~few], hi[~few], stop[~few] - 1)
        p = two[~few] - x
        # Where the p-periodic stretches around the block and around its first place begin and end, from those two.
        ends = factors.forward(x, x + p) - factors.forward(a, a + p)
        starts = factors.backward(a, a + p) - factors.backward(x, x + p)
        for d in (x - a + ends, x - a + starts):
            fit = (d >= x - a) & (d <= last - a) & ((d - (x - a)) % p == 0)
            at.append(a[fit])
            distance.append(d[fit])
        a, d = np.concatenate(at), np.concatenate(distance)
        start = a - factors.backward(a, a + d)
        length = a + d + factors.forward(a, a + d) - start
        fit = length >= np.maximum(LEAST, TIMES * d)
        found.append(np.stack([start[fit], length[fit], d[fit]], axis=1))
    if not found:
        return []
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, then period
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]]
    return [tuple(r) for r in runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist()]


def _letters(words: list[bytes], numbers: dict) -> np.ndarray:
    """Words as numbers within one text."""
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def text_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as words. Texts that have a block to ask are searched together."""
    out: list[list[Run]] = [[] for _ in texts]
    held: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    size = free = 0

    def search() -> None:
        at = 0
        begins = [b for _, b in owners]
        for start, length, period in sequence_runs(np.concatenate(held)):
            while at + 1 < len(owners) and begins[at + 1] <= start:
                at += 1
            out[owners[at][0]].append((start - begins[at], length, period))

    for k, words in enumerate(texts):
        if len(words) < LEAST:
            continue
        numbers: dict[bytes, int] = {}
        letters = _letters(words, numbers)
        if len(numbers) == len(words) or next(_asking(_distances(letters)), None) is None:
            continue
        # Each text has letters of its own, and one more that ends it.
        held.append(np.append(letters, len(numbers)) + free)
        owners.append((k, size))
        size, free = size + len(words) + 1, free + len(numbers) + 1
        if size >= WORDS:
            search()
            held, owners, size, free = [], [], 0, 0
    if held:
        search()
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words from a place on replaced by repeats of those there, in one text of ten, by a hash of its doc_id."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // len(part))))[: n - a]


def _rows(docs: DataFrame, function: Callable[[list[int | None], list[list[bytes]], list[list[Run]]], list[tuple]], schema: str, change: Callable | None) -> DataFrame:
    """Rows made of texts and their runs, group by group; function gets doc_ids, words and runs."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)

        def done() -> pa.RecordBatch:
            rows = function(keys, texts, text_runs(texts))
            keys.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        keys: list[int | None] = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: exactly the six ASCII white spaces
                keys.append(doc_id)
                texts.append(words if change is None else change(doc_id, words))
                size += len(words) + 1
                if size >= WORDS:
                    yield done()
                    size = 0
        if keys:
            yield done()

    return doc_text(docs).mapInArrow(run, kinds)


def runs(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """doc_id, run (from 0), start, length, period: a row per run. change, if given, makes a text's words of (doc_id, words)."""

    def rows(keys: list, texts: list, found: list) -> list[tuple]:
        return [(k, i, *r) for k, rs in zip(keys, found, strict=True) for i, r in zip(count(), rs, strict=False)]

    return _rows(docs, rows, "doc_id long, run long, start long, length long, period long", change)


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id and text with each run cut to its first period, its words joined by one space."""

    def rows(keys: list, texts: list, found: list) -> list[tuple]:
        return [(k, b" ".join(kept_words(w, r)).decode("utf-8", "surrogatepass")) for k, w, r in zip(keys, texts, found, strict=True)]

    return _rows(docs, rows, "doc_id long, text string", None)


def _digest_one(doc_id: int | None, words: list[bytes], found: list[Run]) -> tuple:
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    start, length, period = best or (None, None, None)
    listed = "".join("%d,%d,%d\n" % r for r in found)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(found), start, length, period, best and 1000 * length // period, sha(listed.encode()), sha(b" ".join(kept_words(words, found)))


def digests(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """A row per text: n_runs, the longest run and its exponent, and the SHA-256 of its runs and of its kept words."""

    def rows(keys: list, texts: list, found: list) -> list[tuple]:
        return [_digest_one(*x) for x in zip(keys, texts, found, strict=True)]

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _rows(docs, rows, schema, change)
