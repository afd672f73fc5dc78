"""Hashes of words over batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CUT = re.compile(rb"[\t-\r ]")
#: Bytes whose words are held at once; distinct words that a worker remembers.
PIECE, WORDS = 1 << 20, 150_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """XXH3 of words, each computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word, 20_240_229)
        return out


_hashes = Hashes()


def text_parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts' bytes (A-Z lower-cased) in batches of about PIECE, with the texts' numbers; longer texts are cut at white space."""
    owners: list[int] = []
    some: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        at = 0
        while at < len(raw):
            stop = len(raw)
            if stop - at > PIECE:
                cut = _CUT.search(raw, at + PIECE)
                stop = cut.start() if cut else stop
            owners.append(k)
            some.append(raw[at:stop])
            size += stop - at
            at = stop
            if size >= PIECE:
                yield owners, some
                owners, some, size = [], [], 0
    if some:
        yield owners, some


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lower-cased, cut at the six ASCII white spaces), and where each text's begin
    and end in them. A word's hash depends on its bytes alone."""
    found, count = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for owners, raws in text_parts(texts):
        words: list[bytes] = []
        for k, raw in zip(owners, raws, strict=True):
            some = raw.split()
            count[k] += len(some)
            words += some
        if len(_hashes) > WORDS:
            _hashes.clear()
        found.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(count)])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; of all words if there are fewer, but not none."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix64(out * _BASE + hashes[k : k + len(out)])
    return out
