"""Byte-level BPE encoding and decoding by replaying the merges over all words of a share of the corpus at once.

A task collects the distinct words (matches of the vocabulary's pattern) of BLOCK_CHARS of text and lays their bytes out as
one linked sequence. An inverted index has the positions of every token pair that is a merge. Ranks are taken in
ascending order; all positions of a rank merge together, and only their neighbours' pairs are looked up anew and
entered under their ranks. Words do not touch each other, so shares of the corpus can be replayed apart, without a shuffle.

A merge may bring up a pair of a lower rank, which then has to come before what is left of its own rank in that word: such
a word's later positions wait (`_first_turns`). Ids therefore equal those of merging each word's least rank, leftmost
first, whatever the vocabulary's ranks are.

Defined results: a null or empty text has no ids and decodes to nothing. Repeated rows each get the same ids. A word of any
length is one word. A byte without token, or an id without bytes, is an error. An empty table gives an empty table. Of the
input's columns only doc_id and text (or ids) are read. The vocabulary is a local file of the library that all nodes have.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text

#: Text whose words are replayed together; distinct words, and bytes of them, that a worker remembers; ids in a batch.
BLOCK_CHARS, WORDS, WORD_BYTES, BATCH_IDS = 8 << 20, 400_000, 8 << 20, 1 << 20
NONE = np.int32(2**31 - 1)
NO_IDS = np.empty(0, np.int32)


class Merges:
    """A vocabulary of ranks: its tokens' bytes, and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = max(ranks.values()) + 1
        found = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys = np.append(pairs[:, 0], np.iinfo(np.int64).max)
        self.ranks = np.append(pairs[:, 1].astype(np.int32), NONE)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE of those that are not merged; a negative token has no pair."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], NONE)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    with open(path, "rb") as lines:
        return Merges({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())})


def _first_turns(at: np.ndarray, rank: int, token: np.ndarray, after: np.ndarray, before: np.ndarray, word: np.ndarray, m: Merges) -> np.ndarray:
    """Of merges in order: those before which no other merge of their word has brought up a pair of a lower rank."""
    joins = np.zeros(len(at), bool)  # what is to the left has just been merged too
    joins[1:] = before[at[1:]] == after[at[:-1]]
    left = np.where(joins, rank, np.where(before[at] >= 0, token[before[at]], -1))
    beyond = after[after[at]]
    right = np.where(beyond >= 0, token[beyond], -1)
    here = np.full(len(at), rank)
    lower = (m.rank(left, here) < rank) | (m.rank(here, right) < rank)
    if not lower.any():
        return np.ones(len(at), bool)
    w = word[at]
    begin = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    earlier = np.cumsum(lower) - lower
    return earlier == np.repeat(earlier[begin], np.diff(np.append(begin, len(at))))


def replay(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and each word's number of ids."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    token = m.bytes[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    if n == 0:
        return NO_IDS, lengths
    if token.min() < 0:
        raise ValueError("a byte has no token")
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    ends = np.cumsum(lengths)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    rank = m.rank(token, np.where(after >= 0, token[after % n], -1))

    index: dict[int, list[np.ndarray]] = {}
    ready: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heapq.heappush(ready, r)

    some = np.flatnonzero(rank != NONE).astype(np.int32)
    if len(some):
        enter(some, rank[some])
    while ready:
        r = heapq.heappop(ready)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        every = at
        # In a chain of pairs that overlap, every second one merges.
        chained = np.append(False, after[at[:-1]] == at[1:])
        if chained.any():
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
        now = _first_turns(at, r, token, after, before, word, m)
        if not now.all():
            at = at[now]
            waiting = np.setdiff1d(every, at)
            enter(waiting, np.full(len(waiting), r))
        gone = after[at]
        beyond = after[gone]
        token[at] = r
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        token[gone] = -1
        rank[gone] = NONE
        left = before[at]
        touched = np.concatenate([at, left[left >= 0]])
        touched = touched[token[touched] >= 0]
        if len(touched) > len(at):
            touched = np.unique(touched)
        following = after[touched]
        new = m.rank(token[touched], np.where(following >= 0, token[following], -1))
        rank[touched] = new
        merge = new != NONE
        if merge.any():
            enter(touched[merge], new[merge])
    kept = token >= 0
    return token[kept], np.bincount(word[kept], minlength=len(words))


class Words(dict):
    """Words' numbers in the order in which they were first seen; `new` has those that are not replayed yet."""

    def __init__(self, m: Merges):
        self.merges, self.new, self.bytes = m, [], 0
        self.ids, self.begin, self.count = NO_IDS, np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        self.new.append(word)
        return out

    def replay_new(self) -> None:
        if self.new:
            raw = [w.encode("utf-8", "surrogatepass") for w in self.new]
            ids, count = replay(raw, self.merges)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
            self.bytes += sum(map(len, raw))
            self.new.clear()

    def spell(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of a sequence of words."""
        count = self.count[numbers]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.begin[numbers] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


#: A worker's words, by vocabulary file.
_known: dict[str, Words] = {}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    import public_tokenizers

    return encode_column(doc_text(docs), path, public_tokenizers.PATTERN)


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def spelled() -> Iterator[pa.RecordBatch]:
            words = _known[path]
            words.replay_new()
            at = 0
            while at < len(held):
                stop, total, out = at, 0, []
                while stop < len(held) and total < BATCH_IDS:
                    out.append(words.spell(held[stop]))
                    total += len(out[-1])
                    stop += 1
                offsets = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:stop], pa.int64()), ids], ["doc_id", "ids"])
                at = stop
            keys.clear()
            held.clear()
            if len(words) > WORDS or words.bytes > WORD_BYTES:
                del _known[path]

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if path not in _known:
                    _known[path] = Words(merges(path))
                text = text.as_py() or ""
                found = find(text)
                keys.append(doc_id)
                held.append(np.fromiter(map(_known[path].__getitem__, found), np.int32, len(found)))
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield from spelled()
                    size = 0
        if held:
            yield from spelled()

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def _digest_one(ids: np.ndarray, tokens: dict[int, bytes]) -> tuple[int, str, str]:
    sha, text = hashlib.sha256(ids.astype("<u4").tobytes()), hashlib.sha256()
    for k in range(0, len(ids), BATCH_IDS):
        text.update(b"".join(map(tokens.__getitem__, ids[k : k + BATCH_IDS].tolist())))
    return len(ids), sha.hexdigest(), text.hexdigest()


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """A list column's arrays; a null list is empty."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield values[offsets[k] : offsets[k + 1]] if column[k].is_valid else NO_IDS


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes (binary) of every list of ids; they need not be whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges(path).tokens
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, ids.tolist())) for ids in _lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian, 32 bits each) and of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges(path).tokens
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            rows = [_digest_one(ids, tokens) for ids in _lists(batch.column("ids"))]
            columns = [pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
