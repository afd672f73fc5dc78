"""Token counts by a compiled transducer.

A vocabulary of byte pairs is compiled into a deterministic transducer over bytes, some of which end a word. It rests on a
property of merges by rank: pieces are the encoding of their text if and only if each two neighbours are the encoding of
theirs. So the last token of every prefix of a word follows from those of shorter prefixes: it is the one token ending there
that may stand after the last token of what is before it. A state is what the future can depend on: the suffixes that some
token may still continue, with the last token before each and how many tokens fewer there are up to it. Transitions carry the
number of tokens that they add (which may be negative, as a longer token takes the place of shorter ones); a byte that ends a
word leads home, to the state between words. States and transitions are made from the vocabulary and its merges when a text
first needs them, and are numbers from then on; when there are TRANSITIONS of them, the table begins anew.

What a run of symbols does from a state is its map: the state after it and the tokens added. Maps compose, in any cut of a
text into chunks. Words are maps from home to home; the distinct ones of a batch advance side by side, a symbol each step, and
a text's map is composed of its words' by prefix sums. Long words run by themselves, with one state at any time.

Before that a text is normalised and cut into words as the vocabulary file says (composed, lower-cased, words by a pattern);
special strings are tokens of their own.

Defined results: a null text counts as empty, with 0 tokens. Repeated rows each get their count. Very long texts and words
take memory in proportion to the text. An empty table gives an empty table. Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import doc_text, map_arrow

LIMIT, TRANSITIONS, LONG_WORD, BATCH_CHARS, HOME = 2048, 500_000, 48, 1 << 20, 0
#: The words' symbols: a byte, or a byte that ends a word (END more).
END, SYMBOLS, SHIFT = 256, 512, 1024
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Fixed value: the pattern of words of this kind of vocabulary, with white space by its Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable ones for themselves, others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """A token is a string of symbols. trans: (state, symbol) as one number, to next state and added tokens as one number."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letter = file["model"], byte_letters()
        kinds = [n["type"] for n in file["normalizer"]["normalizers"]]
        if kinds != NORMALIZERS or model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path} is not a vocabulary of lower-case words with word ends")

        def symbols(token: str) -> str:
            core = token.removesuffix("</w>")
            found = [letter[c] for c in core]
            if core != token:
                found[-1] += END
            return "".join(map(chr, found))

        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in file["added_tokens"]))
        special = {t["content"] for t in file["added_tokens"]}
        self.tokens = {t: t for t in (symbols(x) for x in model["vocab"] if x not in special)}
        self.begins = {t[:k]: t[:k] for t in self.tokens for k in range(1, len(t))}
        # Numbers of tokens: symbols, then merged ones by rank; what each of these was merged from, and the other way round.
        self.id = {chr(k): k for k in range(SYMBOLS)}
        self.halves, self.whole = [(k, k) for k in range(SYMBOLS)], {}
        for pair in model["merges"]:
            x, y = map(symbols, pair if isinstance(pair, list) else pair.split(" "))
            self.whole[self.id[x], self.id[y]] = self.id[x + y] = len(self.halves)
            self.halves.append((self.id[x], self.id[y]))
        self.words = regex.compile(WORDS)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [(("", "", 0),)]
        self.number: dict[tuple, int] = {self.states[0]: HOME}
        self.trans: dict[int, int] = {}

    def may_follow(self, before: str, text: str) -> bool:
        """Whether two tokens are the encoding of their text. Both are undone, the later merge first: had a pair across
        them been merged before what is undone so far, it would have taken its place."""
        if not before:
            return True
        a, b = self.id[before], self.id[text]
        bound = len(self.halves)
        while True:
            if self.whole.get((a, b), bound) < bound:
                return False
            if a > b and a >= SYMBOLS:
                bound, a = a, self.halves[a][1]
            elif b >= SYMBOLS:
                bound, b = b + 1, self.halves[b][0]  # of equal ranks, that on the left was merged first
            else:
                return True

    def compile(self, key: int) -> int:
        """A transition that is not in the table yet."""
        state, symbol = self.states[key // SYMBOLS], chr(key % SYMBOLS)
        last, added, going = "", 0, []
        for suffix, before, fewer in state:  # the longest suffix first
            text = suffix + symbol
            if not last and text in self.tokens and self.may_follow(before, text):
                last, added = self.tokens[text], fewer + 1
            if (kept := self.begins.get(text)) is not None:
                going.append((kept, before, fewer))
        if key % SYMBOLS >= END:
            target = HOME
        else:
            after = (*((s, b, f - added) for s, b, f in going), ("", last, 0))
            target = self.number.setdefault(after, len(self.states))
            if target == len(self.states):
                self.states.append(after)
        self.trans[key] = out = target * SHIFT + added + SHIFT // 2
        return out

    def map_of(self, symbols: list[int], state: int = HOME) -> tuple[int, int]:
        """The map of a run of symbols at a state: the state after it, and the tokens added."""
        get, count = self.trans.get, 0
        for s in symbols:
            key = state * SYMBOLS + s
            to = get(key)
            if to is None:
                to = self.compile(key)
            state, count = to // SHIFT, count + to % SHIFT - SHIFT // 2
        return state, count

    def symbols_of(self, word: bytes) -> list[int]:
        return [*word[:-1], word[-1] + END]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of distinct words, which advance side by side."""
        if len(self.trans) > TRANSITIONS:
            self.forget()
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = np.zeros(len(words), dtype=np.int64)
        for k in np.flatnonzero(size > LONG_WORD):
            out[k] = self.map_of(self.symbols_of(words[k]))[1]
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= LONG_WORD]
        if not len(order):
            return out
        size = size[order]
        data = np.frombuffer(b"".join(words[k] for k in order), dtype=np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        data[begin + size - 1] += END
        state, count = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        get = self.trans.get
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))  # words of more than t symbols
            keys, which = np.unique(state[:n] * SYMBOLS + data[begin[:n] + t], return_inverse=True)
            to = np.fromiter((v if (v := get(k)) is not None else self.compile(k) for k in keys.tolist()), dtype=np.int64, count=len(keys))[which]
            state[:n] = to // SHIFT
            count[:n] += to % SHIFT - SHIFT // 2
        out[order] = count
        return out

    def cut(self, text: str) -> tuple[list[str], int]:
        """The words of a text, and how many special strings it has."""
        parts = self.special.split(text) if "<|" in text else [text]
        words: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")  # capital sigma, which lower() treats by its place
            words += self.words.findall(part.lower())
        return words, len(parts) - 1

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        names: dict[str, int] = {}
        number, each, extra = [], np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            words, extra[k] = self.cut(t or "")
            each[k + 1] = len(words)
            number.append(np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words)))
        done = np.concatenate([[0], np.cumsum(self.of_words([w.encode("utf-8", "surrogatepass") for w in names])[np.concatenate(number)] if names else [])])
        at = np.cumsum(each)
        return (done[at[1:]] - done[at[:-1]]).astype(np.int64) + extra

    def count(self, raw: bytes, chunk: int) -> int:
        """Tokens of one text, by the maps of chunks of so many symbols, composed."""
        words, total = self.cut(raw.decode("utf-8", "surrogatepass"))
        symbols = [s for w in words for s in self.symbols_of(w.encode("utf-8", "surrogatepass"))]
        state = HOME
        for at in range(0, len(symbols), chunk):
            state, more = self.map_of(symbols[at : at + chunk], state)
            total += more
        return total


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker and vocabulary file."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. path: the vocabulary file, on every machine."""

    def count(c: dict) -> dict:
        t, texts = transducer(path), [x or "" for x in c["text"].to_pylist()]
        n = [np.zeros(0, dtype=np.int64)]
        first = size = 0
        for k, x in enumerate(texts):  # some MB of texts at a time
            size += len(x)
            if size >= BATCH_CHARS or k == len(texts) - 1:
                n.append(t.counts(texts[first : k + 1]))
                first, size = k + 1, 0
        tokens = np.concatenate(n)
        return {"doc_id": c["doc_id"], "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "n_tokens": tokens, "over_limit": tokens > limit}

    return map_arrow(doc_text(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
