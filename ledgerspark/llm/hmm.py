"""LM scoring by a hidden Markov language model.

Tokens are words (A-Z lower-cased, cut at the six ASCII white spaces) and one end per text. Vocabulary counts are over
all training texts. Texts are tokenised once, in blocks of some MB with a dictionary of their own; counts and classes
come back to the blocks by a join of the dictionaries with the vocabulary, so no task holds the whole vocabulary.

Model: STATES latent states emit classes of words, and a class emits its words by their smoothed counts. The TOP most
frequent words are classes of their own; other known words fall into SUFFIXES classes by their last three bytes; unseen
words are one class. These bounds fix the size of the parameters (a few MB at most), whatever the corpus. Baum-Welch
counts (states' first, next and emitting counts) are summed over all training texts: within a task first, then across
partitions by class. The score of a text is its exact likelihood under the trained model, by the scaled forward
recursion.

A text of more than LONG tokens is trained in pieces of so many, each of which begins like a text; it is scored whole, by
segments whose transfer matrices (from each state before to each state after) are found side by side and then composed.

Words are told apart by 64-bit XXH3 hashes: with 10**8 different words the chance that any two count as one is below 0.001.

Defined results: a null text is empty and is the end token alone. A null doc_id counts as training. Repeated rows each
count and each get their score. Without training texts every token is unseen and scores 0. An empty table gives an empty
table. Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_text, stored
from .hashing import mix64, text_parts

STATES, TOP, SUFFIXES, ROUNDS, BLOCK_BYTES, BATCH, LONG, SEGMENT = 8, 8192, 4096, 4, 24 << 20, 1 << 19, 1 << 16, 1 << 10
UNSEEN, CLASSES = TOP + SUFFIXES, TOP + SUFFIXES + 1
#: The end token's name among the words' hashes; the strength of the emissions' prior (in tokens a state), and the share
#: of the base in them however many tokens a state has.
END, PRIOR, MIXED = 1, 200.0, 0.03
_TOKENS = [("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("local", pa.int32()), ("word", pa.int64()), ("suffix", pa.int32()), ("n", pa.int64())]


class Numbers(dict):
    """Numbers of words, in the order in which they were first seen; 0 is the end token."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def numbered(texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct words, the numbers of all tokens of the texts, and where each text's begin and end in them."""
    names, found, count = Numbers({None: 0}), [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
    for owners, raws in text_parts(texts):
        words: list[bytes] = []
        for k, raw in zip(owners, raws, strict=True):
            some = raw.split()
            count[k] += len(some)
            words += some
        found.append(np.fromiter(map(names.__getitem__, words), dtype=np.int32, count=len(words)))
    at = np.concatenate([[0], np.cumsum(count)])
    return list(names), np.insert(np.concatenate(found), at[1:], 0), at + np.arange(len(at))


def word_hash(word: bytes | None) -> int:
    return END if word is None else xxhash.xxh3_64_intdigest(word, 20_240_229)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a document with the block-local numbers (4 bytes each) of its tokens; of kind 1: a block's word."""
    from pyspark import TaskContext

    arrow = pa.schema(_TOKENS)
    block = TaskContext.get().partitionId() << 24
    for batch in batches:
        doc, held, texts = (batch.column(i).to_pylist() for i in range(3))
        first = size = 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size < BLOCK_BYTES and k < len(texts) - 1:
                continue
            some = slice(first, k + 1)
            names, number, at = numbered(texts[some])
            training = np.repeat(~np.array(held[some], dtype=bool), np.diff(at))
            n = np.bincount(number[training], minlength=len(names))
            docs, rows = k + 1 - first, len(names)
            null = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(docs, np.int32)), pa.array(np.full(docs, block)), pa.array(doc[some], pa.int64()), pa.array(held[some], pa.bool_()), pa.array([number[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), null(pa.int32(), docs), null(pa.int64(), docs), null(pa.int32(), docs), null(pa.int64(), docs)], schema=arrow)
            last = np.fromiter((int.from_bytes((w or b"")[-3:], "big") for w in names), dtype=np.uint64, count=rows)
            name = np.fromiter(map(word_hash, names), dtype=np.uint64, count=rows)
            suffix = (mix64(last) % np.uint64(SUFFIXES)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows, np.int32)), pa.array(np.full(rows, block)), null(pa.int64(), rows), null(pa.bool_(), rows), null(pa.binary(), rows), pa.array(np.arange(rows, dtype=np.int32)), pa.array(name.view(np.int64)), pa.array(suffix), pa.array(n)], schema=arrow)
            block, first, size = block + 1, k + 1, 0


@dataclass
class Corpus:
    """coded: doc_id, held_out, n_tokens, n_known, base_score, inner (log10 of the words' chances in their classes) and
    classes (2 bytes each) of every text; total: training tokens; base: each class's share of a token's chance."""

    coded: DataFrame
    total: int
    base: np.ndarray


def encode(docs: DataFrame) -> Corpus:
    """Counts the vocabulary and codes all texts by classes."""
    docs = doc_text(docs).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"), "text")
    tokens = stored(docs.mapInArrow(_blocks, "kind int, block long, doc_id long, held_out boolean, ids binary, local int, word long, suffix int, n long"), "hmm-tokens", "zstd")
    words = tokens.filter("kind = 1").select("block", "local", "word", "suffix", "n")
    counted = stored(words.groupBy("word").agg(F.sum("n").alias("c"), F.max("suffix").alias("suffix")), "hmm-words")
    total, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    top = counted.filter("c > 0").orderBy(F.desc("c"), "word").limit(TOP).select("word").toPandas()["word"]  # TOP rows at most
    spark = docs.sparkSession
    ranks = spark.createDataFrame([(int(w), k) for k, w in enumerate(top)], "word long, rank int")
    code = F.when(F.col("c") == 0, UNSEEN).otherwise(F.coalesce("rank", F.col("suffix") + TOP)).cast("int")
    vocabulary = counted.join(F.broadcast(ranks), "word", "left").select("word", "c", code.alias("class"))
    share = vocabulary.filter("c > 0").groupBy("class").agg(F.sum(F.col("c") + 0.5).alias("mass")).toPandas()  # CLASSES rows at most
    mass = np.zeros(CLASSES)
    mass[share["class"].to_numpy(dtype=int)] = share["mass"].to_numpy(dtype=float)
    mass[UNSEEN] = 0.5
    whole = total + 0.5 * (kinds + 1)
    log_mass = np.log10(np.where(mass > 0, mass, 1))

    def code_block(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        local = found["local"].to_numpy()
        c, kind = (np.zeros(len(local), t) for t in (float, np.int64))
        c[local], kind[local] = found["c"].to_numpy(), found["class"].to_numpy()
        plain = np.log10((c + 0.5) / whole)
        in_class = np.where(c > 0, np.log10(c + 0.5) - log_mass[kind], 0.0)
        raw = [x.as_py() for x in texts["ids"]]
        ids = np.frombuffer(b"".join(raw), dtype=np.int32)
        at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
        sums = lambda x: np.add.reduceat(x[ids], at[:-1])  # noqa: E731  each text has a token at least
        codes = kind[ids].astype("<u2").tobytes()
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": np.diff(at), "n_known": sums((c > 0).astype(np.int64)), "base_score": sums(plain), "inner": sums(in_class), "classes": pa.array([codes[2 * a : 2 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    known = words.join(vocabulary, "word").select(F.col("block").alias("of"), "local", "c", "class")
    texts = tokens.filter("kind = 0").select("block", "doc_id", "held_out", "ids")
    coded = texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(code_block, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary")
    coded = stored(coded, "hmm-coded", "zstd")
    discard(tokens, counted)
    return Corpus(coded, total, mass / whole)


@dataclass
class Model:
    """start[k], step[j, k] and emit[class, k]: chances of states first, after a state, and of classes in a state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_model(base: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """States that tend to stay, whose emissions are the base's with noise."""
    emit = base[:, None] * np.exp(np.random.default_rng(seed).normal(size=(len(base), states)))
    return Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))


class Packed:
    """Texts of one batch, the longest first, laid out by position: all first tokens, all second ones, ..."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.active = len(texts) - np.searchsorted(self.lengths[::-1], np.arange(self.lengths[0] + 1), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])[: self.lengths[0] + 1]
        text = np.repeat(np.arange(len(texts)), self.lengths)
        step = np.arange(len(text)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        place = self.at[step] + text
        self.symbols = np.empty(len(text), dtype=np.int64)
        self.symbols[place] = np.concatenate([texts[i] for i in self.order])
        self.text = np.empty(len(text), dtype=np.int64)
        self.text[place] = text

    def forward(self, m: Model, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward chances of the states at each token, and the scales, whose product is the likelihood."""
        alpha, scale = np.empty_like(likely), np.empty(len(likely), dtype=likely.dtype)
        step = m.step.astype(likely.dtype)
        for t in range(len(self.at) - 1):
            a, b = self.at[t], self.at[t + 1]
            now = (alpha[self.at[t - 1] : self.at[t - 1] + b - a] @ step if t else m.start.astype(likely.dtype)) * likely[a:b]
            s = now.sum(axis=1)
            scale[a:b] = s
            alpha[a:b] = now / s[:, None]
        return alpha, scale

    def backward(self, m: Model, likely: np.ndarray, scale: np.ndarray) -> np.ndarray:
        beta = np.ones_like(likely)
        back = m.step.T.astype(likely.dtype)
        ahead = likely / scale[:, None]
        for t in range(len(self.at) - 3, -1, -1):
            a, b, c = self.at[t], self.at[t + 1], self.at[t + 2]
            beta[a : a + c - b] = (beta[b:c] * ahead[b:c]) @ back
        return beta

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, of steps and of emitted classes; the texts' log likelihood."""
        likely = m.emit.astype(np.float32)[self.symbols]
        alpha, scale = self.forward(m, likely)
        beta = self.backward(m, likely, scale)
        seen = alpha * beta
        later = np.arange(self.at[1], len(likely))
        before = later - np.repeat(self.active[: len(self.at) - 2], self.active[1 : len(self.at) - 1])
        steps = m.step * (alpha[before].T.astype(float) @ (beta[later] * likely[later] / scale[later, None]).astype(float))
        emitted = np.stack([np.bincount(self.symbols, seen[:, k], len(m.emit)) for k in range(len(m.start))], 1)
        return seen[: self.at[1]].sum(axis=0, dtype=float), steps, emitted, float(np.log(scale.astype(float)).sum())

    def log_likelihoods(self, m: Model) -> np.ndarray:
        """Natural logarithm of each text's likelihood, in the texts' own order."""
        _, scale = self.forward(m, m.emit[self.symbols])
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.text, np.log(scale), len(self.order))
        return out


def long_log_likelihood(m: Model, symbols: np.ndarray, segment: int = SEGMENT) -> float:
    """Natural logarithm of a long text's likelihood. A segment's matrix holds, for each state before it, the chances of its
    tokens and of the state after it; after the first tokens' forward recursion the matrices are applied in order."""
    head = (len(symbols) - 1) % segment + 1
    now, log = m.start * m.emit[symbols[0]], 0.0
    for s in symbols[1:head]:
        log, now = log + np.log(now.sum()), now / now.sum()
        now = (now @ m.step) * m.emit[s]
    rest = symbols[head:].reshape(-1, segment)
    moves = np.broadcast_to(np.eye(len(m.start)), (len(rest), len(m.start), len(m.start)))
    scale = np.zeros(len(rest))
    for t in range(segment):
        moves = (moves @ m.step) * m.emit[rest[:, t]][:, None, :]
        s = moves.sum(axis=(1, 2))
        moves, scale = moves / s[:, None, None], scale + np.log(s)
    for move, s in zip(moves, scale, strict=True):
        log, now = log + np.log(now.sum()) + s, now / now.sum()
        now = now @ move
    return float(log + np.log(now.sum()))


def batched(texts: list[np.ndarray], tokens: int = BATCH) -> Iterator[list[int]]:
    """Numbers of the texts in batches of similar lengths and of about so many tokens."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    some: list[int] = []
    size = 0
    for i in order:
        some.append(i)
        size += len(texts[i])
        if size >= tokens:
            yield some
            some, size = [], 0
    if some:
        yield some


def emissions(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Chances of classes in each state: the counts' shares, mixed with the base's. Unseen words tell nothing about the
    state, and training has none of them: they keep the base's chance in every state."""
    known = base.copy()
    known[UNSEEN] = 0.0
    rest = known.sum()
    if not rest:
        return np.repeat(base[:, None], counts.shape[1], axis=1)
    shares = (counts + PRIOR * known[:, None] / rest) / (counts.sum(axis=0) + PRIOR)
    out = (1 - base[UNSEEN]) * ((1 - MIXED) * shares + MIXED * known[:, None] / rest)
    out[UNSEEN] = base[UNSEEN]
    return out


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u2") for x in column]


def baum_welch(corpus: Corpus, rounds: int = ROUNDS, states: int = STATES) -> tuple[Model, list[float]]:
    """Trains on all texts that are not held out; the log likelihood that each round's counts were taken at."""
    model, trace = first_model(corpus.base, states), []
    training = corpus.coded.filter("not held_out").select("classes")
    names = [f"s{k}" for k in range(states)]
    schema = "class int, " + ", ".join(f"{n} double" for n in names)

    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], m: Model = model) -> Iterator[pa.RecordBatch]:
            first, steps, emitted, log = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)), 0.0
            for batch in batches:
                texts = [t[at : at + LONG] for t in _texts(batch.column(0)) for at in range(0, len(t), LONG)]
                for some in batched(texts):
                    got = Packed([texts[i] for i in some]).expected(m)
                    first, steps, emitted, log = first + got[0], steps + got[1], emitted + got[2], log + got[3]
            used = np.flatnonzero(emitted.any(axis=1))
            # Classes, then as further rows the steps of each state, the first states and the log likelihood.
            table = np.concatenate([emitted[used], steps, first[None], np.full((1, states), log)])
            name = np.concatenate([used, CLASSES + np.arange(states + 2)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(name), *(pa.array(table[:, k]) for k in range(states))], names=["class", *names])

        summed = training.mapInArrow(count, schema).groupBy("class").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # CLASSES + states + 2 rows at most
        table = np.zeros((CLASSES + states + 2, states))
        table[summed["class"].to_numpy(dtype=int)] = summed[names].to_numpy()
        emitted, steps, first = table[:CLASSES], table[CLASSES : CLASSES + states], table[CLASSES + states]
        trace.append(float(table[-1, 0]))
        model = Model((first + 1) / (first + 1).sum(), (steps + 1) / (steps + 1).sum(axis=1, keepdims=True), emissions(emitted, corpus.base))
    return model, trace


def score(corpus: Corpus, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    kept = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, log = _texts(batch.column("classes")), np.zeros(batch.num_rows)
            for k, t in enumerate(texts):
                if len(t) > LONG:
                    log[k] = long_log_likelihood(model, t)
            short = [k for k, t in enumerate(texts) if len(t) <= LONG]
            for some in batched([texts[k] for k in short]):
                log[[short[i] for i in some]] = Packed([texts[short[i]] for i in some]).log_likelihoods(model)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(log / np.log(10) + batch.column("inner").to_numpy())], names=[*kept, "score"])

    scored = corpus.coded.mapInArrow(likelihood, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(corpus.total).cast("long"))


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    corpus = encode(docs)
    return score(corpus, baum_welch(corpus, rounds)[0])
