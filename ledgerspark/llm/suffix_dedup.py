"""Suffix-array dedup: removes every byte that lies in a LENGTH-byte string which also starts earlier.

1. Anchors. Every window of LENGTH bytes owns the least of its GRAM-byte hashes (the leftmost of equals). Equal windows
   own equal grams at equal places, so windows can repeat only where an anchor repeats. Neighbouring windows of one anchor
   are one segment; a text has about one for every 35 bytes.
2. Anchors are counted over the corpus (a partial count in each task first), and segments of anchors that occur once are
   gone. Segments of equal bytes (of one anchor, and of equal 64-bit XXH3 values) are one content, of which the first
   occurrence counts; all others repeat it whole.
3. Suffix arrays. Contents are dealt out by anchor, so that all windows that may be equal meet in one partition. There
   the suffixes of contents are sorted in two stages: those smaller than their successor directly, the rest induced by
   scans over the buckets of first bytes; then the common prefixes of neighbours are computed. A run of neighbours with
   common prefixes of LENGTH bytes or more is a repeated window, of which all but the earliest are marked.
4. Marks are gathered by document and cut from its bytes.

An anchor with very many different contents (HOT) is dealt out again by its windows. Equal windows are reduced to their
first occurrence by an aggregation, with partial results in each task, and the others are marked by a join back, which
Spark can split; so no partition grows with a common passage or its surroundings.

Defined results: strings are judged on the input, in ascending order of doc_id (null first). Rows of one doc_id and
different texts are documents in the order of a text hash; rows repeated whole are one document, and each gets its
result. A null or empty text, like any of fewer than LENGTH bytes, loses nothing. An empty table gives an empty table.
Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_text, fits, map_arrow, stored
from .hashing import mix64

LENGTH, GRAM = 100, 32
#: Bytes that are hashed at once; bytes of contents that are sorted at once; contents of one anchor from which it is hot;
#: document numbers that are broadcast at most, to keep texts without marks out of the shuffles.
PIECE, CHUNK, HOT, IDS = 1 << 20, 1 << 20, 5_000, 2_000_000
#: For the grams' rolling hash, of which equal values cost time but are told apart when contents are sorted.
_BASE, _BYTE = np.uint64(0x9E3779B97F4A7C15), np.random.default_rng(20_240_229).integers(0, 2**64, 256, dtype=np.uint64)


# Anchors and segments


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of documents that lie one after the other in data, up to `ends`: start (in data), windows, the anchor's
    hash and the content's hash."""
    width, n = LENGTH - GRAM + 1, len(data) - LENGTH + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none
    h, span, power = _BYTE[data], 1, _BASE
    while span < GRAM:
        h = h[:-span] * power + h[span:]
        power, span = power * power, span * 2
    gram = mix64(h)
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n], least[width - span : width - span + n])
    owner = (least & low).astype(np.int64)
    inside = np.ones(n, dtype=bool)
    for e in ends:  # windows that reach over a document's end
        inside[max(0, e - LENGTH + 1) : min(e, n)] = False
    new = np.ones(n, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    edge = np.flatnonzero(new | ~inside)
    stop = np.append(edge, n)[np.searchsorted(edge, start, side="right")]
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), (stop + LENGTH - 1).tolist(), strict=True)), dtype=np.uint64, count=len(start))
    return start, stop - start, gram[owner[start]].view(np.int64), content.view(np.int64)


def _pieces(pos: list[int], texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (parts of long ones, overlapping by a window) of about PIECE bytes: data, ends, pos and offset of each."""
    some: list[tuple[int, int, bytes]] = []
    size = 0

    def packed() -> tuple[np.ndarray, ...]:
        return np.frombuffer(b"".join(r for *_, r in some), dtype=np.uint8), np.cumsum([len(r) for *_, r in some]), np.array([p for p, *_ in some], dtype=np.int64), np.array([o for _, o, _ in some], dtype=np.int64)

    for p, t in zip(pos, texts, strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
            some.append((p, at, raw[at : at + PIECE + LENGTH - 1]))
            size += len(some[-1][2])
            if size >= PIECE:
                yield packed()
                some, size = [], 0
    if some:
        yield packed()


def _all_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, ends, pos, offset in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start, windows, key, content = segments(data, ends)
            of = np.searchsorted(ends, start, side="right")
            begins = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, content, pos[of], start - begins[of] + offset[of], windows.astype(np.int32))], names=["key", "content", "pos", "start", "windows"])


# Suffix sorting


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts as they do; zeros follow the data."""
    out = np.zeros(len(data), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(LENGTH + 16, dtype=np.uint8)]).astype(np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return np.concatenate([out, np.zeros(LENGTH + 16, dtype=np.uint64)])


def _sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first `depth` bytes, eight at a time, only tied places going on."""
    at = at[np.argsort(words[at], kind="stable")]
    tied, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    for d in range(0, depth, 8):
        key = words[at[tied] + d]
        if d:
            order = np.lexsort((key, group))
            at[tied], key = at[tied][order], key[order]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        more = ~new
        more[:-1] |= ~new[1:]
        tied, group = tied[more], group[more]
        if not len(tied):
            break
    return at


def two_stage_sort(data: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes at the wanted places (a mask) and at those needed to induce them, in the order of their first `depth` bytes."""
    n = len(data)
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)  # of runs of equal bytes
    ahead = np.minimum(ends + 1, n - 1)
    smaller = np.repeat((data[ahead] > data[ends]) | (ends == n - 1), np.diff(ends, prepend=-1))  # than its successor; also the last run
    # A suffix is induced from its successor, so the places up to the next directly sorted one are needed.
    direct = np.flatnonzero(smaller)
    last = np.flatnonzero(wanted)
    needed = np.zeros(n + 1, dtype=np.int32)
    needed[last] = 1
    needed -= np.bincount(direct[np.searchsorted(direct, last)] + 1, minlength=n + 1).astype(np.int32)
    needed = np.cumsum(needed[:n], dtype=np.int32) > 0
    first = _sort_directly(_words(data), np.flatnonzero(needed & smaller), depth)
    count = np.bincount(data[needed], minlength=256)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    own = np.searchsorted(data[first], np.arange(257))  # the buckets' parts of `first`, which is sorted by first byte too
    out = np.empty(count.sum(), dtype=np.int64)
    head = begin.copy()

    def induce(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        byte = data[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        runs = np.bincount(byte, minlength=256)
        out[np.repeat(head, runs) + np.arange(len(before)) - np.repeat(np.cumsum(runs) - runs, runs)] = before
        head[:] += runs

    for c in range(256):
        done = begin[c]
        while done < head[c]:  # what was induced into the bucket so far; it may induce more of the same bucket
            until = head[c]
            induce(out[done:until])
            done = until
        mine = first[own[c] : own[c + 1]]
        out[done : done + len(mine)] = mine
        induce(mine)
    return out


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes (up to `depth`) that each suffix in the order shares with the one before it."""
    out = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(1, len(order))
    for d in range(0, depth, 8):
        differ = words[order[open_] + d] ^ words[order[open_ - 1] + d]
        same = differ == 0
        out[open_[same]] = d + 8
        rest = open_[~same]
        x = differ[~same]
        lead = np.zeros(len(rest), dtype=np.int64)
        for b in range(1, 8):
            lead += (x >> np.uint64(64 - 8 * b)) == 0
        out[rest] = d + lead
        open_ = open_[same]
    return np.minimum(out, depth)


def repeated(contents: list[bytes], rank: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """For each content (of a document of that rank, from that byte) the numbers of its windows that start earlier too."""
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents) + b"\0", dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contents)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    wanted = np.zeros(len(data), dtype=bool)
    place = begin[owner] + number
    wanted[place] = True
    when = np.zeros(len(data), dtype=np.int64)
    when[place] = np.unique((rank[owner].astype(object) << 64) + start[owner] + number, return_inverse=True)[1] if start.max(initial=0) >= 1 << 40 else (rank[owner] << 40) + start[owner] + number
    order = two_stage_sort(data, wanted)
    order = order[wanted[order]]
    new = common_prefixes(_words(data), order) < LENGTH
    earliest = np.minimum.reduceat(when[order], np.flatnonzero(new)) if len(order) else when[:0]
    late = np.zeros(len(data), dtype=bool)
    late[order] = when[order] > earliest[np.cumsum(new) - 1]
    late = late[place]
    at = np.concatenate([[0], np.cumsum(windows)])
    return [np.flatnonzero(late[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _marks(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans that windows at these (ascending) starts cover."""
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + LENGTH).tolist(), strict=True)) if len(starts) else []


def _sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the contents of some anchors at a time (rows come in the order of the anchors) and yields spans: pos, first, last."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        pos = np.array([r[1] for r in rows], dtype=np.int64)
        start = np.array([r[2] for r in rows], dtype=np.int64)
        rank = np.unique(pos, return_inverse=True)[1]
        spans = [(p, a, b) for p, s, late in zip(pos.tolist(), start, repeated([r[3] for r in rows], rank, start), strict=True) for a, b in _marks(late + s)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in spans], pa.int64()) for k in range(3)], names=["pos", "first", "last"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if size >= CHUNK and r[0] != rows[-1][0]:
                yield work(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[3])
    if rows:
        yield work(rows)


# The operator


def numbered(docs: DataFrame) -> DataFrame:
    """pos (in the documents' order, without repeats), doc_id and text. Where doc_id has neither nulls nor repeats it is pos."""
    docs = doc_text(docs)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs.select(F.col("doc_id").alias("pos"), "doc_id", "text")
    hashed = docs.withColumn("h", F.xxhash64("text"))
    ids = hashed.select("doc_id", "h").distinct().sort(F.col("doc_id").asc_nulls_first(), "h").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1]))
    ids = stored(docs.sparkSession.createDataFrame(ids, "pos long, d long, g long"), "suffix-pos")
    return stored(hashed.join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("pos", "doc_id", "text"), "suffix-docs")


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose pos is among ids; without a shuffle of texts while the ids are few."""
    return docs.join(F.broadcast(ids) if fits(ids, IDS) else ids, "pos", how)


def _with_bytes(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """key, pos, start, bytes of contents: a document's contents are listed by its pos, then cut from its text."""
    wanted = contents.groupBy("pos").agg(F.collect_list(F.struct("key", "start", "windows")).alias("parts"))
    texts = _only(docs.select("pos", "text"), contents.select("pos").distinct())

    def cut(c: dict) -> dict:
        out: dict[str, list] = {"key": [], "pos": [], "start": [], "bytes": []}
        for p, t, parts in zip(c["pos"].to_pylist(), c["text"].to_pylist(), c["parts"].to_pylist(), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            for x in parts:
                out["key"].append(x["key"])
                out["pos"].append(p)
                out["start"].append(x["start"])
                out["bytes"].append(raw[x["start"] : x["start"] + x["windows"] + LENGTH - 1])
        return out

    return map_arrow(texts.join(wanted, "pos"), cut, "key long, pos long, start long, bytes binary")


def _by_window(contents: DataFrame) -> DataFrame:
    """Each window a content of its own, with its own hash as key."""

    def split(c: dict) -> dict:
        out: dict[str, list] = {"key": [], "pos": [], "start": [], "bytes": []}
        for p, s, raw in zip(c["pos"].to_pylist(), c["start"].to_pylist(), c["bytes"].to_pylist(), strict=True):
            for k in range(len(raw) - LENGTH + 1):
                w = raw[k : k + LENGTH]
                out["key"].append(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True))
                out["pos"].append(p)
                out["start"].append(s + k)
                out["bytes"].append(w)
        return out

    return map_arrow(contents, split, "key long, pos long, start long, bytes binary")


def _window_marks(windows: DataFrame) -> DataFrame:
    """Spans of the windows (as _by_window() gives them) whose bytes start earlier too."""
    windows = stored(windows, "suffix-windows", "zstd")
    first = windows.groupBy("key", "bytes").agg(F.min(F.struct("pos", "start")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    # Written first, as the anchors are, so that hot windows can be split.
    first = stored(first.select(F.col("key").alias("k"), F.col("bytes").alias("b"), F.col("f.pos").alias("p"), F.col("f.start").alias("s")), "suffix-windows", "zstd")
    again = windows.join(first, (F.col("key") == F.col("k")) & (F.col("bytes") == F.col("b"))).filter("pos <> p or start <> s")
    return again.select("pos", F.col("start").alias("first"), (F.col("start") + LENGTH).alias("last"))


def spans(docs: DataFrame) -> DataFrame:
    """Byte spans to remove: pos, first, last (they may overlap). docs: as numbered() gives them."""
    found = stored(docs.select("pos", "text").mapInArrow(_all_segments, "key long, content long, pos long, start long, windows int"), "suffix-segments", "zstd")
    # Written first, so that the join reads both sides straight from their shuffles, where hot keys can be split.
    again = stored(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k")), "suffix-anchors", "zstd")
    kept = stored(found.join(again, F.col("key") == F.col("k"), "left_semi"), "suffix-repeated", "zstd")
    discard(found)
    first = F.min(F.struct("pos", "start")).alias("f")
    contents = kept.groupBy("key", "content").agg(first, F.max("windows").alias("windows")).select("key", "content", "f.pos", "f.start", "windows")
    contents = stored(contents, "suffix-contents", "zstd")
    # Other occurrences of a content repeat it whole.
    where = contents.select(F.col("key").alias("k"), F.col("content").alias("c"), F.col("pos").alias("p"), F.col("start").alias("s"))
    later = kept.join(where, (F.col("key") == F.col("k")) & (F.col("content") == F.col("c"))).filter("pos <> p or start <> s")
    later = later.select("pos", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("last"))
    hot = contents.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(F.col("key").alias("h"))
    parts = stored(_with_bytes(docs, contents.select("key", "pos", "start", "windows")), "suffix-bytes", "zstd")
    plain = parts
    if not hot.isEmpty():
        plain = parts.join(hot, F.col("key") == F.col("h"), "left_anti")
        later = later.unionByName(_window_marks(_by_window(parts.join(hot, F.col("key") == F.col("h"), "left_semi"))))
    sort = plain.repartition("key").sortWithinPartitions("key")
    return later.unionByName(sort.mapInArrow(_sorted_parts, "pos long, first long, last long"))


def _cut(raw: bytes, marks: list[dict]) -> tuple[int, int, bytes]:
    """Bytes removed, removed runs, and what is left."""
    left, done, runs, end = [], 0, 0, -1
    for a, b in sorted((m["first"], m["last"]) for m in marks):
        if a > end:
            runs += 1
            left.append(raw[max(end, 0) : a])
            end = b
            done += b - a
        elif b > end:
            done += b - end
            end = b
    left.append(raw[max(end, 0) :])
    return done, runs, b"".join(left)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left) of every row."""
    docs = numbered(docs)
    marks = spans(docs).groupBy("pos").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    marks = stored(marks, "suffix-marks", "zstd")
    ids = marks.select("pos")

    def cut(c: dict) -> dict:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in c["text"].to_pylist()]
        done = [_cut(r, m or []) for r, m in zip(raws, c["marks"].to_pylist(), strict=True)]
        return {"doc_id": c["doc_id"], "n_bytes": [len(r) for r in raws], "n_removed": [d[0] for d in done], "n_spans": [d[1] for d in done], "kept": [d[2] for d in done]}

    marked = _only(docs, ids).join(marks, "pos").select("doc_id", "text", "marks")
    whole = _only(docs, ids, "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<first: bigint, last: bigint>>").alias("marks"))
    return map_arrow(marked.unionByName(whole), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """dedup(), with the hash of what is left in place of the bytes."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
