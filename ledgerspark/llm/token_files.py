"""Token ids in ORC files: integer run-length encoding, stripes, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id (rows of equal doc_id stay together), sorted within each range, encoded
where they lie, and written as one ORC file for each range: a file is a run of ascending doc_id and so is the dataset.
A small index dataset beside it has each file's range, rows, ids and the number of ids before it, so that a reader can
go to a position in the token stream or to a document without opening other files; inside a file the stripes' statistics,
row indexes and Bloom filters prune. Files are ordered by their least doc_id, not by their names.

Defined results: a null text counts as empty and is the end id alone. Rows of equal doc_id (null first) are ordered by
their text, and each of repeated rows is written. An empty table gives files without rows. Of the input's columns only
doc_id and text are read.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, map_arrow

END, WORDS, PIECES, BATCH_CHARS, SCHEMA = 2, 400_000, 128, 4 << 20, "doc_id long, place long, n_tokens long, ids array<int>"
#: Bytes of text that a file should have at most, on the average.
FILE_BYTES = 64 << 20
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(8 << 20), "orc.dictionary.key.threshold": "0"}
#: Added strings of the tokenizer begin with this; texts with it go to the tokenizer whole.
SPECIAL = "<|"
#: What begins a text's first unit, and ends its last one if that is a line end.
EDGE = "\n\n"
SPACES = "".join(filter(str.isspace, map(chr, range(sys.maxunicode))))


def large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def units_of(texts: pa.LargeStringArray) -> pa.ListArray:
    """Texts' parts between spaces and before line ends. A part that begins with a line end stands for itself, one that
    begins with two for what follows them (the text's first) or for one at the text's end (if it is three), and every other
    one for itself after a space. No part has a space, or a line end elsewhere."""
    ends = pc.if_else(pc.ends_with(texts, "\n"), large(EDGE), large(""))
    return pc.split_pattern(pc.binary_join_element_wise(large(EDGE), pc.replace_substring(texts, "\n", " \n"), ends, large("")), " ")


class Encoder:
    """Ids of texts. The tokenizer cuts texts into pieces before it merges, and always before a space or a line end that
    stands between other characters. So a text's units are independent: Arrow cuts texts and finds the distinct units of a
    batch, each of these is encoded once while it is remembered, and numpy puts the ids in the units' places. They are those
    of the whole text. Units are told apart by their characters.

    New units are cut into pieces as one text, and PIECES of these go to the model at a time, with a letter between them
    that no text has and no token beside its own: nothing merges across it, and its ids are taken out again. A unit begins
    where a token does that begins with a space or a line end, as it has no other one."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = Tokenizer(self.tokenizer.model).encode_batch_fast  # the model alone: no cutting, no added tokens
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # The letter that stands for each byte, asked of the library: by bytes of whole characters, then by leading bytes.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters: dict[int, str] = {}
        for c in [*map(chr, range(0x800)), *(chr(k << 12 | 0x800) for k in range(16) if k != 13), "\ud7ff", *(chr(k << 18 | 0x10000) for k in range(4)), "\U00100000"]:
            self.letters.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
        vocab = self.tokenizer.get_vocab()
        used = set().union(*(t for t in vocab if len(t) > 1)) | set(self.letters.values())
        gap = min(c for c in ByteLevel.alphabet() if c in vocab and c not in used)
        self.gap = vocab[gap]
        self.letter_of = np.full(256, ord(gap), dtype="<u4")
        self.letter_of[list(self.letters)] = [ord(c) for c in self.letters.values()]
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[k for t, k in vocab.items() if t[:1] in (self.letters[32], self.letters[10])]] = True
        none = np.zeros(0, dtype=np.int32)
        self.remember(pa.array([], pa.large_string()), none, none, none.astype("<u4"), none)

    def remember(self, units: pa.LargeStringArray, at: np.ndarray, size: np.ndarray, pool: np.ndarray, uses: np.ndarray) -> None:
        """Remembered units: each one's place in the pool of ids, number of ids (-1: its texts are encoded whole) and uses."""
        self.units, self.at, self.size, self.pool, self.uses = units, at, size, pool, uses

    def forget(self) -> None:
        """Keeps the half of the units that were used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: WORDS // 2])
        n = np.maximum(self.size[keep], 0)
        at = (np.cumsum(n) - n).astype(np.int32)
        pool = self.pool[np.repeat(self.at[keep] - at, n) + np.arange(n.sum())]
        self.remember(self.units.take(pa.array(keep)), at, self.size[keep], pool, self.uses[keep] // 2)

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text by the whole tokenizer."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _merged(self, pieces: list[str]) -> np.ndarray:
        """The ids of pieces, one after the other."""
        out = [np.zeros(0, dtype="<u4")]
        for k in range(0, len(pieces), PIECES):  # the library's results are large, so they are not kept for more pieces
            letters = self.letter_of[np.frombuffer(b"\xff".join(map(str.encode, pieces[k : k + PIECES])), dtype=np.uint8)]
            out.append(np.array(self.merge([letters.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, dtype="<u4"))
        ids = np.concatenate(out)
        return ids[ids != self.gap]

    def _learn(self, new: pa.LargeStringArray) -> None:
        """Remembers more units. Those whose white space the tokenizer could join with their neighbours' have no ids."""
        core = pc.utf8_ltrim(new, "\n")
        empty, end = pc.equal(new, large(EDGE)), pc.equal(new, large(EDGE + "\n"))
        inner = pc.and_(pc.not_equal(core, large("")), pc.equal(core, pc.utf8_trim(core, SPACES)))
        has = pc.or_(inner, end)
        texts = pc.binary_join_element_wise(pc.if_else(pc.starts_with(new, "\n"), large("\n"), large(" ")), core, large("")).filter(has)
        ids = self._merged(self.pattern.findall("".join(texts.to_numpy(zero_copy_only=False))))
        starts = np.flatnonzero(self.opens[ids])
        # A text's first unit was encoded after a line end, whose id is left out.
        after = pc.and_not(pc.starts_with(new, EDGE), end).filter(has).to_numpy(zero_copy_only=False).astype(np.int32)
        has = has.to_numpy(zero_copy_only=False)
        at, size = np.zeros(len(new), dtype=np.int32), np.full(len(new), -1, dtype=np.int32)
        at[has] = len(self.pool) + starts + after
        size[has] = np.diff(starts, append=len(ids)) - after
        size[empty.to_numpy(zero_copy_only=False)] = 0
        uses = np.pad(self.uses, (0, len(new)))
        self.remember(pa.concat_arrays([self.units, new]), np.concatenate([self.at, at]), np.concatenate([self.size, size]), np.concatenate([self.pool, ids]), uses)

    def encode(self, texts: pa.Array | list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end` if there is one, and how many each text has."""
        if len(self.units) > WORDS:
            self.forget()
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        special = pc.fill_null(pc.match_substring(texts, SPECIAL), False).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((pc.fill_null(pc.binary_length(texts), 0).to_numpy() > 0) & ~special)
        units = units_of(texts.take(pa.array(cut)))
        distinct = units.values.dictionary_encode()
        found = pc.index_in(distinct.dictionary, self.units)
        new = distinct.dictionary.filter(found.is_null())
        known = pc.fill_null(found, -1).to_numpy().copy()
        known[known < 0] = len(self.units) + np.arange(len(new))
        if len(new):
            self._learn(new)
        number = known[distinct.indices.to_numpy()]
        self.uses = self.uses + np.bincount(number, minlength=len(self.uses))
        size, bounds = self.size[number], units.offsets.to_numpy()
        odd = np.searchsorted(bounds[1:], np.flatnonzero(size < 0), side="right")
        size = np.maximum(size, 0)
        done = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = self.pool[np.repeat((self.at[number] - done[:-1]).astype(np.int32), size) + np.arange(done[-1], dtype=np.int32)]
        ids = [np.zeros(0, dtype="<u4")] * len(texts)
        for k, a, b in zip(cut.tolist(), done[bounds[:-1]].tolist(), done[bounds[1:]].tolist(), strict=True):
            ids[k] = out[a:b]
        for k in [*np.flatnonzero(special).tolist(), *cut[np.unique(odd)].tolist()]:
            ids[k] = self.whole(texts[k].as_py())
        last = np.array([] if end is None else [end], dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) + len(last)
        return np.concatenate([np.zeros(0, dtype="<u4"), *(x for part in ids for x in (part, last))]), sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_ids(docs: DataFrame, path: str, end: int | None = END) -> DataFrame:
    """doc_id, place (in the partition, from 0), n_tokens and ids of every row, in the rows' order. path: the vocabulary file, on every machine."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            size = first = 0
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for k in range(batch.num_rows):  # some MB of text at a time, so that neither side holds more ids than theirs
                size += lengths[k]
                if size < BATCH_CHARS and k < batch.num_rows - 1:
                    continue
                part = batch.slice(first, k + 1 - first)
                flat, n = encoder(path).encode(part.column("text"), end)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(len(n)) + place), pa.array(n), ids], names=["doc_id", "place", "n_tokens", "ids"])
                place, first, size = place + len(n), k + 1, 0

    return doc_text(docs).mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str, end: int | None = END, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of docs to the folder out/ids, and the index to out/index."""
    spark = docs.sparkSession
    docs = doc_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes), min(spark.sparkContext.defaultParallelism * 4, size >> 22))
    ordered = docs.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    with_ids(ordered, path, end).write.options(**ORC).orc(f"{out}/ids")
    write_index(spark, out)


def write_index(spark: SparkSession, out: str) -> None:
    """file, n_docs, n_ids, min_doc, max_doc and before (ids of all files of smaller doc_ids) of each file of ids."""
    rows = read_rows(spark, out)
    per_file = rows.groupBy("file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))
    # One row a file, and files are some MB at least: this order over them is small beside the data.
    per_file.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy(F.col("min_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).coalesce(1).write.orc(f"{out}/index")


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the files, with the file's name; place is the row's number in it."""
    return spark.read.schema(SCHEMA).orc(f"{out}/ids").withColumn("file", F.col("_metadata.file_name"))


def digests(spark: SparkSession, out: str) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens and ids_crc32 of every row."""

    def crc(c: dict) -> dict:
        lists = c["ids"]
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        return {k: c[k] for k in ("file", "place", "doc_id")} | {"ids_crc32": [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], "n_read": np.diff(at).astype(np.int64)}

    rows = map_arrow(read_rows(spark, out).select("file", "place", "doc_id", "ids"), crc, "file string, place long, doc_id long, ids_crc32 long, n_read long")
    in_file = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    index = spark.read.schema("file string, n_docs long, n_ids long, min_doc long, max_doc long, before long").orc(f"{out}/index").select("file", "before")
    return rows.withColumn("in_file", F.coalesce(F.sum("n_read").over(in_file), F.lit(0))).join(index, "file").select("doc_id", (F.col("before") + F.col("in_file")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")


def lookup(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: files by the predicate on their statistics, row groups by row index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(f"{out}/ids").filter(F.col("doc_id").isin(doc_ids))
