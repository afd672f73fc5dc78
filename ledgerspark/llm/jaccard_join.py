"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Each text becomes its set of word 5-gram hashes; texts of one set are one node, with the number of rows that have it.
2. Forest: in each of TREES tries a node is a label of LABEL minima. Two nodes meet at a depth of a trie if their labels
   begin with the same so many minima. A trie's level is its labels in the order of their prefixes, so that nodes that meet
   lie together; a level is kept as a row per node with the prefix's hash, and the joins on it sort by that.
3. Shortening: a node's prefixes begin with the whole label and lose minima until a pair of the least similarity that this
   node can have with any other set (from the sizes that reach the threshold) meets in some trie with the target recall.
   There the node stops (at 0.8 it loses MORE minima): sets of 6 or 7 n-grams stop at longer prefixes than others, those of 3 and fewer match none but themselves.
   The levels in between add no pairs, as a run of a longer prefix lies inside one of a shorter prefix.
4. Cells: nodes that meet by whole labels are gathered (contracted components of a star of edges for each run) and cut into cells of about BLOCK nodes and GRAMS n-grams at most. Nodes gathered together
   are compared cell by cell; of other pairs of cells, those nodes that meet one of the other cell at the depth where they
   stop. The length decides between two costs: loosely similar texts (a site's template) that meet by short runs chain into
   one part, of which all pairs are compared; near copies that miss each other by long runs are joined one by one. With
   MORE minima (the next trie's, so they cost no hash) beyond the stop, a group of similarity s is gathered before its nodes have some 10 / s**MORE such meetings.
   Runs of over WIDE nodes are gathered too, so that a node has at most TREES * WIDE meetings outside its part.
5. Verification: a pair of cells is a unit, in which shared n-grams are counted by matrix products. Pairs inside gathered
   groups never become rows (a node alone that meets another alone is a unit of two rows):
   a unit returns a row per node, with the rows it is linked to and the smallest node of its connected part. Units are
   bounded in nodes and bytes, so hot groups are many units, dealt out over all tasks.
6. Components over these rows are the classes.

Defined results: texts without words (null, empty) have no links and are classes of their own row. Rows of equal word
sets are linked to each other. Texts of fewer than 5 words have one n-gram, all their words. A class is named by its
smallest doc_id; a row with null doc_id takes part, and a class with nothing else is named null. A very long text is one
set, of which a task holds some copies. Empty tables give empty tables. Of the input's columns only doc_id and text are
read; keep_one() keeps all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, doc_text, map_arrow, stored
from .hashing import mix64, shingles, words_of

N, THRESHOLD, TREES, LABEL, RECALL, BLOCK, GRAMS, MORE, WIDE = 5, 0.8, 64, 12, 0.999, 256, 1 << 20, 2, 32
_A = np.random.default_rng(7).integers(0, 2**32, TREES * (LABEL - MORE), dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(8).integers(0, 2**32, TREES * (LABEL - MORE), dtype=np.uint32)
#: A set's size from which on some other size allows almost any similarity.
MANY = 64


# The forest


def depth_for(similarity: float) -> int:
    """The longest prefix by which a pair of that similarity meets in some trie with the target recall; 1 if none does."""
    depth = LABEL
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < RECALL:
        depth -= 1
    return depth


def partners(size: int, threshold: float) -> Iterator[tuple[int, float]]:
    """Sizes of other sets that can reach the threshold with one of this size, and the least similarity they do it at."""
    for other in range(math.ceil(threshold * size - 1e-9), math.floor(size / threshold + 1e-9) + 1):
        shared = math.ceil(threshold * (size + other) / (1 + threshold) - 1e-9)
        if shared <= min(size, other) and (shared < size or other != size):
            yield other, shared / (size + other - shared)


@cache
def stop(size: int, threshold: float) -> int | None:
    """The depth at which a node of that size stops; None if no other set can reach the threshold."""
    if size >= MANY:
        return depth_for(threshold)
    return min((depth_for(s) for _, s in partners(size, threshold)), default=None)


@cache
def levels(size: int, threshold: float) -> tuple[int, ...]:
    """The depths at which a node has to be found: its own stop and those of the sizes that can be linked to it."""
    if size >= 2 * MANY:
        return (depth_for(threshold),)
    return tuple(sorted({d for s in [size, *(o for o, _ in partners(size, threshold))] if (d := stop(s, threshold))})) if stop(size, threshold) else ()


def labels(grams: np.ndarray) -> np.ndarray:
    """The node's label in each trie: the least values of its n-grams under so many hash functions, the last MORE of them
    those of the next trie."""
    out, short = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        out = np.minimum(out, (_A[:, None] * short[None, at : at + 256] + _B[:, None]).min(axis=1))
    own = out.reshape(TREES, LABEL - MORE)
    return np.hstack([own, np.roll(own, -1, axis=0)[:, :MORE]])


def prefixes(label: np.ndarray, depths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the labels' prefixes of these depths (and of trie and depth), a value for each trie."""
    h = mix64(np.arange(1, TREES + 1, dtype=np.uint64))
    at = []
    for d in range(LABEL):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + label[:, d])
        at.append(h.view(np.int64))
    return [at[d - 1] for d in depths]


def gathering(label: np.ndarray) -> np.ndarray:
    """Hashes of every second trie's whole label."""
    return prefixes(label, (LABEL,))[0][::2]


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    hashes, at = words_of(texts)
    return [np.unique(shingles(hashes[a:b], n)) for a, b in zip(at[:-1], at[1:], strict=True)]


def node_of(grams: np.ndarray) -> int:
    """A set's name: a 64-bit hash of its members."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def with_hash(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash, which tells rows of equal or null doc_id apart."""
    return doc_text(docs).withColumn("text_hash", F.xxhash64("text"))


def sketches(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, node (null without words), size, whole and short (gathering() and hashes of prefixes) of every row."""

    def sketch(c: dict) -> dict:
        out: dict[str, list] = {"node": [], "size": [], "whole": [], "short": []}
        for s in gram_sets(c["text"].to_pylist(), n):
            depths = levels(len(s), threshold) if len(s) else ()
            label = labels(s) if depths else None
            out["node"].append(node_of(s) if len(s) else None)
            out["size"].append(len(s))
            out["whole"].append(gathering(label) if depths else [])
            out["short"].append(np.concatenate(prefixes(label, depths)) if depths else [])
        return {"doc_id": c["doc_id"], "text_hash": c["text_hash"], **out, "node": pa.array(out["node"], pa.int64())}

    return map_arrow(with_hash(docs), sketch, "doc_id long, text_hash long, node long, size long, whole array<long>, short array<long>")


# Components


def _nearest(edges: DataFrame) -> DataFrame:
    """Edges a, b of the same components, of which each node but the smallest ones has one to its least neighbour of those
    below it: those neighbours are linked to each other, so a node with edges to many hubs keeps one."""
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = down.withColumn("r", F.min("b").over(Window.partitionBy("a")))
    return down.select(F.explode(F.array(F.struct("a", F.col("r").alias("b")), F.struct(F.col("b").alias("a"), F.col("r").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, part: the smallest node of each node's connected component. edges: a, b.

    Contraction: every round each node moves to the least of itself and its neighbours, and the edges between what is left
    are those of the next round, until there are none. The order is that of the nodes in one round, in which stars fall
    together at once, and a hash of node and round in the next, which leaves at most three quarters of any graph's nodes on
    average; so rounds grow with the logarithm of the nodes, whatever the length of chains. The greatest node of a component
    is always left behind, so the loop ends by itself. The moves are then followed from the last round back to the first."""
    edges, moves = stored(_nearest(edges), "jaccard-edges"), []
    while not edges.isEmpty():
        rank = F.xxhash64("b", F.lit(len(moves))) if len(moves) % 2 else F.col("b")
        both = edges.union(edges.select("b", "a")).union(edges.select("a", F.col("a").alias("b"))).union(edges.select("b", F.col("b").alias("a")))
        moves.append(stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank.alias("rank"), "b"))["b"].alias("part")), "jaccard-moves"))
        to = lambda c: moves[-1].select(F.col("node").alias(c), F.col("part").alias(f"{c}_to"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("a_to <> b_to")
        edges = stored(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct(), "jaccard-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("part"))
    labels = moves[-1]
    for move in reversed(moves[:-1]):
        further = labels.select(F.col("node").alias("part"), F.col("part").alias("further"))
        labels = stored(move.join(further, "part", "left").select("node", F.coalesce("further", "part").alias("part")), "jaccard-labels")
    least = labels.groupBy("part").agg(F.min("node").alias("least"))
    return labels.join(least, "part").select("node", F.col("least").alias("part"))


# Verification


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold: a boolean matrix with a false diagonal."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        flat = np.sort(np.concatenate(sets))
        common = np.full((2, 2), np.count_nonzero(flat[1:] == flat[:-1]))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.append(True, flat[1:] != flat[:-1])
        shared = ~new
        shared[:-1] |= ~new[1:]
        code, owner = np.cumsum(new[shared]) - 1, owner[shared]
        common = np.zeros((n, n), dtype=np.float32)
        step = max(1, (1 << 21) // n)
        for first in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            a, b = np.searchsorted(code, [first, first + step])
            m = np.zeros((n, min(step, int(code[-1]) + 1 - first)), dtype=np.float32)
            m[owner[a:b], code[a:b] - first] = 1
            common += m @ m.T
    out = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
    np.fill_diagonal(out, False)
    return out


def _parts(links: np.ndarray) -> np.ndarray:
    """The smallest row of each row's connected part."""
    part = np.arange(len(links))
    while True:
        near = np.minimum(part, np.where(links, part[None, :], len(links)).min(axis=1, initial=len(links)))
        near = np.minimum(near, near[near])
        if (near == part).all():
            return part
        part = near


def verify(unit: list[tuple], threshold: float) -> list[tuple]:
    """(node, first, links) of the linked nodes of a unit, whose rows are (second, node, rows, grams): a node is of the unit's
    first cell or of its second, and pairs are those between the two, or all if there is one cell."""
    unit = sorted({u[1]: u for u in unit}.values(), key=lambda u: u[1])
    if len(unit) < 2:
        return []
    links = linked([np.frombuffer(u[3], dtype=np.uint64) for u in unit], threshold)
    second = np.array([u[0] for u in unit])
    if second.any():
        links &= second[:, None] != second[None, :]
    part, count = _parts(links), links @ np.array([u[2] for u in unit])
    return [(unit[k][1], unit[part[k]][1], int(count[k])) for k in np.flatnonzero(links.any(axis=1))]


UNIT = ["part_a", "block_a", "part_b", "block_b"]


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """verify() of units, whose rows are dealt out by unit and lie together in each partition."""
    first = len(UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, name, found = [], None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["node", "first", "links"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for r in zip(*(some.column(k).to_pylist() for k in range(some.num_columns)), strict=True):
                    if r[:first] != name:
                        found += verify(unit, threshold)
                        unit, name = [], r[:first]
                    unit.append(r[first:])
                if len(found) > 10_000:
                    yield packed()
                    found = []
        found += verify(unit, threshold)
        yield packed()

    rows = rows.select(*UNIT, "second", "node", "rows", "grams").repartition(*UNIT).sortWithinPartitions(*UNIT)
    return rows.mapInArrow(run, "node long, first long, links long")


# The operator


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links (rows, this one aside, whose similarity reaches the threshold) of every row."""
    return _joined(stored(sketches(docs, n, threshold), "jaccard-sketches"), docs, n, threshold).select("doc_id", "class_id", "n_links")


def _met(rows: DataFrame, column: str) -> DataFrame:
    """key, node, size and hub (the key's smallest node) of all keys that several nodes have."""
    met = stored(rows.filter("node is not null").select("node", "size", F.explode(column).alias("key")).distinct(), "jaccard-keys", "zstd")
    hubs = met.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    out = stored(met.join(hubs, "key"), "jaccard-met", "zstd")
    discard(met)
    return out


def _units(rows: DataFrame, threshold: float) -> DataFrame:
    """Units (as UNIT) with their nodes and whether each is of the unit's second cell: all pairs of cells of one part, and of
    cells of different parts the nodes that meet one of the other cell where they stop, and of a size that one of those can
    be linked with. A node that is not gathered is a part of its own."""
    star = _met(rows, "whole").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    parts = stored(components(star), "jaccard-parts")
    short = _met(rows, "short").select("key", "node", "size").join(parts, "node", "left").select("key", "node", "size", F.coalesce("part", "node").alias("part"))
    short = stored(short, "jaccard-short", "zstd")
    wide = short.groupBy("key").agg(F.min("part").alias("hub"), F.max("part").alias("last"), F.count("*").alias("n")).filter((F.col("n") > WIDE) & (F.col("hub") < F.col("last")))
    into = components(short.join(wide.select("key", "hub"), "key").filter("part <> hub").select(F.col("part").alias("a"), F.col("hub").alias("b")).distinct())
    into = into.select(F.col("node").alias("part"), F.col("part").alias("into"))
    parts = short.select("node", "part").unionByName(parts).distinct().join(into, "part", "left").select("node", F.coalesce("into", "part").alias("part"))
    size = rows.filter("node is not null").groupBy("node").agg(F.max("size").alias("size"))
    parts = stored(parts.join(size, "node"), "jaccard-gathered")
    of_part = parts.groupBy("part").agg(F.count("*").alias("nodes"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / GRAMS)).cast("int").alias("blocks"))
    placed = parts.join(of_part, "part").select("node", "part", "nodes", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
    placed = stored(placed, "jaccard-cells")
    inside = placed.filter("nodes > 1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    inside = inside.select("node", F.col("part").alias("part_a"), F.least("block", "other").alias("block_a"), F.col("part").alias("part_b"), F.greatest("block", "other").alias("block_b"), (F.col("block") > F.col("other")).alias("second"))
    met = short.select("key", "node", "size").join(placed.select("node", "part", "block"), "node")
    mixed = met.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    met = stored(met.join(mixed, "key"), "jaccard-mixed")
    others = met.groupBy("key", F.col("part").alias("p"), F.col("block").alias("k")).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    fits = (F.col("size") >= F.lit(threshold) * F.col("least") - 1e-6) & (F.col("most") >= F.lit(threshold) * F.col("size") - 1e-6)
    second, mine, its = F.col("part") > F.col("p"), F.struct("part", "block"), F.struct(F.col("p").alias("part"), F.col("k").alias("block"))
    between = met.join(others, "key").filter((F.col("part") != F.col("p")) & fits).select("node", F.when(second, its).otherwise(mine).alias("a"), F.when(second, mine).otherwise(its).alias("b"), second.alias("second"))
    between = between.select("node", F.col("a.part").alias("part_a"), F.col("a.block").alias("block_a"), F.col("b.part").alias("part_b"), F.col("b.block").alias("block_b"), "second").distinct()
    return stored(inside.unionByName(between), "jaccard-units")


def _joined(rows: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """doc_id, text_hash, part (the class's smallest node; null without words), class_id and n_links of every row."""
    # Of the rows of a node, the one with the least doc_id (null first) and text hash gives the n-grams.
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("rows"), F.min(F.struct("doc_id", "text_hash")).alias("from"))
    nodes = stored(nodes, "jaccard-nodes")
    units = _units(rows, threshold)
    needed = units.select("node").distinct().join(nodes, "node").select("node", F.col("from.doc_id").alias("d"), F.col("from.text_hash").alias("t"))
    texts = with_hash(docs)
    if not rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "text_hash", "text"])

    def grams(c: dict) -> dict:
        sets = gram_sets(c["text"].to_pylist(), n)
        good = [k for k, (s, w) in enumerate(zip(sets, c["node"].to_pylist(), strict=True)) if node_of(s) == w]
        return {"node": c["node"].take(pa.array(good, pa.int64())), "grams": pa.array([sets[k].tobytes() for k in good], pa.binary())}

    with_text = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select("node", "text")
    sets = stored(map_arrow(with_text, grams, "node long, grams binary"), "jaccard-sets")
    found = stored(_verified(units.join(nodes.select("node", "rows"), "node").join(sets, "node"), threshold), "jaccard-links")
    discard(sets)
    classes = components(found.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(classes, "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = named.groupBy("part").agg(F.min("first_doc").alias("class_id"))
    named = named.join(least, "part").join(links, "node", "left").select("node", "part", "class_id", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "text_hash", "node").join(named, "node", "left").select("doc_id", "text_hash", "part", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, of the smallest doc_id of each class. Rows that share a doc_id are one document:
    they go only if none of them leads a class, and of rows repeated whole one stays. Rows without doc_id are judged each by
    its text: they go if their class has a doc_id, and of a class without any the text of the least hash stays."""
    rows = stored(sketches(docs, n, threshold), "jaccard-sketches")
    classes = stored(_joined(rows, docs, n, threshold), "jaccard-classes")
    gone = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("leads")).filter("not leads").select(F.col("doc_id").alias("__jaccard_doc"))
    unnamed = classes.filter("doc_id is null")
    if unnamed.isEmpty():
        kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("__jaccard_doc"), "left_anti")
    else:
        texts = unnamed.filter("part is not null").select("part", "class_id", "text_hash").distinct()
        least = texts.groupBy("part").agg(F.min("text_hash").alias("least"))
        texts = texts.join(least, "part").filter("class_id is not null or text_hash <> least").select(F.col("text_hash").alias("__jaccard_text"))
        has_id = F.col("doc_id").cast("long").isNotNull()
        kept = docs.filter(has_id).join(gone, F.col("doc_id").cast("long") == F.col("__jaccard_doc"), "left_anti")
        kept = kept.unionByName(docs.filter(~has_id).join(texts, F.xxhash64(F.col("text").cast("string")) == F.col("__jaccard_text"), "left_anti"))
    unique = rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return kept if unique else kept.dropDuplicates(["doc_id", "text"])
