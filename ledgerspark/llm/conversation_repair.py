"""Conversation structure repair: the cheapest edits that make a conversation's roles follow the role grammar.

A generalised LR parser reads each conversation's rows. Its graph-structured stack has a node for each LR state and
parent; for every row, each live top tries to delete, keep or rerole it, and to insert a role, and equal tops merge to
the least (cost, audit). The live tops with their differences in cost and the order of their audits have few distinct
forms, so a form and a row's symbol are parsed once and looked up from then on (`Frontier`), whatever the length.

Rows are dealt out by ranges of (conv_id, turn, role, text) and numbered within them; a conversation that holds a third
of all rows lies in many ranges. Repeats are found by the least number of each (conversation, role, text). What comes
together for a conversation is two letters a row: its role's initial and its fault. Edits go back to the rows in chunks
of CHUNK rows (`repaired`), texts never pass through one task; only the digest of a whole conversation has to read its
texts in order (`digests`), as a stream.

Defined results: null roles and texts count as one space. Rows come by turn, nulls first, then role and text; an empty
conv_id is a conversation like another. A conversation without rows has nothing to repair (cost 0, empty audit). A role
other than s, u, a by its first letter can only be reroled or deleted. Texts are told apart by length and 128-bit MD5.
Gaps beyond 64 bits wrap. An empty table gives an empty table. Of the input's columns only the four named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Rules over role initials; B is a conversation so far, H its head. C is the start.
GRAMMAR = (("C", ""), ("C", "B"), ("B", "Bua"), ("B", "Hua"), ("H", ""), ("H", "s"))
#: Costs: of edits, of keeping a truncated row, and of what one live top can cost more than another and still win. (Any
#: top reaches B by at most two inserts, 6; from there it follows any other's edits, deleting a kept system row, 4.)
DELETE, REROLE, INSERT, TRUNCATED, SLACK = 4, 3, 3, 3, 10
#: Rows of a conversation whose edits go back together. A power of two.
CHUNK = 4096
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# The LR automaton


def lr_tables(grammar: tuple[tuple[str, str], ...]) -> tuple[list[dict[str, int]], list[list[int]]]:
    """For each state of the LR(0) automaton: where symbols lead, and the numbers of the rules that end there."""

    def closure(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            head = grammar[rule][1][dot : dot + 1]
            more = {(k, 0) for k, (left, _) in enumerate(grammar) if left == head} - items
            items |= more
            todo += more
        return frozenset(items)

    start = grammar[0][0]
    states = [closure({(k, 0) for k, (left, _) in enumerate(grammar) if left == start})]
    leads: list[dict[str, int]] = []
    for state in states:  # grows while it is read
        leads.append({})
        for symbol in sorted({grammar[r][1][d] for r, d in state if d < len(grammar[r][1])}):
            to = closure({(r, d + 1) for r, d in state if grammar[r][1][d : d + 1] == symbol})
            if to not in states:
                states.append(to)
            leads[-1][symbol] = states.index(to)
    return leads, [sorted(r for r, d in state if d == len(grammar[r][1])) for state in states]


LEADS, ENDS = lr_tables(GRAMMAR)
#: A node of the stack: its state and the node below it.
Node = tuple[int, "Node | None"]
BOTTOM: Node = (0, None)


@cache
def reductions(node: Node) -> frozenset[Node]:
    """The tops that a stack can have after any reductions, itself among them; not those that can go no further."""
    found, todo = {node}, [node]
    while todo:
        top = todo.pop()
        for rule in ENDS[top[0]]:
            left, right = GRAMMAR[rule]
            below = top
            for _ in right:
                below = below[1]
            if left in LEADS[below[0]] and (to := (LEADS[below[0]][left], below)) not in found:
                found.add(to)
                todo.append(to)
    return frozenset(n for n in found if LEADS[n[0]] or accepts(n))


def accepts(node: Node) -> bool:
    return any(GRAMMAR[rule][0] == GRAMMAR[0][0] for rule in ENDS[node[0]])


@cache
def shifts(node: Node, initial: str) -> frozenset[Node]:
    to = LEADS[node[0]].get(initial)
    return frozenset() if to is None else reductions((to, node))


class Frontier:
    """Live tops between two rows. A top's audit is known by its base, which ends with a row's edit, and the inserts
    after it: of different bases neither begins with the other, so their ranks order all that may follow."""

    def __init__(self) -> None:
        self.forms: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        #: The steps taken so far: next form, cost added, and for each of its tops the top before and the audit added.
        self.moves: list[tuple[int, int, list[tuple[int, str]]]] = []
        #: A form's best accepted top.
        self.best: dict[int, int] = {}
        self.first = self._close({node: (0, (0, ""), 0) for node in reductions(BOTTOM)})

    def _close(self, tops: dict[Node, tuple[int, tuple[int, str], int]]) -> int:
        """Adds what inserts reach, normalises, and returns the step's number. tops: cost, (rank of base, audit after it), top before."""
        todo = list(tops)
        while todo:
            node = todo.pop()
            cost, (rank, audit), before = tops[node]
            for initial in "ua":
                for to in shifts(node, initial):
                    new = (cost + INSERT, (rank, audit + "I"), before)
                    if to not in tops or new < tops[to]:
                        tops[to] = new
                        todo.append(to)
        least = min(c for c, _, _ in tops.values())
        live = sorted((n, v) for n, v in tops.items() if v[0] <= least + SLACK)
        base = [(rank, audit.rstrip("I")) for _, (_, (rank, audit), _) in live]
        ranks = {b: k for k, b in enumerate(sorted(set(base)))}
        form = tuple((n, v[0] - least, ranks[b], len(v[1][1]) - len(b[1])) for (n, v), b in zip(live, base, strict=True))
        if form not in self.numbers:
            self.numbers[form] = len(self.forms)
            self.forms.append(form)
        self.moves.append((self.numbers[form], least, [(v[2], v[1][1]) for _, v in live]))
        return len(self.moves) - 1

    def step(self, number: int, symbol: str) -> int:
        """What a row does to a form. Symbol: the initial in lower case, in upper case if truncated, x if it must go."""
        form, tops = self.forms[number], {}
        initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        for k, (node, cost, rank, inserts) in enumerate(form):
            at = "I" * inserts
            edits = [((node,), DELETE, "D")]
            if symbol != "x":
                edits += [(shifts(node, initial), extra, "K")] + [(shifts(node, i), REROLE + extra, "R") for i in "ua" if i != initial]
            for to, price, letter in edits:
                for n in to:
                    new = (cost + price, (rank, at + letter), k)
                    if n not in tops or new < tops[n]:
                        tops[n] = new
        out = self.steps[number, symbol] = self._close(tops)
        return out

    def parse(self, symbols: str) -> tuple[int, str]:
        """The least (cost, audit)."""
        form, cost, _ = self.moves[self.first]
        taken, steps, moves = np.zeros(len(symbols), np.int32), self.steps, self.moves
        for i, s in enumerate(symbols):
            k = steps.get((form, s))
            if k is None:
                k = self.step(form, s)
            taken[i] = k
            form, more, _ = moves[k]
            cost += more
        if form not in self.best:
            self.best[form] = min((c, r, i, at) for at, (n, c, r, i) in enumerate(self.forms[form]) if accepts(n))[3]
        top = self.best[form]
        cost += self.forms[form][top][1]
        # An audit added begins with the inserts that its top before already had: those are taken off again.
        parts: list[str] = []
        for k in reversed([self.first, *taken.tolist()]):
            before, added = moves[k][2][top]
            parts.append(added)
            top = before
        parts.reverse()
        out = [parts[0]]
        for a, b in zip(parts, parts[1:], strict=False):
            out.append(b[len(a) - len(a.rstrip("I")) :])
        return cost, "".join(out)


_frontier: Frontier | None = None


def cheapest(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of rows given as symbols (see `Frontier.step`), the ASCII-least of equals."""
    global _frontier
    if _frontier is None:
        _frontier = Frontier()
    return _frontier.parse(symbols)


# Rows and their faults


def key(c: str = "conv_id") -> F.Column:
    """A conversation's key: no null, so that joins find it."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (no nulls in those two), key and pos, ascending by conversation and turn; stored."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(out.select("*", key().alias("key"), F.monotonically_increasing_id().alias("pos")), "conversation-rows")


def faults(rows: DataFrame) -> DataFrame:
    """key, conv_id, turn, pos, initial (s, u, a; o for others) and fault (b blank, d duplicate, t truncated, - none)."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.left("role", F.lit(1))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    plain = rows.select("key", "conv_id", "turn", "pos", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise("-").alias("own"), same.alias("same"), F.octet_length("text").alias("size"))
    # Joined by pos, which is unique: a text that a third of all rows repeat is one row of the right side.
    first = plain.groupBy("key", "same", "size").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    out = plain.join(first, "pos", "left")
    fault = F.when(F.col("own") == "b", "b").when(F.col("first").isNull(), "d").otherwise(F.col("own"))
    return out.select("key", "conv_id", "turn", "pos", "initial", fault.alias("fault"))


def _chunks(rows: DataFrame) -> DataFrame:
    """A row per CHUNK numbers of a conversation: its initials and faults as letters, and what its turns are."""
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", "initial", "fault", "turn")))
    one = rows.groupBy("key", "conv_id", F.shiftright("pos", CHUNK.bit_length() - 1).alias("chunk")).agg(sorted_.alias("r"))
    letters = lambda c: F.array_join(F.col("r")[c], "")
    turns = F.filter(F.col("r")["turn"], lambda t: t.isNotNull())
    return one.select("key", "conv_id", "chunk", letters("initial").alias("initials"), letters("fault").alias("faults"), F.get(turns, F.lit(0)).alias("low"), F.element_at(F.when(F.size(turns) > 0, turns), -1).alias("high"), F.size(F.array_distinct(turns)).alias("turns"))


PLAN = "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, chunks array<struct<chunk:long,edits:string,place:long>>"


def _plan_one(chunks: list[dict]) -> dict:
    initials, fault = "".join(c["initials"] for c in chunks), "".join(c["faults"] for c in chunks)
    symbols = "".join("x" if f in "bd" else r.upper() if f == "t" else r for r, f in zip(initials, fault, strict=True))
    cost, audit = cheapest(symbols)
    dated = [c for c in chunks if c["low"] is not None]
    gaps = 0
    if dated:
        distinct = sum(c["turns"] for c in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
        gaps = (dated[-1]["high"] - dated[0]["low"] + 1 - distinct + (1 << 63)) % (1 << 64) - (1 << 63)
    # Places of the output: the first user row has 0, a system row before it -1; even places are users.
    place = -((len(audit) - audit.count("D")) % 2)
    parts, at = [], 0
    for n, c in enumerate(chunks):
        begin, left = at, len(c["initials"])
        while left:
            left -= audit[at] != "I"
            at += 1
        at = len(audit) if n == len(chunks) - 1 else at
        parts.append({"chunk": c["chunk"], "edits": audit[begin:at], "place": place})
        place += at - begin - audit.count("D", begin, at)
    illegal = len(initials) - 1 - sum(initials[k : k + 2] in ("su", "ua", "au") for k in range(len(initials) - 1))
    return {"gaps": gaps, "blank": fault.count("b"), "duplicate": fault.count("d"), "truncated": fault.count("t"), "illegal": illegal, "cost": cost, "audit": audit, "chunks": parts}


def plans(rows: DataFrame) -> DataFrame:
    """A row per conversation of `numbered` rows: COUNTS, audit, and each chunk's edits with the place of its first output."""
    fields = ["chunk", "initials", "faults", "low", "high", "turns"]
    whole = _chunks(faults(rows)).groupBy("key", "conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))

    def plan(columns: dict) -> dict:
        found = [_plan_one(c) for c in columns["c"].to_pylist()]
        return {"key": columns["key"], "conv_id": columns["conv_id"]} | {n: [f[n] for f in found] for n in (*COUNTS, "audit", "chunks")}

    return map_arrow(whole, plan, PLAN)


# Edits applied


def _stream(rows: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """Rows and their chunks' edits, dealt out by columns among key and chunk; a chunk's edits come before its rows."""
    chunk = F.shiftright("pos", CHUNK.bit_length() - 1)
    each = plan.select("key", "conv_id", F.explode("chunks").alias("c")).select("key", "conv_id", "c.chunk", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("c.edits").alias("text"), "c.place")
    both = each.unionByName(rows.select("key", "conv_id", chunk.alias("chunk"), "pos", "role", "text", F.lit(0).cast("long").alias("place")))
    return both.repartition(*by).sortWithinPartitions("key", "chunk", "pos")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, int, str, str] | None]:
    """Places, roles and texts of the repaired rows of a `_stream`, with key and conv_id; every conversation's chunk also gives a row
    of place None at its begin."""
    edits, at, place, who = "", 0, 0, ("", None)
    name = lambda: "assistant" if place % 2 else "user"
    for batch in batches:
        for k, conv, pos, role, text, first in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "pos", "role", "text", "place")), strict=True):
            if pos < 0:
                for _ in edits[at:]:
                    yield *who, place, name(), ""
                    place += 1
                edits, at, place, who = text, 0, first, (k, conv)
                yield k, conv, None, "", ""
                continue
            while edits[at] == "I":
                yield *who, place, name(), ""
                place, at = place + 1, at + 1
            if edits[at] != "D":
                yield *who, place, role if edits[at] == "K" else name(), text
                place += 1
            at += 1
    for _ in edits[at:]:
        yield *who, place, name(), ""
        place += 1


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations; places count from 0 at the first user, -1 is a system row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["conv_id", "place", "role", "text"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
        for r in _edited(batches):
            if r[2] is not None:
                out.append(r[1:])
            if len(out) == CHUNK:
                yield make()
                out.clear()
        yield make()

    return _stream(rows, plan, ["key", "chunk"]).mapInArrow(run, "conv_id long, place long, role string, text string")


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """key and the SHA-256 of each repaired conversation's `role:text`, joined by line ends; read as a stream, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, any_, keys, out = None, None, False, [], []
        for k, _, place, role, text in _edited(batches):
            if k != now or sha is None:
                if sha is not None:
                    keys.append(now)
                    out.append(sha.hexdigest())
                now, sha, any_ = k, hashlib.sha256(), False
            if place is not None:
                sha.update((("\n" if any_ else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                any_ = True
        if sha is not None:
            keys.append(now)
            out.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], ["key", "repaired_sha256"])

    return _stream(rows, plan, ["key"]).mapInArrow(run, "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conv_id and turn: some dropped, emptied, without sentence ends, repeated, or
    given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    out = out.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, COUNTS, audit and repaired_sha256 for every conversation of the first table, its rows being in the second."""
    rows = numbered(rows)
    plan = stored(plans(rows), "conversation-plans")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", key())
    out = every.join(plan.drop("conv_id"), "key", "left").join(digests(rows, plan), "key", "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
