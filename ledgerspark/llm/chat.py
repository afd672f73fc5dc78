"""Chat formatting of reply trees.

Paths from root to leaf are enumerated by iterative self-joins: after round k every node knows its ancestor 2^k replies
up, and the length and score of the way there, so a tree of depth d takes log2(d) rounds and rows of fixed size; nodes
that have reached their root take no further part. Leaves
are ranked within their tree by the mean score of their path; the chosen leaves' paths are unrolled over the same
pointers from the longest jump to the shortest, so no path is held twice. Each chosen path becomes one conversation.

A turn is written <s>role[INST]text</s>, where role and text have their ~, < and [ as ~0, ~1 and ~2: none of the three
marks can occur inside, and the reading back is exact. The loss mask is a list of spans of the formatted string, in
code points, that hold the assistant's (escaped) texts. Only DataFrame functions are used.

Defined results: a null text or role is empty; a null tree is a tree of its own; a node whose parent is null or missing
is a root; a null node is named by its content; rows that repeat a node count once (the smallest role and text); nodes
on a cycle belong to no path. An empty table gives no conversation. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored

#: The template's marks and the escapes, in the order in which they are put in (and taken out from the end).
START, SAYS, END, ESCAPES = "<s>", "[INST]", "</s>", [("~", "~0"), ("<", "~1"), ("[", "~2")]


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def chain(rows: DataFrame) -> DataFrame:
    """Nodes of plain conversations (conv_id, turn, role, text): each row replies to the row before it."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    rows = rows.select(F.col("conv_id").alias("tree"), "turn", role, text)
    n = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumn("n", n)
    name = lambda i: F.concat_ws(":", F.coalesce(F.col("tree").cast("string"), F.lit("null")), i.cast("string"))
    return rows.select("tree", name(F.col("n")).alias("node"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The rows of the chosen paths: tree, path (rank), at (1 for the root), role, text. nodes: tree, node (unique in
    the table), parent, role, text, score."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    named = F.coalesce(F.col("node").cast("string"), F.sha2(F.to_json(F.struct("tree", "parent", "role", "text", "score")), 256)).alias("node")
    nodes = nodes.select("tree", named, F.col("parent").cast("string").alias("parent"), role, text, F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    first = F.row_number().over(Window.partitionBy("node").orderBy("role", "text", F.col("parent").asc_nulls_first()))
    nodes = stored(nodes.withColumn("first", first).filter("first = 1").drop("first"), "chat-nodes")
    known = nodes.select(F.col("node").alias("up"))
    state = nodes.select("node", "parent", "score").join(known, F.col("parent") == F.col("up"), "left").select("node", "up", F.lit(1).alias("steps"), F.col("score").alias("total"))
    rounds = [stored(state, "chat-jump")]
    settled = rounds[0].filter("up is null")
    for _ in range(math.ceil(math.log2(nodes.count() + 2))):
        active = rounds[-1].filter("up is not null")  # nodes that have reached their root are done, and not joined again
        if active.isEmpty():
            break
        further = active.unionByName(settled).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("total").alias("plus"))
        step = active.join(further, "up").select("node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("plus")).alias("total"))
        rounds.append(stored(step, "chat-jump"))
        settled = settled.unionByName(rounds[-1].filter("up is null"))
    rooted = settled.select("node", "steps", "total")
    leaves = rooted.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti").join(nodes.select("tree", "node"), "node")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node"))
    marked = leaves.select("tree", "node", rank.alias("path")).filter(F.col("path") <= per_tree).select("node", "path")
    for jumps in reversed(rounds[:-1] or rounds):
        up = marked.join(jumps.filter("up is not null").select("node", "up"), "node").select(F.col("up").alias("node"), "path")
        marked = stored(marked.unionByName(up).distinct(), "chat-marked")  # read twice by the next round
    return marked.join(rooted.select("node", F.col("steps").alias("at")), "node").join(nodes, "node").select("tree", "path", "at", "role", "text")


def formatted(paths: DataFrame) -> DataFrame:
    """A row per path: tree, path, formatted, loss (array of first, last + 1)."""
    turn = F.struct("at", escape(F.col("role")).alias("role"), (F.col("role") == "assistant").alias("loss"), escape(F.col("text")).alias("text"))
    each = paths.groupBy("tree", "path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.expr(f"array_join(transform(turns, t -> concat('{START}', t.role, '{SAYS}', t.text, '{END}')), '')")
    # `at` moves over the turns; a turn's text begins after the two marks and the role.
    spans = F.expr(f"""aggregate(turns, named_struct('p', 0, 's', cast(array() as array<struct<first: int, last: int>>)), (a, t) -> named_struct(
        'p', a.p + length(t.role) + length(t.text) + {len(START + SAYS + END)},
        's', if(t.loss, concat(a.s, array(named_struct('first', a.p + length(t.role) + {len(START + SAYS)}, 'last', a.p + length(t.role) + length(t.text) + {len(START + SAYS)}))), a.s)), a -> a.s)""")
    return each.select("tree", "path", whole.alias("formatted"), spans.alias("loss"))


def write(nodes: DataFrame, out: str, per_tree: int = 1) -> None:
    """Formats the best paths of all trees and writes them as Parquet to the folder out."""
    formatted(best_paths(nodes, per_tree)).write.parquet(out)


def parse(written: DataFrame) -> DataFrame:
    """Adds turns (array of role, text), read from the formatted strings, and under_loss, the unescaped texts under the mask."""
    pieces = F.expr(f"filter(split(formatted, '{END}'), x -> x != '')")
    said = lambda x: F.split(F.substring(x, len(START) + 1, F.length(x)), r"\[INST\]", 2)
    turns = F.transform(pieces, lambda x: F.struct(unescape(said(x)[0]).alias("role"), unescape(said(x)[1]).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["first"] + 1, s["last"] - s["first"])))
    return written.withColumn("turns", turns).withColumn("under_loss", F.array_join(under, ""))


def digests(spark: SparkSession, out: str) -> DataFrame:
    """What the written conversations hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = parse(spark.read.schema("tree long, path int, formatted string, loss array<struct<first: int, last: int>>").parquet(out))
    all_turns = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), F.length("under_loss").cast("long").alias("loss_chars"), F.sha2(F.col("under_loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Writes conversations (conv_id, turn, role, text) in the template and returns what reading them back gives."""
    spark, out = rows.sparkSession, new_path(rows.sparkSession, "chat-formatted")
    write(chain(rows), out)
    return digests(spark, out)
