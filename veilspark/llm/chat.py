"""Chat formatting of reply trees, in DataFrame functions only.

Messages are nodes with a parent.  Root-to-leaf paths are found by self-joins that double the known distance each
time (a step joins the table of ancestors at distance d with itself), so a path of n turns takes log2(n) joins.  Along
the way each node gets its depth and the sum of scores on its path.  Leaves are ranked by that sum within
their tree, the best ``branches`` (or all) are kept, and the same tables, used from the longest distance down, list the nodes of each kept
path.  Each path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn.  Inside roles and texts a backslash becomes two and ``<|`` becomes
``<\\|``; in roles a line break becomes backslash and line break.  So no control string occurs inside a text, and dropping
each escaping backslash gives the text back.  The loss mask is the list of spans of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(spark: SparkSession, messages: DataFrame, branches: int | None = 1, scratch: Scratch | None = None) -> DataFrame:
    """``messages(tree, node, parent, score)`` to ``(tree, leaf, rank, node, depth)`` of the kept paths.

    ``branches`` paths of each tree are kept, or all of them if it is 0 or None.  (tree, node) must be unique.  A parent that isn't in its tree counts as none; nodes on a cycle are on no path.  Null scores
    count 0; equal sums rank by leaf.
    """
    scratch = scratch or Scratch(spark)
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    linked = nodes.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"))
    # state: nearest ancestor not yet summed, steps taken, sum of scores of the node and of the ancestors passed
    jumps: list[DataFrame] = []
    state = scratch.save(nodes.join(linked, ["tree", "node"], "left").select("tree", "node", "up", F.lit(1).alias("depth"), F.col("score").alias("sum")), "state")
    total = state.count()
    while 2 ** len(jumps) <= total:  # nodes still open after as many steps as there are nodes are on cycles
        open_nodes = state.where("up is not null")
        if open_nodes.isEmpty():
            break
        jumps.append(scratch.save(open_nodes.select("tree", "node", "up"), "jump"))
        ahead = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("sum").alias("s"))
        moved = open_nodes.join(ahead, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("sum") + F.col("s")).alias("sum"))
        state = scratch.save(state.where("up is null").union(moved), "state")
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = state.where("up is null").join(parents, ["tree", "node"], "left_anti")
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "node")))
    if branches:
        leaves = leaves.where(F.col("rank") <= branches)
    paths = scratch.save(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node"), "paths")
    for jump in reversed(jumps):
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"))
        paths = scratch.save(paths.union(further), "paths")
    return paths.join(state.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "rank", "node", "depth")


def format_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """``turns(*keys, ord, role, text)`` to ``(*keys, formatted)``: each group's turns in order as one text."""
    piece = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END), F.lit("\n"))
    grouped = turns.select(*keys, F.struct("ord", piece.alias("piece")).alias("t")).groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select(*keys, F.concat_ws("", F.expr("transform(ts, t -> t.piece)")).alias("formatted"))


def parse_turns(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, array<struct<role, text, start, end>>, read back from ``formatted``; start and end bound the escaped text."""
    pieces = F.slice(F.split("formatted", "<\\|im_start\\|>"), 2, 2147483647)
    out = formatted.withColumn("__pieces", pieces)
    head = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    out = out.withColumn("__starts", F.expr(f"aggregate(__pieces, struct(0 as at, cast(array() as array<int>) as starts), (acc, p) -> struct(acc.at + {len(START)} + length(p) as at, concat(acc.starts, array(acc.at + {len(START)})) as starts), acc -> acc.starts)"))
    turn = lambda p, at: F.struct(
        unescape(F.regexp_extract(p, head, 1)).alias("role"),
        unescape(F.substring(p, F.length(F.regexp_extract(p, head, 0)) + 1, F.length(p) - F.length(F.regexp_extract(p, head, 0)) - F.lit(len(END) + 1))).alias("text"),
        (at + F.length(F.regexp_extract(p, head, 0))).alias("start"),
        (at + F.length(p) - F.lit(len(END) + 1)).alias("end"),
    )
    return out.withColumn("turns", F.zip_with("__pieces", "__starts", turn)).drop("__pieces", "__starts")


def loss_spans(turns: str = "turns", role: str = "assistant") -> Column:
    """The loss mask: spans of the assistant's escaped texts in ``formatted``."""
    return F.expr(f"transform(filter({turns}, t -> t.role = '{role}'), t -> struct(t.start as start, t.end as end))")


def digest(parsed: DataFrame) -> DataFrame:
    """The contract's columns, from the formatted text and the turns and mask read back from it."""
    masked = parsed.withColumn("mask", loss_spans())
    under = F.concat_ws("", F.expr("transform(mask, s -> regexp_replace(substring(formatted, s.start + 1, s.end - s.start), '(?s)\\\\\\\\(.)', '$1'))"))
    every = F.concat_ws("", F.expr("transform(turns, t -> concat(t.role, '\\n', t.text, '\\n'))"))
    return masked.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted) for ``conversations(conv_id, turn, role, text)``: each is a tree without branches.

    Turns are in order of turn, then role, then text (nulls first); repeated rows are turns of their own.  Null roles and texts
    are empty; null conv_ids are one conversation.
    """
    scratch = Scratch(spark)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = scratch.save(rows.withColumn("tree", tree), "turns")
    paths = reply_paths(spark, rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score")), 1, scratch)
    turns = rows.join(paths.select("tree", "node", "rank", "depth"), ["tree", "node"]).withColumn("ord", F.col("depth"))
    return format_turns(turns, ["tree", "conv_id", "rank"]).select("conv_id", "formatted")
