"""Chat formatting: the best path through each reply tree as one conversation, in built-in functions only.

Paths come from self-joins that double their reach: after round k every leaf
knows its ancestors nearer than 2**k, so a thread of n turns takes log2(n)
rounds. Each round is written to the shared folder, which keeps plans short
and survives lost executors.

A turn stands as ``<s>[role]text</s>``. In roles and texts the characters
that controls are made of are escaped (& < [ ]), so no text can open or close
a turn, and unescaping gives back every character.

Cases: null roles and texts are empty; of rows with the same node the
smallest (parent, role, text) counts; a null conversation is one of its own,
and a null node a node without children; a parent that does not exist makes a
root; nodes on a cycle have no leaf and are left out; ties of branches go to
the smallest leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import materialize

#: What is escaped, in this order; unescaped in the opposite one.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")]


def escaped(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of (conv, node, parent): rows (conv, leaf, node, up), ``up`` counted from the leaf."""
    known = nodes.select("conv", F.col("node").alias("parent"))
    links = materialize(nodes.select("conv", "node", "parent").join(known, ["conv", "parent"], "left_semi").select("conv", "node", "parent"))
    inner = links.select("conv", F.col("parent").alias("node"))
    leaves = nodes.select("conv", "node").join(inner, ["conv", "node"], "left_anti")
    reach = materialize(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    step, most = 1, links.count()
    while step <= most and not links.isEmpty():
        above = reach.join(links, ["conv", "node"]).select("conv", "leaf", F.col("parent").alias("node"), (F.col("up") + step).alias("up"))
        reach = materialize(reach.unionByName(above))
        further = links.select("conv", F.col("node").alias("parent"), F.col("parent").alias("top"))
        links = materialize(links.join(further, ["conv", "parent"]).select("conv", "node", F.col("top").alias("parent")))
        step *= 2
    return reach


def best_paths(nodes: DataFrame) -> DataFrame:
    """The nodes (conv, node, up) of each conversation's path of the highest sum of scores."""
    all_paths = paths(nodes)
    scores = nodes.select("conv", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    sums = all_paths.join(scores, ["conv", "node"]).groupBy("conv", "leaf").agg(F.sum("score").alias("score"))
    chosen = sums.groupBy("conv").agg(F.min(F.struct((-F.col("score")).alias("s"), "leaf")).alias("best")).select("conv", F.col("best.leaf").alias("leaf"))
    return all_paths.join(chosen, ["conv", "leaf"]).select("conv", "node", "up")


def formatted(turns: Column) -> Column:
    """Turns (role, text) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<s>["), escaped(t["role"]), F.lit("]"), escaped(t["text"]), F.lit("</s>"))), "")


def loss_spans(turns: Column, role: str) -> Column:
    """Where the texts of a role stand in the formatted string: (start from 0, length), in code points."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        head = F.lit(5).cast("long") + F.char_length(escaped(t["role"]))
        size = F.char_length(escaped(t["text"])).cast("long")
        span = F.struct((acc["at"] + head).alias("start"), size.alias("len"))
        return F.struct(
            (acc["at"] + head + size + 4).alias("at"), F.when(t["role"] == role, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    return F.aggregate(turns, start, add)["spans"]


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv, node, parent, role, text, score) to one row per conversation: (conv, formatted, loss_spans).

    ``loss_spans`` is the loss mask: the ranges of the string that the texts
    of ``loss_role`` take.
    """
    nodes = (
        messages.groupBy("conv", "node")
        .agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")).alias("m"))
        .select("conv", "node", "m.parent", "m.role", "m.text", "m.score")
    )
    kind = nodes.schema["node"].dataType
    parent = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").cast(kind).alias("node")))
    # As structs, ids that are null are equal to each other.
    nodes = nodes.select(F.struct("conv").alias("conv"), F.struct("node").alias("node"), parent.alias("parent"), "role", "text", "score")
    nodes = materialize(nodes)
    rows = best_paths(nodes).join(nodes, ["conv", "node"])
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "role", "text"))).alias("turns"))
    return turns.select("conv.conv", formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns"), loss_role).alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """Turns (role, text) back from a formatted string."""
    parts = F.filter(F.split(text, "</s>"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substring(p, 5, 1 << 30), "]", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(role(p)).alias("role"), unescaped(p.substr(F.char_length(role(p)) + 6, F.char_length(p))).alias("text")
        ),
    )


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(text.substr(s["start"].cast("int") + 1, s["len"].cast("int")))), "")
