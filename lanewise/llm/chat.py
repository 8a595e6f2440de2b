"""Chat formatting: root-to-leaf paths of reply trees, the best branch as one conversation.

A message knows the message it answers. Iterative self-joins double every message's jump to its
ancestors, so that depth and branch score of all leaves take as many joins as the depth has binary digits; the chosen
leaf's path is read back through the same jumps. Template of a turn: ``### role: text</turn>`` and a newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut_lineage

#: The template's control strings, fixed values.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: Escapes of control strings in texts, applied in this order and undone in reverse; the backslash goes first.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, table=ESCAPES) -> Column:
    for plain, coded in table:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, table=ESCAPES) -> Column:
    for plain, coded in reversed(table):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def chosen_paths(messages: DataFrame) -> DataFrame:
    """``conv_id, node, depth`` of every message on the best root-to-leaf path of its conversation.

    ``messages``: ``conv_id, node, parent, score``; a conversation's nodes are distinct, a root's parent is null, an
    unknown parent makes a root. A branch's score is the mean of its messages' scores (null: 0); ties go to the longer branch,
    then to the smaller leaf. Conversations without a root (cycles) give nothing.
    """
    nodes = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    linked = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left")
    # up: the ancestor 2 ** level steps above, null beyond the root; seen, score: of the messages from here up to it, without it
    first = cut_lineage(linked.select("conv_id", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("seen"), "score"))
    depth, active = first.where("up is null"), first.where("up is not null")
    levels = [active.select("conv_id", "node", "up")]
    for _ in range(first.count().bit_length() + 1):  # more levels than that are a cycle, which never ends and is left out
        if active.isEmpty():
            break
        # only messages that have not met their root take part; their ancestors may have
        above = depth.unionByName(active).select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("seen").alias("seen2"), F.col("score").alias("score2"))
        jump = cut_lineage(
            active.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n"))).select(
                "conv_id", "node", F.col("up2").alias("up"), (F.col("seen") + F.col("seen2")).alias("seen"), (F.col("score") + F.col("score2")).alias("score")
            )
        )
        depth, active = depth.unionByName(jump.where("up is null")), jump.where("up is not null")
        levels.append(active.select("conv_id", "node", "up"))
    depth = depth.select("conv_id", "node", "seen", "score")
    parents = linked.where("n is not null").select(F.col("conv_id").alias("c"), F.col("n").alias("p")).distinct()
    leaves = depth.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    rank = F.struct((-F.col("score") / F.col("seen")).alias("s"), (-F.col("seen")).alias("d"), F.col("node").alias("n"))
    best = leaves.groupBy("conv_id").agg(F.min(rank).alias("r")).select("conv_id", F.col("r.n").alias("node"))
    path = cut_lineage(best)
    for level in reversed(levels[:-1]):  # every message of the path so far also names the one 2 ** level above
        hop = level.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        more = path.join(hop, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv_id", F.col("up").alias("node"))
        path = cut_lineage(path.unionByName(more))
    steps = depth.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("seen").alias("depth"))
    return path.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv_id", "node", "depth")


def format_paths(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation per row: ``conv_id, formatted, loss_spans``.

    ``messages``: ``conv_id, depth, role, text``, the messages of the path. ``loss_spans`` lists start and length, in code points of
    ``formatted``, of the escaped texts of the ``trained`` roles: what a training loss counts. Null role and text are empty.
    """
    turns = messages.select(
        "conv_id",
        F.struct("depth", F.concat(F.lit(HEAD), escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES), F.lit(COLON)).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("loss")).alias("turn"),
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = F.length(t["body"]).cast("long")
        start = acc["at"] + F.length(t["head"])
        span = F.struct(start.cast("long").alias("start"), body.alias("length"))
        return F.struct((start + body + len(END)).cast("long").alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return ordered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of the best path of every reply tree in ``conv_id, node, parent, score, role, text``."""
    path = chosen_paths(messages)
    texts = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    return format_paths(path.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv_id", "depth", "role", "text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text says: ``conv_id, turns`` (role and text, unescaped), ``loss_text``, and ``formatted``."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    colon = lambda p: F.instr(p, COLON)
    turn = lambda p: F.struct(unescape(F.substr(p, F.lit(len(HEAD) + 1), colon(p) - len(HEAD) - 1), ROLE_ESCAPES).alias("role"), unescape(F.substr(p, colon(p) + len(COLON))).alias("text"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), "formatted")


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree: each row answers the one before it, scores are 1.

    Order: turn, then role and text, nulls first; repeated rows stay, each a message of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
