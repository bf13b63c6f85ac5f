"""Reply trees to training conversations.

Messages name their parent. Pointer doubling, a self-join a round, gives every message its depth and
the score of its path in log2(depth) rounds; the leaves of a tree are ranked by path score, and the
paths of the chosen leaves are enumerated by walking the same jump tables backwards, so no round ever
holds more than the messages or the rows of the chosen paths. Each path becomes one conversation text with a
loss mask. All steps are DataFrame operations on ids; texts join at the end.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` a turn. Inside role and text a backslash is doubled and
`<|` becomes `<\\|`, so control strings in a text are no control strings and come back exactly; a
line break inside a role is `<|nl|>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

START, END, ROLE_BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def linear_replies(conversations: DataFrame) -> DataFrame:
    """Conversations without branches as trees: each turn answers the one before it.

    Turns that tie are put in the order of role and text; repeated rows stay, one turn each.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree, node, up): 1, 2, 4, ... steps towards the root, and (tree, node, depth, total).

    A parent that is not in the table makes its child a root. Messages on a cycle reach no root and are
    left out of the second table.
    """
    shared_dir(nodes.sparkSession)
    ids = nodes.select("tree", "node", "parent", "score")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = ids.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total")
    )
    state, tables, step, size = state.checkpoint(), [], 1, None
    while not state.filter("up IS NOT NULL").isEmpty():
        tables.append(state.filter("up IS NOT NULL").select("tree", "node", "up"))
        size = size or state.count()
        if step > size:
            break
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        # only messages that are still on their way are joined
        moved = state.filter("up IS NOT NULL").join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        state = state.filter("up IS NULL").unionByName(moved).checkpoint()
        step *= 2
    return tables, state.filter("up IS NULL").select("tree", "node", "depth", "total")


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the best `branches` root-to-leaf paths of each tree.

    Ranked by the mean score of a path's messages, then by length (longer first), then by leaf.
    """
    tables, reached = jump_tables(nodes)
    parents = nodes.select("tree", F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    rank = Window.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), F.col("depth").desc(), "node")
    leaves = reached.join(parents, ["tree", "node"], "left_anti").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= branches)
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", "depth")
    for k in reversed(range(len(tables))):
        jump = tables[k].select("tree", "node", "up")
        both = F.array_compact(F.array(F.struct("node", F.lit(0).alias("back")), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), F.lit(1 << k).alias("back")))))
        walk = walk.join(jump, ["tree", "node"], "left").select("tree", "leaf", "depth", F.explode(both).alias("t")).select("tree", "leaf", F.col("t.node").alias("node"), (F.col("depth") - F.col("t.back")).alias("depth"))
    return walk


def formatted_conversations(messages: DataFrame, branches: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(tree, leaf, formatted, loss): loss holds code point spans [start, end) of the texts of `loss_role`.

    `messages`: tree, node, parent, role, text, score. Null role or text is empty. Every conversation is one
    row by nature; nothing else is gathered a tree.
    """
    turns = chosen_paths(messages, branches).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(ROLE_BREAK)), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    pieces = turns.select("tree", "leaf", "depth", "role", head.alias("head"), body.alias("body"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)) + F.length("head")
    rows = pieces.withColumn("start", start)
    masked = F.when(F.col("role") == loss_role, F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    grouped = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), masked.alias("span")))).alias("t"))
    return grouped.select("tree", "leaf", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.array_compact(F.transform("t", lambda x: x["span"])).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), read from a formatted conversation."""

    def turn(segment: Column) -> Column:
        head = F.substring_index(segment, "\n", 1)
        role = F.replace(F.substr(head, F.lit(len(START) + 1)), F.lit(ROLE_BREAK), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(segment, F.length(head) + 2)).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: s != ""), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """Formats every conversation and reads it back from the formatted text and its mask.

    Defined cases: null text or role is empty; a null conv_id is a conversation of its own; ties as in
    `linear_replies`; an empty table gives no row; other columns are not read.
    """
    # the conversation's id is read back from the tree's name
    out = formatted_conversations(linear_replies(conversations)).select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("said"))
    return out.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose two texts hold the template's own control strings."""
    spark = conversations.sparkSession
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
