"""Reply trees as conversations, with DataFrame functions only.

Self-joins double the reach of every node's ancestor pointer, so a tree of depth d takes log d rounds; the same
pointers then lay out every root-to-leaf path. Branches are ranked by the mean score of their nodes, and each
chosen path is formatted as one conversation: a template marks the turns, control strings inside texts are
escaped reversibly, and spans tell which characters a loss covers.

Defined cases: a null text or role is empty; a node whose parent is missing is a root; equal scores go to the
lesser leaf; repeated rows are nodes of their own in `chains`; an empty table gives an empty one. Parents that
run in a circle raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.functions.numbering import number_rows
from levelgrid.session import settle

MOST_ROUNDS = 40

# The template's marks and the strings that other templates use for control.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>"]
LOSS_ROLE = "assistant"

_NO_TREE = -(1 << 63)


def escape(text: Column) -> Column:
    """A backslash is doubled, and one is put behind the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Pointers to the ancestors 1, 2, 4, ... steps up, each as (tree, node, up)."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    reach = settle(nodes.select("tree", "node", "parent").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up")))
    out = []
    while not reach.isEmpty():
        out.append(reach)
        if len(out) > MOST_ROUNDS:
            raise ValueError("parents run in a circle")
        further = reach.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"))
        reach = settle(reach.join(further, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")))
    return out


def paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of `nodes` (tree, node, parent) as rows tree, leaf, node, height (0 at the leaf)."""
    up = _ancestors(nodes)
    leaves = nodes.select("tree", "node")
    if up:
        leaves = leaves.join(up[0].select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    for k in range(len(up) - 1, -1, -1):
        higher = found.join(up[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + (1 << k)).alias("height"))
        found = settle(found.unionByName(higher))
    return found


def chosen(nodes: DataFrame, most: int = 1) -> DataFrame:
    """The rows of the `most` best-scored paths of every tree, with rank and the nodes' role and text."""
    laid = paths(nodes)
    rows = laid.join(nodes.select("tree", "node", "role", "text", "score"), ["tree", "node"])
    rows = settle(rows)
    scored = rows.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("path_score"))
    # Numbering goes upwards, so the score is negated; a tree with very many branches is numbered by ranges.
    ranked = number_rows(scored, ["tree"], [-F.col("path_score"), F.col("leaf")], "rank")
    return rows.join(ranked.filter(F.col("rank") <= most).select("tree", "leaf", "rank", "path_score"), ["tree", "leaf"])


def formatted(rows: DataFrame) -> DataFrame:
    """One conversation per chosen path: tree, rank, path_score, text, spans (begin, end) under the loss.

    A conversation is one row of the result, so its turns meet in one row; nothing larger does.
    """
    turns = F.array_sort(
        F.collect_list(F.struct((-F.col("height")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body")))
    )
    grouped = rows.groupBy("tree", "rank", "path_score").agg(turns.alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END + "\n"))), "")
    kind = "array<struct<begin:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(head(t))
        end = begin + F.length(t["body"])
        spans = F.concat(acc["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))
        kept = F.when(t["role"] == LOSS_ROLE, spans).otherwise(acc["spans"])
        return F.struct((end + len(END) + 1).alias("at"), kept.alias("spans"))

    spans = F.aggregate("turns", start, step, lambda acc: acc["spans"])
    return grouped.select("tree", "rank", "path_score", whole.alias("text"), spans.alias("spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """From text and spans alone: turns (role, text) and loss (the unescaped text under the spans), added as columns."""
    pieces = F.split("text", f"\\Q{END}\n\\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(START) + 1, F.length(piece))
        cut = F.instr(rest, F.lit("\n"))
        return F.struct(
            F.url_decode(F.substring(rest, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(rest, cut + 1, F.length(rest))).alias("text"),
        )

    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("text"), s["begin"] + 1, s["end"] - s["begin"]))), "")
    return conversations.withColumns({"turns": F.transform(pieces, turn), "loss": loss})


def chains(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as reply trees: every row answers the one before it."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_TREE)).alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    numbered = number_rows(rows, ["tree"], ["turn", "role", "text"], "node")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return settle(numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score")))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted conversations."""
    back = read_back(conversations)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != _NO_TREE, F.col("tree")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
