"""Reply trees: best root-to-leaf path of each tree, formatted as one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

OPEN, CLOSE = "<|turn|>", "<|end|>"
MASKED_ROLE = "assistant"
#: Every backslash, ``<`` and ``[`` of a role or text is followed by a
#: backslash in the output.  No control string that starts with one of them
#: (``</s>``, ``[INST]``, ``<|turn|>``) can then stand inside a turn.
MARKED = r"([\\<\[])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKED + r"\\", "$1")


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``tree, leaf, rank, node, depth`` of the ``top`` best paths of each tree.

    ``nodes``: tree, node (unique in its tree), parent (null at a root), score.
    A path scores the sum of its nodes; ties go to the smaller leaf.  A node
    whose parent is missing is a root.  Nodes on a cycle have no root and are
    left out.

    Each round joins the table with itself and doubles the steps that a jump
    covers, so a tree of depth d takes log2(d) rounds.  The jumps of each round
    are kept, and the paths of the chosen leaves are read off them.
    """
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    start = nodes.join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    first = written(start.select(
        "tree", "node", F.col("_n").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.lit(1).cast("long").alias("steps"),
        F.col("_n").alias("parent")), "reply-jumps")
    # nodes on their way, one table per round, and all that have met their root
    jumps, done = [first.where("up is not null")], first.where("up is null")
    left, before = jumps[0].count(), None
    # a round that ends no node's way only circles
    while left and left != before:
        a, b = jumps[-1].alias("a"), jumps[-1].unionByName(done).alias("b")
        both = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
        moved = written(both.select(
            "a.tree", "a.node", "b.up", (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.steps") + F.col("b.steps")).alias("steps"), "a.parent"
        ), "reply-jumps")
        jumps, done = [*jumps, moved.where("up is not null")], done.unionByName(moved.where("up is null"))
        left, before = jumps[-1].count(), left
    parents = done.select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).where("_n is not null").distinct()
    leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    paths = written(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("steps").alias("depth")), "reply-paths")
    for jump in reversed(jumps[:-1]):
        p, j = paths.alias("p"), jump.alias("j")
        higher = p.join(j, F.col("p.tree").eqNullSafe(F.col("j.tree")) & (F.col("p.node") == F.col("j.node"))).select(
            "p.tree", "leaf", "rank", F.col("j.up").alias("node"), (F.col("depth") - F.col("j.steps")).alias("depth")
        )
        paths = written(paths.unionByName(higher), "reply-paths")
    return paths


def format_turns(turns: DataFrame, key: list[str]) -> DataFrame:
    """One row per ``key``: ``formatted`` text and ``loss_spans`` (start, length in code points, from 1).

    ``turns`` has ``key``, ``place``, ``role``, ``text``; nulls count as empty.
    A span covers the escaped text of one assistant turn, markers excluded.
    """
    role, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    piece = F.struct(
        "place", (F.coalesce(F.col("role"), F.lit("")) == MASKED_ROLE).alias("masked"),
        F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"),
    )
    gathered = turns.groupBy(*key).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    gathered = gathered.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), ""))
    sized = F.transform("pieces", lambda p: F.struct(
        p["masked"].alias("masked"), F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body")))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    end = len(CLOSE) + 1

    def step(state: Column, p: Column) -> Column:
        span = F.struct((state["at"] + p["head"]).alias("start"), p["body"].alias("length"))
        return F.struct(
            (state["at"] + p["head"] + p["body"] + end).alias("at"),
            F.when(p["masked"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.aggregate(sized, F.struct(F.lit(1).cast("long").alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return gathered.withColumn("loss_spans", spans).drop("pieces")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")
        return F.struct(
            unescaped(F.substring(part, F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substring(part, cut + 1, F.length(part) - cut - len(CLOSE) - 1)).alias("text"),
        )

    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask, spans joined with nothing between."""
    pieces = F.transform(spans, lambda s: F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(pieces, unescaped), "")


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``tree, leaf, rank, formatted, loss_spans`` of the ``top`` best paths of each tree.

    ``nodes``: tree, node, parent, score, role, text.  See ``best_paths`` and
    ``format_turns`` for ties, nulls and broken links; an empty table gives an
    empty result.
    """
    paths = best_paths(nodes.select("tree", "node", "parent", "score"), top).withColumnRenamed("depth", "place")
    texts = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    return format_turns(turns, ["tree", "leaf", "rank"])


def thread_nodes(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows of plain conversations as reply trees: each row answers the one before it.

    Rows with the same turn follow each other by role and text; rows equal in
    everything are turns of their own.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"), "role", "text")
    placed = named.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "role", "text")
