r"""Chat formatting of reply trees, in DataFrame operations only.

Root-to-leaf paths are enumerated by iterative self-joins that double their reach: round k knows each message's 2^k-th
ancestor, and the sum of scores and the number of messages up to there, so a thread of n messages takes log2(n) rounds. The
leaves of a tree are ranked by the summed score of their paths, ties by the smaller leaf id; the paths of the best
`branches` leaves are formatted, each as one conversation.

A turn is ``### role:\n`` text ``\n</turn>\n``. A backslash goes before each ``###`` and ``</turn>`` inside a text, and taking
one away from before each gives the text back; backslashes elsewhere stay. In roles, backslash and LF become ``\b`` and ``\n``.
So ``\n</turn>\n`` only ever ends a turn, and the first LF of a turn ends its role.

Defined cases: a null role or text is empty; a null score is 0; a parent that is missing makes a root; messages on a cycle have no root
and lie on no path; a null tree id is a tree of its own; repeated rows stay (reply_tree() numbers them); no rows give no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm.common import read, stored

END = "\n</turn>\n"
CONTROL = "(###|</turn>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\{CONTROL}", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def reply_tree(turns: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A table of turns as trees without branches: each turn answers the one before it. Ties in turn go by role, then text."""
    order = Window.partitionBy(tree).orderBy(turn, "role", "text")
    return turns.select(tree, "role", "text", F.row_number().over(order).cast("long").alias("node_id")).withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))


def ranked_paths(messages: DataFrame, branches: int = 1) -> tuple[DataFrame, DataFrame]:
    """tree, leaf, branch_rank, path_score of the best leaves of each tree, and tree, leaf, node, depth of each message on their
    paths. messages: tree (string, not null), node, parent (long), score (double)."""
    here = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    state = messages.join(here, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("long").alias("depth"))
    jumps, open_before = [], -1
    for k in itertools.count():
        state = stored(state, f"jump{k}")
        still_open = state.where("up is not null").count()
        if not still_open or still_open == open_before:  # a round that closes none shows that the rest lies on cycles or leads to them
            break
        open_before = still_open
        jumps.append(state.where("up is not null").select("tree", "node", "up"))
        further = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        moved = state.where("up is not null").join(further, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))
        state = state.where("up is null").unionByName(moved)
    state = state.where("up is null")  # what is left lies on a cycle or leads to one
    parents = messages.where("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = state.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= branches).select("tree", F.col("node").alias("leaf"), "branch_rank", F.col("score").alias("path_score"))
    chosen = stored(chosen, "leaves")
    path = chosen.select("tree", "leaf", F.col("leaf").alias("node"))
    for jump in reversed(jumps):  # the longest first: then the rows of a round are half of those of the next
        path = path.join(jump, ["tree", "node"], "left").select("tree", "leaf", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    return chosen, path.join(state.select("tree", "node", "depth"), ["tree", "node"])


def format_chats(messages: DataFrame, tree: str = "conv_id", branches: int = 1) -> DataFrame:
    """A row for each chosen path: the tree's id, leaf_id, branch_rank, path_score, formatted (string), and loss_mask: an array of (turn,
    start, length), where start counts from the start of that turn, for the assistant's texts. messages: the tree's id, node_id, parent_id, score, role, text."""
    key = F.coalesce(F.concat(F.lit("v"), F.col(tree).cast("string")), F.lit("n"))
    rows = stored(
        messages.select(key.alias("tree"), F.col(tree).alias("id"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.col("score").cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")),
        "messages",
    )
    chosen, paths = ranked_paths(rows.select("tree", "node", "parent", "score"), branches)
    turn = F.struct("depth", F.concat(F.lit("### "), escaped_role(F.col("role")), F.lit(":\n")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learnt"))
    chats = paths.join(rows.select("tree", "id", "node", "role", "text"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return chats.join(chosen, ["tree", "leaf"]).select(
        F.col("id").alias(tree),
        F.col("leaf").alias("leaf_id"),
        "branch_rank",
        "path_score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.filter(
            F.transform("turns", lambda t, i: F.struct(F.when(t["learnt"], i).alias("turn"), F.length(t["head"]).alias("start"), F.length(t["body"]).alias("length"))), lambda m: m["turn"].isNotNull()
        ).alias("loss_mask"),
    )


def read_back(chats: DataFrame, tree: str = "conv_id") -> DataFrame:
    """The tree's id, turns (array of role and text), loss_text and formatted_chars, from nothing but formatted and loss_mask."""
    blocks = F.split("formatted", END)
    cut = chats.select(tree, "formatted", "loss_mask", F.slice(blocks, 1, F.size(blocks) - 1).alias("blocks"))

    def turn(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        return F.struct(unescaped_role(head.substr(F.lit(5), F.length(head) - 5)).alias("role"), unescaped(block.substr(F.length(head) + 2, F.length(block))).alias("text"))

    return cut.select(
        tree,
        F.transform("blocks", turn).alias("turns"),
        F.array_join(F.transform("loss_mask", lambda m: unescaped(F.get("blocks", m["turn"]).substr(m["start"] + 1, m["length"]))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """What op4 returns, of a table of conv_id, turn, role and text."""
    back = read_back(format_chats(reply_tree(turns)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


SQL = {
    "op4_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(15 + length(replace(replace(role, '\', '\b'), chr(10), '\n')) + length(regexp_replace(text, '(###|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id"""
}
