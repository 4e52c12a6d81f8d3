"""Chat formatting of reply trees (native).

Messages form trees through parent links. Iterative self-joins, doubling the step each time, list for every leaf its
ancestors; branches are ranked by score within their tree, and each chosen root-to-leaf path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts and roles every control string gets one
backslash after its first character (``</s>`` -> ``<\\/s>``, ``<\\/s>`` -> ``<\\\\/s>``), which reading back removes, so
any text survives the round trip. In roles backslashes and line ends are written as ``\\\\`` and ``\\n`` too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import write_table

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of each control string, as a pattern.
CONTROLS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({CONTROLS})", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({CONTROLS})", "$1$2$3")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    # an escaped role has backslashes in pairs or before n; an odd one stands before a control string's rest
    pairs = F.split(unescape(c), r"\\\\", -1)
    return F.array_join(F.transform(pairs, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def reply_paths(nodes: DataFrame, *, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths of (tree, node, parent, score): rows (tree, leaf, branch_rank, node, depth), depth 0 at the root.

    ``node`` is unique in its tree; a parent that is null or not in the tree makes its node a root. Branches are ranked
    by mean score (null scores count 0), then length, then leaf; ``best`` keeps that many per tree. Parent links that
    close a cycle have no root, so their nodes are in no path.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    real = nodes.select("tree", F.col("node").alias("parent"))
    up = nodes.select("tree", "node", "parent").join(real, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to"))
    leaves = nodes.join(up.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    jump = write_table(up, "chat-up")
    reach = write_table(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "chat-reach")
    step = 1
    n_nodes = nodes.count()
    while step <= n_nodes and not jump.isEmpty():
        # ancestors at a distance below step are known; the jump by step from each of them doubles that
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        reach = write_table(reach.unionByName(further), "chat-reach")
        again = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("far"))
        jump = write_table(jump.join(again, ["tree", "to"]).select("tree", "node", F.col("far").alias("to")), "chat-up")
        step *= 2
    paths = reach.join(nodes.select("tree", "node", "score", "parent"), ["tree", "node"])
    rooted = F.max(F.struct("up", "node")).alias("top")
    branch = paths.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max("up").alias("length"), rooted)
    branch = branch.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("length"), "leaf")))
    if best is not None:
        branch = branch.where(F.col("branch_rank") <= best)
    return paths.join(branch.select("tree", "leaf", "branch_rank", "length"), ["tree", "leaf"]).select("tree", "leaf", "branch_rank", "node", (F.col("length") - F.col("up")).alias("depth"))


def format_chats(messages: DataFrame, *, tree_col: str, node_col: str, parent_col: str, role_col: str, text_col: str, score: Column | None = None, best: int | None = None) -> DataFrame:
    """One conversation per chosen path: (tree, leaf, branch_rank, n_turns, formatted, loss array<struct<start, length>>).

    ``loss`` marks the assistants' texts inside ``formatted`` in code points from 0. Null roles and texts are empty.
    """
    m = messages.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), (F.lit(0.0) if score is None else score).alias("score"))
    paths = reply_paths(m, best=best)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(text)
    turns = m.select("tree", "node", (role == "assistant").alias("learn"), F.length(head).alias("head_n"), F.length(body).alias("body_n"), F.concat(head, body, F.lit(END + "\n")).alias("turn"))
    t = paths.join(turns, ["tree", "node"])
    so_far = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(so_far), F.lit(0)))
    span = F.when(F.col("learn"), F.struct((F.col("at") + F.col("head_n")).alias("start"), F.col("body_n").alias("length")))
    rows = t.groupBy("tree", "leaf", "branch_rank").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", span.alias("span")))).alias("a"))
    return rows.select("tree", "leaf", "branch_rank", F.size("a").alias("n_turns"), F.array_join(F.col("a.turn"), "").alias("formatted"), F.filter(F.col("a.span"), lambda s: s.isNotNull()).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Turns of formatted conversations, parsed from ``formatted`` alone, and the unescaped text under the loss mask."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")
    turn = lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.regexp_replace(F.regexp_replace(p, r"\A[^\n]*\n", ""), r"<\|im_end\|>\n\z", "")).alias("text"))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return chats.withColumns({"turns": F.transform(parts, turn), "learnt": learnt})


def linear_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text) ordered by turn (null turns last, ties by role and text) as a tree: tree, node, parent, ..."""
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    m = conversations.select("conv_id", "role", "text", F.row_number().over(by).alias("node"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    return m.select(tree.alias("tree"), "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def op4_reply_trees(spark, sf_dir: str) -> DataFrame:
    """Conversations as linear reply trees, formatted and read back. Repeated rows are turns of their own."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    messages = write_table(linear_messages(given.unionByName(own)), "chat-messages")
    chats = format_chats(messages, tree_col="tree", node_col="node", parent_col="parent", role_col="role", text_col="text", best=1)
    back = read_back(chats)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    conv = F.when(F.col("tree") != "none", F.col("tree").cast("long"))
    return back.select(
        conv.alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
