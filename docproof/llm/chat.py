"""Chat formatting over reply trees, with DataFrame functions only.

Messages form trees: each names the message it answers. Root-to-leaf paths are found by
iterative self-joins that double the distance they bridge, so a reply chain of n messages takes
log2(n) rounds and every row keeps a fixed size; branches are ranked by the sum of their
messages' scores, and each chosen path becomes one formatted conversation.

Cases: a null or empty text is an empty turn; a null role is the empty role; a message whose
parent is null or missing is a root; messages in a cycle belong to no path; repeated message
ids in one tree are kept once (the smallest by parent, role and text); an empty table gives no
conversations; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.llm.store import settled

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    """No ``<|`` is left: one backslash is put before the bar of each ``<|``, ``<\\|``, ``<\\\\|`` ..."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Undoes :func:`escape`."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line without bars: backslash, line feed and bar become two characters each."""
    once = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(once, F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    """Undoes :func:`escape_role`: double backslashes first set the pieces apart."""
    piece = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), piece), "\\")


def chained(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn answers the one before.

    Turns are ordered by turn, role and text, nulls first; rows without a conv_id form one
    conversation. Returns tree_id, message_id, parent_id, score, role, text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree_id"),
        F.row_number().over(order).cast("long").alias("message_id"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    ).select("tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "score", "role", "text")


def _same(a: str, b: str, left: str, right: str) -> Column:
    return F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def paths(messages: DataFrame, per_tree: int = 1, max_rounds: int = 40) -> DataFrame:
    """The ``per_tree`` best root-to-leaf paths of each tree, best score first, ties to the smaller leaf id.

    Returns tree_id, path_rank, leaf_id, path_score, depth (of the message, root 0), message_id."""
    nodes = messages.groupBy("tree_id", "message_id").agg(F.min(F.struct("parent_id", "score")).alias("m"))
    nodes = nodes.filter(F.col("message_id").isNotNull()).select("tree_id", "message_id", "m.parent_id", F.coalesce("m.score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree_id", F.col("message_id").alias("id"))
    joined = nodes.alias("n").join(known.alias("k"), _same("n", "k", "parent_id", "id"), "left")
    step = settled(joined.select("n.tree_id", "n.message_id", F.col("k.id").alias("up"), "n.score", F.when(F.col("k.id").isNull(), 0).otherwise(1).cast("long").alias("hops")))
    parents = step.filter("up is not null").select("tree_id", F.col("up").alias("message_id")).distinct()
    jumps = []  # the k-th leads 2**k messages towards the root
    before = -1
    for _ in range(max_rounds):
        jumps.append(step.filter("up is not null").select("tree_id", "message_id", "up"))
        a, b = step.filter("up is not null").alias("a"), step.alias("b")  # what has reached its root rests
        moved = a.join(b, _same("a", "b", "up", "message_id")).select(
            "a.tree_id", "a.message_id", "b.up", (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.hops") + F.col("b.hops")).alias("hops")
        )
        step = settled(step.filter("up is null").unionByName(moved))
        waiting = step.filter("up is not null").count()
        if waiting in (0, before):  # each round ends some paths of a tree; what never ends is a cycle
            break
        before = waiting
    whole = step.filter("up is null")
    leaves = whole.alias("w").join(parents.alias("p"), _same("w", "p", "message_id", "message_id"), "left_anti")
    best = W.partitionBy("tree_id").orderBy(F.desc("path_score"), "leaf_id")
    chosen = leaves.select("tree_id", F.col("message_id").alias("leaf_id"), F.col("score").alias("path_score"), "hops").withColumn("path_rank", F.row_number().over(best)).filter(F.col("path_rank") <= per_tree)
    chosen = settled(chosen)
    at = chosen.select("tree_id", "path_rank", F.col("leaf_id").alias("message_id"), F.col("hops").alias("depth"))
    for k in reversed(range(len(jumps))):
        higher = at.alias("a").join(jumps[k].alias("j"), _same("a", "j", "message_id", "message_id")).select("a.tree_id", "a.path_rank", F.col("j.up").alias("message_id"), (F.col("a.depth") - F.lit(2**k)).alias("depth"))
        at = at.unionByName(higher)
        if k % 4 == 0 and k:
            at = settled(at)
    on = F.col("m.tree_id").eqNullSafe(F.col("c.tree_id")) & (F.col("m.path_rank") == F.col("c.path_rank"))
    return at.alias("m").join(chosen.alias("c"), on).select("c.tree_id", "c.path_rank", "c.leaf_id", "c.path_score", "m.depth", "m.message_id")


def format_paths(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per chosen path: ``formatted`` (a template that marks the turns), and ``loss_spans``,
    the 0-based code-point start and length of each assistant text in it.

    The size of a turn is summed along the path before the turns of a path meet in their row, so
    the spans cost one pass."""
    texts = messages.groupBy("tree_id", "message_id").agg(F.min(F.struct("parent_id", "score", "role", "text")).alias("m"))
    turn = chosen.alias("c").join(texts.alias("t"), _same("c", "t", "message_id", "message_id")).select(
        "c.tree_id", "c.path_rank", "c.leaf_id", "c.path_score", "c.depth",
        F.coalesce("t.m.role", F.lit("")).alias("role"),
        F.coalesce("t.m.text", F.lit("")).alias("text"),
    ).withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = W.partitionBy("tree_id", "path_rank").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turn = turn.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.struct("depth", "piece", F.when(F.col("role") == TRAINED, F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length"))).alias("span"))
    rows = turn.groupBy("tree_id", "path_rank").agg(F.first("leaf_id").alias("leaf_id"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(span)).alias("turns"))
    return rows.select(
        "tree_id", "path_rank", "leaf_id", "path_score",
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the trained text, recovered from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substr(x, F.instr(x, "\n") + F.lit(1))
        text = F.substr(body, F.lit(1), F.length(body) - F.lit(len(END) + 1))
        return F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(text).alias("text"))

    trained = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("read_turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(trained, ""))


def format_conversations(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """:func:`paths` and :func:`format_paths` together, for (tree_id, message_id, parent_id, score, role, text)."""
    return format_paths(paths(messages, per_tree), messages)
