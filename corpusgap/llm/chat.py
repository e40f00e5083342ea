"""Chat formatting of reply trees; DataFrame functions only.

Messages form trees (node, parent).  Iterated self-joins double the reach of each
node's ancestor pointer, so a branch of n turns takes log2(n) joins and no row holds
more than two ids.  Branches (leaves) are ranked within their tree by the sum of
their messages' scores; the chosen ones are walked back to the root by the same
pointers, and each becomes one formatted conversation with its loss mask.

Format: each turn is ``<|turn|>`` role ``\\n`` text ``<|end|>\\n``; in roles and texts
``&``, ``<`` and ``[`` are written as ``&amp;``, ``&lt;`` and ``&#91;``, so no control string of
this or a common other template can stand there.  The mask lists the spans of
assistant texts, in code points of the formatted text.

Defined cases: null role or text is empty; a parent that isn't there makes a root;
nodes on a cycle have no root and are left out; among messages with one node id the
least by role and text counts; ties of branch scores go to the lesser leaf id;
null scores count 0; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import Scratch

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
# What stands for the characters that control strings begin with.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _messages(df: DataFrame) -> DataFrame:
    """tree, node, parent, role, text, score with one row a node."""
    blank = F.lit("")
    rows = df.select("tree", "node", "parent", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = rows.filter("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    return rows.select("tree", "node", "m.parent", "m.role", "m.text", "m.score")


def _linked(messages: DataFrame) -> DataFrame:
    """(tree, node, up, total): the parents that exist, and the scores."""
    rows = messages.select("tree", "node", "parent", F.col("score").alias("total"))
    there = rows.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    joined = rows.join(there, rows["tree"].eqNullSafe(there["t"]) & (rows["parent"] == there["p"]) & (rows["parent"] != rows["node"]), "left")
    return joined.select("tree", "node", F.col("p").alias("up"), "total")


def _pointers(scratch: Scratch, first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Level k: (tree, node, up, total) of the nodes that have an ancestor 2**k above, with the score of
    node and those below that ancestor; and (tree, node, total) of every node up to its root.

    Nodes that have reached their root take no part in further joins.  Only ids and scores move.
    """
    whole, level = first.filter("up IS NULL").select("tree", "node", "total"), first.filter("up IS NOT NULL")
    levels, most = [], max(1, first.count()).bit_length()
    while len(levels) <= most and not level.isEmpty():
        levels.append(level)
        names = [F.col("tree").alias("t"), F.col("node").alias("n")]
        above = level.select(*names, F.col("up").alias("next"), F.col("total").alias("more"))
        above = above.unionByName(whole.select(*names, F.lit(None).cast("long").alias("next"), F.col("total").alias("more")))
        joined = level.join(above, level["tree"].eqNullSafe(above["t"]) & (level["up"] == above["n"]))
        joined = scratch.settle(joined.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total")))
        whole = whole.unionByName(joined.filter("up IS NULL").select("tree", "node", "total"))
        level = joined.filter("up IS NOT NULL")
    return levels, whole


def branches(df: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, place, role, text) of the best branches: place 0 is the root's.

    ``per_tree``: so many branches of each tree, best first (the feature); None: all.
    Texts are settled once and joined once; everything between works on ids.
    """
    scratch = Scratch(df.sparkSession, "reply-trees")
    messages = scratch.settle(_messages(df))
    nodes = scratch.settle(_linked(messages))
    levels, whole = _pointers(scratch, nodes)
    parents = nodes.filter("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = whole.join(parents, whole["tree"].eqNullSafe(parents["t"]) & (whole["node"] == parents["p"]), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best))
    if per_tree is not None:
        chosen = chosen.filter(F.col("branch") <= per_tree)
    path = scratch.settle(chosen.select("tree", F.col("node").alias("leaf"), "branch", "node", F.lit(0).cast("long").alias("above")))
    for k, level in enumerate(levels):
        up = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = path.join(up, path["tree"].eqNullSafe(up["t"]) & (path["node"] == up["n"]))
        before = path
        path = scratch.settle(path.unionByName(further.select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))))
        scratch.drop(before)
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    rows = path.join(texts, path["tree"].eqNullSafe(texts["t"]) & (path["node"] == texts["n"]))
    return rows.select("tree", "leaf", "branch", (-F.col("above")).alias("place"), "role", "text")


def format_conversations(rows: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(tree, leaf, branch, conversation, loss_spans) from the rows of ``branches``.

    loss_spans: array of (start, length) in code points, start from 1.  One conversation
    is one string, so its turns meet in one task; they are only sorted and joined there.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    rows = rows.select("tree", "leaf", "branch", "place", F.concat(head, text, F.lit(CLOSE)).alias("turn"), F.length(head).alias("before"), F.length(text).alias("length"), (F.col("role") == learn_role).alias("learn"))
    so_far = Window.partitionBy("tree", "leaf", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(so_far), F.lit(0)) + F.col("before") + 1)
    turns = F.sort_array(F.collect_list(F.struct("place", "turn")))
    spans = F.sort_array(F.collect_list(F.when(F.col("learn"), F.struct("start", F.col("length").cast("long").alias("length")))))
    return rows.groupBy("tree", "leaf", "branch").agg(F.array_join(F.transform(turns, lambda t: t["turn"]), "").alias("conversation"), spans.alias("loss_spans"))


def read_turns(conversation: Column) -> Column:
    """The turns of a formatted conversation as (role, text), unescaped."""
    parts = F.split(conversation, F.lit("<\\|end\\|>\n"))
    bodies = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    role = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(bodies, lambda b: F.struct(unescape(role(b)).alias("role"), unescape(F.substring(b, F.length(role(b)) + 2, F.length(b))).alias("text")))


def read_loss(conversation: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(conversation, s["start"].cast("int"), s["length"].cast("int")))), "")


def chat_format(df: DataFrame, per_tree: int | None = 1, learn_role: str = "assistant") -> DataFrame:
    """Formats the best branches of reply trees (tree, node, parent, role, text, score)."""
    return format_conversations(branches(df, per_tree), learn_role)


def turn_chains(df: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """A table of plain conversations as reply trees: each row answers the row before it.

    Rows of one turn number are ordered by role and text; null turns come first.
    """
    order = Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_first(), role, text)
    place = F.row_number().over(order)
    return df.select(F.col(tree).alias("tree"), place.alias("node"), (place - 1).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))
