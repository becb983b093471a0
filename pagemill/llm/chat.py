"""Chat formatting of reply trees, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Stash

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# What no text may hold unescaped: the template's own marks and those of common chat templates.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|/?SYS>|<SYS>)"


def escape(text: Column) -> Column:
    """Doubles each backslash, then puts one inside each control string after its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tree_paths(nodes: DataFrame, stash: Stash) -> DataFrame:
    """(leaf, node, up): each root-to-leaf path, up being the node's distance from the leaf.

    nodes has unique non-null ``node`` and ``parent`` (null at a root). Iterative self-joins double
    the reach each round, so a path of n nodes takes log2(n) rounds. A node whose parent is not in
    the table is a root. Nodes that hang on a cycle have no leaf or never reach a root; the doubling
    stops once the reach passes the number of nodes, and their endless paths are left out."""
    total = nodes.count()
    real = nodes.select(F.col("node").alias("up_node"))
    jump = stash.keep(nodes.select("node", "parent").join(real, F.col("parent") == F.col("up_node")).select("node", "up_node"), "jump")
    leaves = nodes.select("node").join(jump.select(F.col("up_node").alias("node")), "node", "left_anti")
    paths = stash.keep(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    reach = 1
    while not jump.isEmpty() and reach <= total:
        further = paths.join(jump, "node").select("leaf", F.col("up_node").alias("node"), (F.col("up") + reach).alias("up"))
        longer = stash.keep(paths.union(further), "paths")
        second = jump.select(F.col("node").alias("up_node"), F.col("up_node").alias("top"))
        twice = stash.keep(jump.join(second, "up_node").select("node", F.col("top").alias("up_node")), "jump")
        stash.drop(paths, jump)
        paths, jump, reach = longer, twice, reach * 2
    if reach > total and not jump.isEmpty():
        endless = paths.groupBy("leaf").agg(F.max("up").alias("far")).where(F.col("far") >= total).select("leaf")
        paths = paths.join(endless, "leaf", "left_anti")
    return paths


def format_trees(nodes: DataFrame, branches: int | None = None, assistant: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen root-to-leaf path.

    nodes: tree (any type, null allowed), node and parent (strings, node unique), role, text, score.
    Paths of a tree are ranked by their mean score (null: 0), then by leaf; the first ``branches``
    are formatted, all if None. Each turn is TURN + role + TEXT + text + END, with role and text
    escaped, so marks inside texts cannot end a turn. loss_mask lists (start, length) in characters
    of the formatted string of each assistant text. Null role or text: empty. Repeated texts stay.
    An empty table gives no rows; other columns are ignored.

    Returns tree, leaf, branch (rank from 1), n_turns, formatted, loss_mask."""
    stash = Stash(nodes.sparkSession, "chat")
    paths = tree_paths(nodes.select("node", "parent"), stash)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    turns = nodes.select("tree", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), head.alias("head"), escape(text).alias("body"), (role == assistant).alias("learn"))
    # many paths may share a node near the root: only scores meet before the choice, texts after it
    scored = paths.join(turns.select("tree", "node", "score"), "node").groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("score").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    if branches is None:
        chosen = scored.select("leaf", rank.alias("branch"))
    else:
        chosen = scored.select("leaf", rank.alias("branch")).where(F.col("branch") <= branches)
    piece = F.concat("head", "body", F.lit(END))
    spot = Window.partitionBy("leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    laid = paths.join(chosen, "leaf").join(turns, "node").select(
        "tree", "leaf", "branch", "up", piece.alias("piece"), "learn", F.length("body").alias("len"),
        (F.sum(F.length(piece)).over(spot) - F.length("body") - len(END)).alias("start"),
    )
    whole = laid.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("branch").alias("branch"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "learn", "start", "len"))).alias("all"))
    mask = F.transform(F.filter("all", lambda x: x["learn"]), lambda x: F.struct(x["start"].cast("long").alias("start"), x["len"].cast("long").alias("length")))
    return whole.select("tree", "leaf", "branch", F.size("all").cast("long").alias("n_turns"), F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    ends = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.slice(ends, F.lit(1), F.size(ends) - 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring(F.substring_index(t, TEXT, 1), len(TURN) + 1, 2**31 - 1)).alias("role"), unescape(F.substring_index(t, TEXT, -1)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under a loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"].cast("int") + 1, m["length"].cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees of one branch: each row answers the row
    before it by turn (null first; ties by role, then text)."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "role", "text", conv.alias("c"), at.alias("at"))
    name = lambda n: F.concat_ws(":", "c", n.cast("string"))
    return rows.select(F.col("conv_id").alias("tree"), name(F.col("at")).alias("node"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
