"""Trees of turns: paths from leaves to roots, abandoned branches, subtree sizes. All by pointer jumping: joins as many as
the logarithm of the depth, where a recursive query needs one for each level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Rounds of doubling, enough for any depth.
ROUNDS = 63


def _parents(nodes: DataFrame) -> DataFrame:
    """(tree, node, up): each node's parent, the first of the tables that _doubled makes."""
    return nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("up"))


def _doubled(step: DataFrame) -> DataFrame:
    """From each node's ancestor 2^k steps up to that of twice the steps, for nodes that have one."""
    return step.join(step.select("tree", F.col("node").alias("up"), F.col("up").alias("_far")), ["tree", "up"]).select("tree", "node", F.col("_far").alias("up"))


def main_path(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree, node) of every node from each tree's leaf up to its root; leaves has tree and node.

    Step k adds the ancestors 2^k steps above the nodes marked so far, which are those less than 2^k steps above a leaf; only
    the marked nodes and one ancestor of each node are carried. A round takes two steps and writes once.
    """
    marked, step = cut(leaves.select("tree", "node").distinct()), cut(_parents(nodes))
    above = lambda known, by: known.unionByName(known.join(by, ["tree", "node"]).select("tree", F.col("up").alias("node"))).distinct()
    for _ in range(ROUNDS):
        if step.isEmpty():
            break
        twice = _doubled(step)
        marked = cut(above(above(marked, step), twice))
        step = cut(_doubled(twice))
    return marked


def abandoned(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Every node with status: abandoned if it is off the main path but has an ancestor on it, else accepted."""
    main = main_path(nodes, leaves).withColumn("_main", F.lit(True))
    # whether one of the ancestors up to up is on the main path; what has none above is done
    above = main.select("tree", F.col("node").alias("up"), F.col("_main").alias("_hit"))
    state = cut(_parents(nodes).join(above, ["tree", "up"], "left").select("tree", "node", F.when(F.col("_hit").isNull(), F.col("up")).alias("up"), F.coalesce("_hit", F.lit(False)).alias("_hit")))
    for _ in range(ROUNDS):
        if state.filter("up is not null").isEmpty():
            break
        for _ in range(2):
            beyond = state.select("tree", F.col("node").alias("up"), F.col("up").alias("_far"), F.col("_hit").alias("_far_hit"))
            hit = F.col("_hit") | F.coalesce("_far_hit", F.lit(False))
            state = state.join(beyond, ["tree", "up"], "left").select("tree", "node", F.when(~hit, F.col("_far")).alias("up"), hit.alias("_hit"))
        state = cut(state)
    under = state.filter("_hit").select("tree", "node").join(main, ["tree", "node"], "left_anti").distinct()
    return nodes.join(under.withColumn("_off", F.lit(True)), ["tree", "node"], "left").withColumn("status", F.when(F.col("_off"), "abandoned").otherwise("accepted")).drop("_off")


def abandoned_branches(statuses: DataFrame) -> DataFrame:
    """(tree, n): abandoned nodes whose parent isn't abandoned."""
    parents = statuses.select("tree", F.col("node").alias("parent"), F.col("status").alias("_above"))
    return statuses.filter("status = 'abandoned'").join(parents, ["tree", "parent"], "left").filter("_above is null or _above <> 'abandoned'").groupBy("tree").agg(F.count("*").alias("n"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(tree, node, size): how many nodes a node has under it, itself included.

    Round k adds to a node's count, of nodes less than 2^k steps under it, those of the nodes that are 2^k steps under it.
    """
    sizes, step = cut(nodes.select("tree", "node", F.lit(1).cast("long").alias("size"))), cut(_parents(nodes))
    for _ in range(ROUNDS):
        if step.isEmpty():
            break
        more = step.join(sizes, ["tree", "node"]).groupBy("tree", F.col("up").alias("node")).agg(F.sum("size").alias("_more"))
        sizes = cut(sizes.join(more, ["tree", "node"], "left").select("tree", "node", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
        step = cut(_doubled(step))
    return sizes


def outline(nodes: DataFrame) -> DataFrame:
    """(tree, node, place, depth): each node's place, from 0, in a depth-first walk of its tree with children in order, and its indent.

    A node comes as many places after its parent as the parent itself and the subtrees of its earlier siblings take; places are
    the sums of these along the way up, by doubling. Only a node with several children indents what is under it, so that a
    chain stays on one level. The roots of a tree are siblings, in order, and indent nothing. A node's children are ordered in
    one window, so a node with a great many is one task's sort.
    """
    sized = nodes.select("tree", "node", "parent").join(subtree_sizes(nodes), ["tree", "node"])
    siblings = Window.partitionBy("tree", "parent")
    earlier = siblings.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("parent").isNotNull()
    step = (F.coalesce(F.sum("size").over(earlier), F.lit(0)) + below.cast("long")).alias("place")
    state = cut(sized.select("tree", "node", F.col("parent").alias("up"), step, (below & (F.count("*").over(siblings) > 1)).cast("long").alias("depth")))
    for _ in range(ROUNDS):
        if state.filter("up is not null").isEmpty():
            break
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("_far"), F.col("place").alias("_place"), F.col("depth").alias("_depth"))
        more = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        state = cut(state.join(above, ["tree", "up"], "left").select("tree", "node", F.col("_far").alias("up"), more("place"), more("depth")))
    return state.select("tree", "node", "place", "depth")


def _tops(links: DataFrame) -> DataFrame:
    """(tree, node, top): where each node's way up ends; links has tree, node and up, null at the end of a way."""
    state = cut(links.select("tree", "node", "up", F.coalesce("up", "node").alias("top")))
    for _ in range(ROUNDS):
        if state.filter("up is not null").isEmpty():
            break
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("_far"), F.col("top").alias("_top"))
        state = cut(state.join(above, ["tree", "up"], "left").select("tree", "node", F.col("_far").alias("up"), F.coalesce("_top", "top").alias("top")))
    return state.select("tree", "node", "top")


def summary(nodes: DataFrame) -> DataFrame:
    """(tree, what, node, above, above_what, steps): each tree's graph with its routine turns folded into counts.

    nodes has tree, node, parent, status and kept. What is drawn, from the tree's first root down: each kept node that isn't
    abandoned (what is node), each run of others (steps, named by its first), and for a drawn node or one of a run all that is
    abandoned right under it (abandoned, named by that node). above is the node or run that it hangs from, above_what which of
    them. A run goes on where its last node has one child that isn't abandoned and isn't kept; where it has kept ones, the first
    of them follows the run; more than one child, none of them kept, ends it. The first root counts as kept; other
    roots aren't drawn. steps is the number of nodes folded, 1 for a node.

    Runs and reach come from two rounds of doubling over links between neighbours, so a chain of any length takes as many joins
    as its length's logarithm.
    """
    # many branches of the plan read the nodes, which are worked out once
    nodes = cut(nodes.select("tree", "node", "parent", "status", "kept"))
    root = nodes.filter("parent is null").groupBy("tree").agg(F.min("node").alias("_root"))
    own = nodes.select("tree", "node", "parent", "status", "kept").join(root, "tree")
    own = own.select("tree", "node", "parent", "_root", (F.col("status") == "abandoned").alias("_off"), (F.coalesce("kept", F.lit(False)) | (F.col("node") == F.col("_root"))).alias("_kept"))
    live = own.filter((~F.col("_off")) | (F.col("node") == F.col("_root"))).drop("_off")
    below = live.filter("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("_n"), F.min(F.when(F.col("_kept"), F.col("node"))).alias("_next"))
    above = live.join(below, ["tree", "node"], "left").select("tree", F.col("node").alias("parent"), F.col("_kept").alias("_pk"), "_n", "_next")
    linked = live.join(above, ["tree", "parent"], "left")
    follows = F.when(F.col("_pk"), True).when(F.col("_kept"), F.col("node") == F.col("_next")).otherwise(F.col("_next").isNull() & (F.col("_n") == 1))
    linked = cut(linked.select("tree", "node", "_root", "_kept", "_pk", F.when(follows, F.col("parent")).alias("up")))
    drawn = cut(linked.join(_tops(linked), ["tree", "node"]).filter("top = _root").drop("top"))
    # a run's nodes go up to its first; a kept node stands for itself
    runs = _tops(drawn.select("tree", "node", F.when(~F.col("_kept") & ~F.coalesce("_pk", F.lit(False)), F.col("up")).alias("up")))
    placed = cut(drawn.join(runs.withColumnRenamed("top", "_run"), ["tree", "node"]))
    holders = placed.select("tree", F.col("node").alias("up"), F.col("_run").alias("above"), F.when(F.col("_kept"), "node").otherwise("steps").alias("above_what"))
    heads = placed.filter("node = _run").join(holders, ["tree", "up"], "left")
    counts = placed.groupBy("tree", F.col("_run").alias("node")).agg(F.count("*").alias("steps"))
    shown = heads.join(counts, ["tree", "node"]).select("tree", F.when(F.col("_kept"), "node").otherwise("steps").alias("what"), "node", "above", "above_what", "steps")
    sized = own.filter((F.col("_off")) & (F.col("node") != F.col("_root"))).join(subtree_sizes(nodes), ["tree", "node"])
    stubs = sized.groupBy("tree", F.col("parent").alias("up")).agg(F.sum("size").alias("steps")).join(holders, ["tree", "up"])
    return shown.unionByName(stubs.select("tree", F.lit("abandoned").alias("what"), F.col("up").alias("node"), "above", "above_what", "steps"))


def stitched(nodes: DataFrame) -> DataFrame:
    """Every node with its parent over all sessions of its tree, and boundary, whether a session begins there.

    nodes has tree, session, first_ts and session_ord (the session's first time and place), seq (in its session), node, parent
    and main (whether it lies on the main path; null for nodes that aren't part of a graph). A node without a parent follows
    the node before it in its session; a session's first node the tail of the session before, in the order of first times:
    its last node on the main path or of no graph, or else its last.
    """
    w = Window.partitionBy("tree", "session").orderBy("seq")
    own = nodes.withColumns({"_first": F.row_number().over(w) == 1, "parent": F.coalesce("parent", F.lag("node").over(w))})
    last = F.max_by("node", F.when(F.coalesce("main", F.lit(True)), F.col("seq")))
    tails = nodes.groupBy("tree", "session").agg(F.coalesce(last, F.max_by("node", "seq")).alias("_tail"), F.min(F.coalesce("first_ts", F.lit(""))).alias("_ts"), F.min("session_ord").alias("_ord"))
    before = tails.withColumn("_before", F.lag("_tail").over(Window.partitionBy("tree").orderBy("_ts", "_ord", "session"))).select("tree", "session", "_before")
    joined = own.join(before, ["tree", "session"])
    boundary = F.col("_first") & F.col("parent").isNull()
    return joined.withColumns({"boundary": boundary, "parent": F.coalesce("parent", F.when(F.col("_first"), F.col("_before")))}).drop("_first", "_before")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent is null")


def children(nodes: DataFrame) -> DataFrame:
    """(tree, parent, node, rank): the children of each node in order."""
    w = Window.partitionBy("tree", "parent").orderBy("node")
    return nodes.filter("parent is not null").select("tree", "parent", "node", F.row_number().over(w).alias("rank"))
