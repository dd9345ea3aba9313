"""Trees and graphs of spans, of any depth and size, by rounds of joins whose rows are written in between.

What a node has from its ancestors or descendants comes by doubling: each row holds what it knows of a
stretch of the way up and where the stretch ends, and each round joins two stretches to one, so
a chain of n nodes takes log n rounds of n rows. A null parent or one that isn't among the
nodes ends the walk up. Nodes that reach no root, on cycles or under them, are told apart when a
round settles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written


def closure(nodes: DataFrame) -> DataFrame:
    """ancestor, node, depth: every node under itself and each ancestor (the least depth of each, so cycles end)."""
    own = nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    found = written(nodes.filter("parent is not null and parent != node").select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("depth")).distinct())
    count, reach = found.count(), 1
    while True:
        far = found.filter(F.col("depth") == reach).select(F.col("ancestor").alias("via"), "node")
        above = found.select("ancestor", F.col("node").alias("via"), (F.col("depth") + reach).alias("depth"))
        longer = far.join(above, "via").filter("ancestor != node").select("ancestor", "node", "depth")
        found = written(found.union(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
        before, count, reach = count, found.count(), 2 * reach
        if count == before:
            return own.union(found)


def lifted(nodes: DataFrame, start: dict[str, Column], join: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """node and, by name, what a walk from it up to its root makes of start: join(lower, upper) puts two stretches together. Nodes without a root have no row."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    now = written(nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("at"), *(c.alias(n) for n, c in start.items())))
    before = -1
    while True:
        left = now.filter("at is not null")
        count = left.count()
        if count in (0, before):
            return now.filter("at is null").drop("at")
        before = count
        up = now.select(F.col("node").alias("at"), F.col("at").alias("then"), *(F.col(n).alias(f"up_{n}") for n in start))
        longer = left.join(up, "at").select("node", F.col("then").alias("at"), *(join[n](F.col(n), F.col(f"up_{n}")).alias(n) for n in start))
        now = written(now.filter("at is null").union(longer))


def _cut(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose rings are opened at their smallest node, which becomes a root; and the rings."""
    rings = written(cycles(nodes.select("node", "parent")))
    heads = rings.filter("node = cycle").select("node", F.lit(True).alias("head"))
    return nodes.join(heads, "node", "left").withColumn("parent", F.when(F.col("head").isNull(), F.col("parent"))).drop("head"), rings


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """Records, cost and how many costs are unknown of each node with all below it; a node of a cycle has all of the cycle below it.

    A row holds the sum of the nodes less than so many steps below; adding the sums of those
    that many steps below doubles the steps.
    """
    cut, rings = _cut(nodes.select("node", "parent", "usd"))
    known = cut.select(F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    sums = [F.lit(1).cast("long").alias("records"), F.col("usd"), F.col("usd").isNull().cast("long").alias("usd_unknown")]
    now = written(cut.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("at"), *sums))
    while True:
        left = now.filter("at is not null")
        if left.isEmpty():
            break
        below = left.groupBy(F.col("at").alias("node")).agg(*(F.sum(c).alias(f"more_{c}") for c in ("records", "usd", "usd_unknown")))
        up = left.select(F.col("node").alias("at"), F.col("at").alias("then"))
        both = now.join(below, "node", "left").join(up, "at", "left")
        added = lambda c: F.coalesce(F.col(c) + F.col(f"more_{c}"), F.col(c), F.col(f"more_{c}")).alias(c)
        now = written(both.select("node", F.col("then").alias("at"), added("records"), added("usd"), added("usd_unknown")))
    totals = now.select("node", "records", F.round("usd", 2).alias("usd"), "usd_unknown")
    others = rings.filter("node <> cycle").select("node", "cycle")
    of_ring = others.join(totals.withColumnRenamed("node", "cycle"), "cycle").drop("cycle")
    return totals.join(others.select("node"), "node", "left_anti").unionByName(of_ring)


# Operations that start an agent's run.
AGENT_OPERATIONS = ("invoke_agent", "invoke_workflow")


def run_tree(nodes: DataFrame) -> DataFrame:
    """Nodes dealt to the boundary that encloses them: node, enclosing, agent (of the boundary), depth (of boundaries).

    A boundary is a root, a node without a known parent, one of kind AGENT or of an agent's
    operation (where nodes have such columns), or one whose agent differs from the enclosing
    boundary's, if both are known.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    forced = F.col("known").isNull()
    if "kind" in nodes.columns:
        forced = forced | F.coalesce(F.upper("kind") == "AGENT", F.lit(False))
    if "operation" in nodes.columns:
        forced = forced | F.coalesce(F.col("operation").isin(*AGENT_OPERATIONS), F.lit(False))
    root = F.col("known").isNull().alias("root")
    marked = written(nodes.join(known, "parent", "left").select("node", "parent", "agent", forced.alias("forced"), root))
    # the last boundary of its own at or above each node, and the last agent that was told from there on
    held = F.struct(F.col("forced"), F.when(F.col("forced"), F.col("agent")).alias("first"), F.col("agent").alias("last"))
    both = lambda low, up: F.when(low["forced"], low).otherwise(F.struct(up["forced"].alias("forced"), up["first"].alias("first"), F.coalesce(low["last"], up["last"]).alias("last")))
    told = lifted(marked, {"held": held}, {"held": both})
    # a boundary without an agent has none to differ from
    state = told.select(F.col("node").alias("parent"), F.when(F.col("held.first").isNotNull(), F.col("held.last")).alias("enclosing_agent"))
    new = F.col("forced") | F.coalesce(F.col("agent") != F.col("enclosing_agent"), F.lit(False))
    bounded = written(marked.join(state, "parent", "left").select("node", "parent", "agent", new.alias("new"), (new & ~F.col("root")).cast("int").alias("step")))
    boundary = F.when(F.col("new"), F.struct(F.col("node").alias("enclosing"), "agent"))
    found = lifted(bounded, {"boundary": boundary, "depth": F.col("step")}, {"boundary": F.coalesce, "depth": lambda low, up: low + up})
    return found.select("node", "boundary.enclosing", "boundary.agent", "depth")


def spend_split(nodes: DataFrame) -> DataFrame:
    """Spend of drivers (nodes with children) and of leaves, which never merge."""
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("driver", F.lit(True))
    rows = nodes.join(parents, "node", "left").withColumn("role", F.when(F.col("driver"), "driver").otherwise("leaf"))
    return rows.groupBy("role").agg(F.count("*").alias("nodes"), F.round(F.sum("usd"), 2).alias("usd"), F.count_if(F.col("usd").isNull()).alias("usd_unknown"))


def roles(nodes: DataFrame) -> DataFrame:
    """supervisor for roots and parents of anything, else worker."""
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("driver", F.lit(True))
    return nodes.join(parents, "node", "left").select("node", F.when(F.col("driver") | F.col("parent").isNull(), "supervisor").otherwise("worker").alias("role"))


def journal(nodes: DataFrame) -> DataFrame:
    """Each node with its own spend and that of its direct children; unknown parents are shown at depth 0."""
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.round(F.sum("usd"), 2).alias("children_usd"))
    there = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    rows = nodes.join(children, "node", "left").join(there, "parent", "left")
    return rows.select("node", F.coalesce("children", F.lit(0)).alias("children"), F.col("usd").alias("own_usd"), "children_usd", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"))


def reach(edges: DataFrame, start: DataFrame, bound: int = 5) -> DataFrame:
    """node and least distance of all that edges, taken both ways, reach from the start within the bound: one join a level over a frontier without repeats."""
    both = edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).union(edges.select("child", "parent"))
    found = start.select("node", F.lit(0).alias("distance")).distinct()
    frontier = found
    for level in range(1, bound + 1):
        following = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        frontier = following.select("node", F.lit(level).alias("distance"))
        found = found.union(frontier)
    return found


def cycles(nodes: DataFrame) -> DataFrame:
    """Nodes that are their own ancestor, with the smallest node of their cycle and its size.

    Each node has one parent, so after as many steps up as there are nodes only nodes of
    cycles are left, each reached by itself; steps are doubled, with the least node on the way.
    """
    now = written(nodes.filter("parent is not null").select("node", F.col("parent").alias("at"), F.least("node", "parent").alias("least")))
    steps, most = 1, now.count()
    while steps < most:
        on = now.select(F.col("node").alias("at"), F.col("at").alias("then"), F.col("least").alias("next"))
        now = written(now.join(on, "at").select("node", F.col("then").alias("at"), F.least("least", "next").alias("least")))
        steps *= 2
        if now.isEmpty():
            break
    reached = now.select(F.col("at").alias("node")).distinct()
    ring = now.join(reached, "node", "left_semi").select("node", F.col("least").alias("cycle"))
    sizes = ring.groupBy("cycle").agg(F.count("*").cast("int").alias("size"))
    return ring.join(sizes, "cycle").select("node", "cycle", "size")


def preorder(nodes: DataFrame) -> DataFrame:
    """Nodes with their path from the root, the order of a walk in depth first; a node whose parent is unknown is a root, and so is the smallest node of a cycle."""
    cut, _ = _cut(nodes.select("node", "parent"))
    path = lambda low, up: F.concat(up, F.lit("/"), low)
    return lifted(cut, {"path": F.col("node").cast("string"), "depth": F.lit(0)}, {"path": path, "depth": lambda low, up: low + up + 1})


def round_verdicts(nodes: DataFrame) -> DataFrame:
    """Verdict of each round: its own, else that of the shallowest graded node below it, never past a nested round.

    nodes: node, parent, is_round, verdict, ord.
    """
    parents = nodes.select(F.col("node").alias("parent"), "is_round")
    cut, _ = _cut(nodes.select("node", "parent"))
    # steps from each node to the nearest round above it
    above = cut.join(parents, "parent", "left").withColumn("is_round", F.coalesce("is_round", F.lit(False)))
    near = F.struct(F.when(F.col("is_round"), F.col("parent")).alias("round"), F.lit(1).alias("depth"))
    nearest = lambda low, up: F.when(low["round"].isNotNull(), low).otherwise(F.struct(up["round"].alias("round"), (low["depth"] + up["depth"]).alias("depth")))
    owner = lifted(above, {"near": near}, {"near": nearest}).filter("near.round is not null").select("node", "near.round", "near.depth")
    below = owner.join(nodes.select("node", "verdict", "ord"), "node").select("round", "verdict", "depth", "ord")
    every = below.union(nodes.filter("is_round").select(F.col("node").alias("round"), "verdict", F.lit(0).alias("depth"), "ord"))
    return every.groupBy("round").agg(F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.struct("depth", "ord"))).alias("verdict"))
