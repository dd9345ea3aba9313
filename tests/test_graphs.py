"""Trees and graphs of any depth: rings and chains longer than a recursion's limits, unknown parents, boundaries."""

from pyspark.sql import functions as F

from loomlight.operators import graphs as G


def chain(spark, n):
    return spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "node long, parent long").repartition(3)


def test_ring_of_seventy_with_a_tail(spark):
    rows = [(i, (i + 1) % 70) for i in range(70)] + [(100, 5), (101, 100), (200, None), (201, 200), (300, 300)]
    found = {(r.node, r.cycle, r.size) for r in G.cycles(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert found == {(i, 0, 70) for i in range(70)} | {(300, 300, 1)}


def test_closure_of_a_long_chain_and_of_a_ring(spark):
    found = G.closure(chain(spark, 200))
    assert found.count() == 200 * 201 // 2 and found.filter("ancestor = 0 and node = 199 and depth = 199").count() == 1
    ring = G.closure(spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "node long, parent long"))
    assert ring.count() == 25 and ring.agg({"depth": "max"}).first()[0] == 4


def test_closure_of_many_nodes(spark):
    wide = spark.range(1_000_000).selectExpr("id as node", "case when id >= 10 then id % 10 end as parent")
    assert G.closure(wide).count() == 1_000_000 + 999_990


def test_preorder_keeps_orphans_and_rings(spark):
    rows = [("a", None), ("b", "a"), ("c", "gone"), ("x", "z"), ("y", "x"), ("z", "y")]
    found = {r.node: r.path for r in G.preorder(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert found == {"a": "a", "b": "a/b", "c": "c", "x": "x", "y": "x/y", "z": "x/y/z"}


def test_boundaries(spark):
    rows = [
        ("root", None, None, "CHAIN", None),
        ("named", "root", "p", "LLM", None),  # the enclosing boundary has no agent
        ("agent", "root", "p", "agent", None),
        ("same", "agent", "p", "LLM", None),
        ("other", "same", "q", "LLM", None),
        ("invoked", "agent", None, "CHAIN", "invoke_agent"),
        ("lost", "gone", None, "LLM", None),
    ]
    nodes = spark.createDataFrame(rows, "node string, parent string, agent string, kind string, operation string")
    found = {r.node: (r.enclosing, r.depth) for r in G.run_tree(nodes).collect()}
    assert found == {"root": ("root", 0), "named": ("root", 0), "agent": ("agent", 1), "same": ("agent", 1), "other": ("other", 2), "invoked": ("invoked", 2), "lost": ("lost", 0)}


def test_long_chains_and_wide_stars_take_few_rounds(spark):
    n = 2000
    chain = [(f"n{i:05d}", f"n{i - 1:05d}" if i else None, 1.0 if i % 2 else None) for i in range(n)]
    star = [(f"s{i:05d}", "s00000" if i else None, 0.5) for i in range(20_000)]
    nodes = spark.createDataFrame(chain + star, "node string, parent string, usd double").repartition(4)
    totals = {r.node: (r.records, r.usd, r.usd_unknown) for r in G.subtree_totals(nodes).collect()}
    assert all(totals[f"n{i:05d}"] == (n - i, float((n - i + 1) // 2), (n - i) // 2) for i in range(n - 1))
    assert totals["n01999"] == (1, 1.0, 0) and totals["s00000"] == (20_000, 10_000.0, 0) and totals["s00007"] == (1, 0.5, 0)
    paths = {r.node: (r.path, r.depth) for r in G.preorder(nodes.filter("node < 'n00300' or node > 's'")).collect()}
    assert paths["n00299"] == ("/".join(f"n{i:05d}" for i in range(300)), 299) and paths["s19999"] == ("s00000/s19999", 1)
    tree = {r.node: (r.enclosing, r.depth) for r in G.run_tree(nodes.withColumn("agent", F.when(F.col("node").rlike("[05]00$"), F.col("node")))).collect()}
    assert tree["n01999"] == ("n01500", 3) and tree["n00499"] == ("n00000", 0) and tree["s19999"] == ("s00000", 0) and tree["s19500"] == ("s19500", 1)
    graded = nodes.select("node", "parent", F.col("node").rlike("[05]00$").alias("is_round"), F.when(F.col("node").rlike("[37]77$"), F.col("node")).alias("verdict"), F.col("node").alias("ord"))
    verdicts = {r.round: r.verdict for r in G.round_verdicts(graded).collect()}
    assert verdicts["n00500"] == "n00777" and verdicts["n01500"] == "n01777" and verdicts["s00500"] is None and verdicts["s00000"] == "s00377"


def test_rings_are_whole_below_each_of_their_nodes(spark):
    rows = [("a", "c", 1.0), ("b", "a", 2.0), ("c", "b", None), ("d", "c", 4.0), ("e", "d", 8.0), ("x", "x", 1.0), ("y", "gone", 3.0)]
    nodes = spark.createDataFrame(rows, "node string, parent string, usd double")
    totals = {r.node: (r.records, r.usd, r.usd_unknown) for r in G.subtree_totals(nodes).collect()}
    assert totals == {"a": (5, 15.0, 1), "b": (5, 15.0, 1), "c": (5, 15.0, 1), "d": (2, 12.0, 0), "e": (1, 8.0, 0), "x": (1, 1.0, 0), "y": (1, 3.0, 0)}
