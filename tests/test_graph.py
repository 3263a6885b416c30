import random

import pytest
from pyspark.sql import functions as F

from codexweave.operators import graph, store
from codexweave.plans import detail_queries


def one_by_one(claims, unit):
    """The plain way: claims in order, each taken unless its unit has a parent or stands above the parent's unit."""
    above, out = {}, {}
    for rank, parent, child, rel in sorted(claims):
        c, h = unit.get(child, child), unit.get(parent, parent)
        if c == h:
            continue
        top = h
        while top in above:
            top = above[top]
        ok = c not in above and top != c
        if ok:
            above[c] = h
        out[child, parent, rel] = ok
    return out


@pytest.mark.parametrize("seed, family, n", [(0, 1000, 60), (1, 1000, 60), (2, 0, 12), (3, 8, 14)])
def test_household_trees_take_claims_as_one_by_one(spark, seed, family, n):
    """In families of one task each, in batches over all families, and both."""
    rng = random.Random(seed)
    people = [f"p{i}" for i in range(n)]
    claims = {(rng.randrange(4), rng.choice(people), rng.choice(people), rng.choice("ab")) for _ in range(2 * n)}
    claims = list({c[1:]: c for c in claims}.values())
    unit = {p: f"p{min(i, i - i % 3)}" for i, p in enumerate(people) if rng.random() < 0.6}
    df = spark.createDataFrame([(c, p, rel, r) for r, p, c, rel in claims] * 2, "child string, parent string, rel string, rank int")
    units = spark.createDataFrame(list(unit.items()), "node string, unit string")
    got = {(r["child"], r["parent"], r["rel"]): r["solid"] for r in graph.households_tree(df, units, family).collect()}
    want = one_by_one(claims, unit)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_refusals_of_a_hub_do_not_take_a_round_each(spark, monkeypatch):
    """Each of the hub's claims is onto a unit that follows it just before: all are refused, and what is written down grows with the batches only."""
    written, plain = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: written.append(1) or plain(df))
    claims = [x for i in range(30) for x in ((2 * i, "hub", f"d{i:02}", "of"), (2 * i + 1, f"d{i:02}", "hub", "of"))]
    df = spark.createDataFrame([(c, p, rel, r) for r, p, c, rel in claims], "child string, parent string, rel string, rank int")
    units = spark.createDataFrame([], "node string, unit string")
    got = {(r["child"], r["parent"], r["rel"]): r["solid"] for r in graph.households_tree(df, units, 20).collect()}
    assert got == one_by_one(claims, {}) and sum(got.values()) == 30
    assert len(written) < 40


def test_circles_and_displaced_claims(spark):
    claims = [("b", "a", 1), ("c", "b", 2), ("a", "c", 3), ("a", "d", 4), ("c", "d", 5), ("d", "d", 0), ("a2", "b", 0)]
    df = spark.createDataFrame([(c, p, "of", r) for c, p, r in claims], "child string, parent string, rel string, rank int")
    units = spark.createDataFrame([("a", "a"), ("a2", "a")], "node string, unit string")
    solid = {(r["child_unit"], r["parent_unit"]) for r in graph.households_tree(df, units).collect() if r["solid"]}
    # a2's claim makes a follow b; so b -> a would close a circle, c -> b stays, and b has no parent left
    assert solid == {("a", "b"), ("c", "b")}
    assert graph.households_tree(df.filter("false"), units).count() == 0


def test_the_query_has_circles_and_grandparents(spark):
    sf = "/root/testdata/sf0.01"
    _, _, units, claims = detail_queries.crowd(spark, sf)
    tree = graph.households_tree(claims, units)
    rows = tree.join(claims.select("child", "parent", "rel", "rank").distinct(), ["child", "parent", "rel"]).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r["parent"], r["child"], r["rel"])):
        first.setdefault(r["child_unit"], r)
    fallback = [u for u, r in first.items() if not r["solid"] and any(x["solid"] and x["child_unit"] == u for x in rows)]
    assert fallback  # a first claim would have closed a circle, and a later one was taken
    assert any(r["solid"] and r["rank"]["__far"] for r in rows) and any(not r["solid"] and r["rank"]["__far"] for r in rows)


def test_hubs_are_dealt_and_give_the_same_units(spark, monkeypatch):
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(20)] + [(5, 5), (700, 0)]
    df = spark.createDataFrame(links, "a int, b int")
    want = sorted(map(tuple, graph.households(df, "a", "b").collect()))
    assert {u for n, u in want if n < 1000} == {0} and {u for n, u in want if n >= 1000} == {1000}
    monkeypatch.setattr(store.hot_keys, "__defaults__", (50,))
    assert sorted(map(tuple, graph.households(df, "a", "b").collect())) == want
    left = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z")], "k long, v string")
    assert sorted(map(tuple, store.spread_join(left, right, "k", store.hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "k", 500)).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_subtrees_of_deep_chains_and_circles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(10, 12), (25, 24), (50, 51), (50, 52), (52, 51)]
    df = spark.createDataFrame(edges, "p int, c int")
    got = sorted(map(tuple, graph.subtree(df, graph.roots(df, "p", "c"), "p", "c", merge=4).collect()))
    depth = lambda i: i if i < 12 else i - 1
    assert got == sorted([(0, i, depth(i)) for i in range(31)] + [(50, 50, 0), (50, 51, 1), (50, 52, 1)])


def test_neighbours_are_counted_not_gathered(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("a", "c", "x"), ("c", "c", "x")], "source string, target string, rel string")
    nodes, links, near = graph.relation_graph(e, spark.createDataFrame([("a", 3)], "node string, weight int"), [("X", "x")], "other", 3)
    assert sorted(map(tuple, nodes.collect())) == [("a", 3, 2, 3, True), ("b", 2, 1, 0, False), ("c", 3, 2, 0, False)]
    assert ("a", "b", 2) in set(map(tuple, near.collect())) and links.count() == 4
    assert "collect_set" not in nodes._jdf.queryExecution().executedPlan().toString()
