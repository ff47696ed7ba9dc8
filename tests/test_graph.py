"""Paths and components of long chains and of random graphs, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import graph

EDGES = "src int, dst int"


def plain_longest(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    state, longest = {}, {}
    for root in list(to):
        stack = [(root, iter(to.get(root, ())))]
        state.setdefault(root, 0)
        if state[root]:
            continue
        state[root] = 1
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                longest[node] = max((1 + longest[x] for x in to.get(node, ())), default=0)
                state[node] = 2
                stack.pop()
            elif state.get(nxt, 0) == 1:
                return None
            elif state.get(nxt, 0) == 0:
                state[nxt] = 1
                stack.append((nxt, iter(to.get(nxt, ()))))
    return max(longest.values(), default=0)


def plain_strong(edges, nodes):
    to = {n: {n} for n in nodes}
    for a, b in edges:
        to[a].add(b)
    done = False
    while not done:
        done = True
        for n in nodes:
            new = set().union(*(to[x] for x in to[n]))
            if new != to[n]:
                to[n], done = new, False
    return {n: min(m for m in to[n] if n in to[m]) for n in nodes}


def test_a_chain_of_a_thousand(spark):
    """In a dozen rounds, not a thousand."""
    chain = [(k, k + 1) for k in range(1000)]
    d = spark.createDataFrame(chain, EDGES)
    written, real = [], graph.written
    graph.written = lambda df, name: written.append(name) or real(df, name)
    try:
        assert graph.longest_path(d) == 1000 and len(written) < 30
        written.clear()
        assert graph.longest_path(spark.createDataFrame([*chain, (1000, 0)], EDGES)) is None and len(written) < 30
        written.clear()
        assert graph.longest_path(spark.createDataFrame([*chain, (1000, 500), (-1, 0), (-2, 0)], EDGES)) is None and len(written) < 60
        written.clear()
        nodes = spark.range(1001).selectExpr("int(id) node")
        ring = graph.strong_components(spark.createDataFrame([*chain, (1000, 0)], EDGES), nodes).collect()
        assert {r["component"] for r in ring} == {0} and len(ring) == 1001 and len(written) < 40
        written.clear()
        loop = graph.strong_components(spark.createDataFrame([*chain, (900, 100), (300, 600)], EDGES), nodes).collect()
        assert {r["node"]: r["component"] for r in loop} == {k: 100 if 100 <= k <= 900 else k for k in range(1001)} and len(written) < 120
        written.clear()
        parts = graph.connected_components(spark.createDataFrame(chain, EDGES), nodes).collect()
        assert {r["component"] for r in parts} == {0} and len(written) < 30
    finally:
        graph.written = real


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    """Chains between branchings, cycles among them in half of the cases, parallel ways, loops."""
    r = random.Random(seed)
    edges, top = set(), 12
    for _ in range(16):
        a, b = r.sample(range(12), 2)
        a, b = (a, b) if seed % 2 else (min(a, b), max(a, b))
        way = [a, *range(top, top + (n := r.choice([0, 1, 2, 7, 20]))), b]
        top += n
        edges |= set(zip(way, way[1:]))
    edges |= {(500, 501), (501, 500)} if seed == 3 else set()
    nodes = sorted({x for e in edges for x in e})
    d = spark.createDataFrame(sorted(edges), EDGES)
    assert graph.longest_path(d) == plain_longest(edges)
    everyone = spark.createDataFrame([(n,) for n in [*nodes, 999]], "node int")
    got = {x["node"]: x["component"] for x in graph.strong_components(d.unionAll(spark.createDataFrame([(3, 3)], EDGES)), everyone).collect()}
    assert got == {**plain_strong(edges, nodes), 999: 999}


def test_empty_graphs(spark):
    none, nodes = spark.createDataFrame([], EDGES), spark.createDataFrame([(1,), (2,)], "node int")
    assert graph.longest_path(none) == 0 and graph.longest_path(spark.createDataFrame([(1, 1)], EDGES)) is None
    for f in (graph.strong_components, graph.connected_components):
        assert sorted(map(tuple, f(none, nodes).collect())) == [(1, 1), (2, 2)] and f(none, nodes.limit(0)).count() == 0


def test_strong_components_send_no_table_through_the_driver(spark):
    executions = spark._jsparkSession.sharedState().statusStore()
    before = executions.executionsCount()
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (2, 9), (9, 2)], EDGES)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    got = {x["node"]: x["component"] for x in graph.strong_components(e, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 4, 7: 7}
    ran = executions.executionsList(before, executions.executionsCount() - before)
    assert ran.size() > 3
    assert not any("BroadcastExchange" in ran.apply(k).physicalPlanDescription() for k in range(ran.size()))


def test_marked_edges_are_shuffled_once(spark):
    """Edges and what they say of their tokens, as by two joins; they lie in the partitions that were asked for."""
    rows = [(k % 50, (k * 7) % 90) for k in range(400)] + [(1, None), (None, 3)]
    e = spark.createDataFrame(rows, "src int, token int")
    found = graph.marked(e, e.where("src IS NOT NULL").select(F.col("src").alias("node")).distinct(), 21)
    assert found.rdd.getNumPartitions() == 21
    assert sorted(found.collect(), key=str) == sorted(((s, t, t is not None and t < 50) for s, t in set(rows)), key=str)
