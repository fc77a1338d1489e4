"""Reachability against plain Python, on graphs with and without cycles."""

import random

import pytest

from sylvan.operators import graph


def plain_closure(edges):
    want = set(edges)
    while more := {(x, z) for x, y in want for y2, z in edges if y == y2} - want:
        want |= more
    return want


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "u string, v string")


def some_edges(seed):
    r = random.Random(seed)
    return {(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(16)} | {("a", "a"), ("b", "c"), ("c", "b"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "t")}


@pytest.mark.parametrize("seed", [4, 5])
def test_closure_and_components_on_cycles(spark, seed):
    edges = some_edges(seed)
    want = plain_closure(edges)
    whole = graph.Closure(frame(spark, edges), "u", "v")
    assert {tuple(x) for x in whole.pairs().collect()} == want
    of = {r.node: r.component for r in whole.members.collect()}
    nodes = {n for e in edges for n in e}
    assert set(of) == nodes
    assert all((of[x] == of[y]) == (x == y or (x, y) in want and (y, x) in want) for x in nodes for y in nodes)


def test_a_dense_component_makes_few_rows(spark):
    """1000 nodes with edges both ways round a ring and some chords: no table of the run has a row for each of their 10**6 pairs."""
    n = 1000
    edges = {(f"m{k}", f"m{(k + d) % n}") for k in range(n) for d in (1, 10, 100)} | {("m5", "out"), ("in", "m7")}
    kept = []
    keep = graph.Rounds.keep

    def counted(self, df, gone=None, **how):
        kept.append(keep(self, df, **how))
        return kept[-1]

    graph.Rounds.keep = counted
    try:
        whole = graph.Closure(frame(spark, edges), "u", "v")
        assert max(t.count() for t in kept) <= len(edges) + 2 * n
    finally:
        graph.Rounds.keep = keep
    assert whole.members.select("component").distinct().count() == 3 and whole.between.count() == 4
    assert whole.pairs().count() == n * n + n + n + 1


def test_reach_follows_the_cone(spark):
    """A cone of a few nodes in a graph of many: rounds find them and no more."""
    many = {(f"x{k}", f"x{k + 1}") for k in range(3000)}
    edges = many | {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d")}
    rounds = graph.Rounds(spark, "t")
    own = rounds.keep(graph._edges(frame(spark, edges), "u", "v"))
    seeds = spark.createDataFrame([("b",), ("b",), (None,), ("nowhere",)], "id string")
    known, found = graph.reach(seeds, own, rounds)
    assert sorted(r.id for r in known.collect()) == ["a", "b", "c", "d", "nowhere"]
    assert found == [2, 1, 2, 0]
    known, found = graph.reach(seeds.limit(1), own, rounds, back=True)
    assert sorted(r.id for r in known.collect()) == ["a", "b", "c"] and found == [1, 1, 1, 0]


@pytest.mark.parametrize("limit", [graph.BROADCAST_IDS, 0])
def test_cone_on_cycles(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "BROADCAST_IDS", limit)  # without broadcasts too
    edges = some_edges(6)
    want = plain_closure(edges)
    seeds = {"n3", "s", "b"}
    affected = seeds | {x for x, y in want if y in seeds}
    needed = affected | {y for x, y in want if x in affected}
    got = graph.cone(spark.createDataFrame([(s,) for s in seeds], "model string"), frame(spark, edges), "u", "v").collect()
    assert len(got) == len(needed) and {r.id: r.affected for r in got} == {n: n in affected for n in needed}


def test_empty(spark):
    none = spark.createDataFrame([], "u string, v string")
    assert graph.closure(none, "u", "v").count() == 0
    assert [tuple(r) for r in graph.cone(spark.createDataFrame([("a",)], "id string"), none, "u", "v").collect()] == [("a", True)]
