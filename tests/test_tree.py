"""Interval joins by bins against plain containment, and guards that are part of a plan."""

import random

import pytest
from pyspark.sql import functions as F

from sylvan.operators import tree
from sylvan.operators.questions import Questions


def made(seed, n):
    """A random tree's (node_id, pre, last)."""
    r = random.Random(seed)
    above = [None] + [r.choice(range(max(0, k - 6), k)) for k in range(1, n)]
    # In document order: a child follows its parent or an earlier child's subtree.
    kids = {k: [c for c in range(n) if above[c] == k] for k in range(n)}
    out, todo, number, last = [], [(0, False)], {}, {}
    while todo:
        k, done = todo.pop()
        if done:
            last[k] = len(out)
            continue
        out.append(k)
        number[k] = len(out)
        todo.append((k, True))
        todo += [(c, False) for c in reversed(kids[k])]
    return [(f"k{k}", number[k], last[k]) for k in range(n)], above


@pytest.mark.parametrize("seed", [1, 2])
def test_descendants_by_bins(spark, seed):
    rows, above = made(seed, 300)
    want = set()
    for k in range(300):
        up = above[k]
        while up is not None:
            want.add((f"k{up}", f"k{k}"))
            up = above[up]
    numbered = spark.createDataFrame([("m", root, f"{n}{root}", pre, last) for root in ("a", "b") for n, pre, last in rows], "model_id string, root_id string, node_id string, pre long, last long")
    got = [(r.ancestor_id, r.node_id) for r in tree.descendants(numbered).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a + root, b + root) for a, b in want for root in ("a", "b")}


def test_a_large_root_is_spread(spark):
    """A root of 100,000 nodes in groups of ten: few rows meet, whatever the root's size, and no key has more than a few bins' worth."""
    n = 100_000
    numbered = spark.range(1, n + 1).select(F.lit("m").alias("model_id"), F.lit("r").alias("root_id"), F.col("id").alias("node_id"), F.col("id").alias("pre"), F.when(F.col("id") % 10 == 1, F.col("id") + 9).otherwise(F.col("id")).alias("last"))
    assert tree.descendants(numbered).count() == n // 10 * 9
    assert tree.descendants(numbered.where("false")).count() == 0
    spans = numbered.select("model_id", "root_id", F.col("pre").alias("low"), F.col("last").alias("high"))
    found = tree.within(numbered.select("model_id", "root_id", "pre"), spans, ["model_id", "root_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and "Cartesian" not in plan


class Tables(Questions):
    def __init__(self, nodes):
        self.nodes = nodes


def test_an_ambiguous_name_is_an_error_when_it_runs(spark):
    nodes = spark.createDataFrame([("m", "1", "a.Book"), ("m", "2", "b.Book"), ("m", "3", "a.Shelf")], "model_id string, node_id string, concept string")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    found = Tables(nodes).nodes_of_short_concept("Book")
    assert len(tracker.getJobIdsForGroup(None)) == before  # no job before an action
    with pytest.raises(Exception, match="several concepts are called Book: a.Book, b.Book"):
        found.collect()
    assert [r.node_id for r in Tables(nodes).nodes_of_short_concept("Shelf").collect()] == ["3"]
    assert Tables(nodes).nodes_of_short_concept("None").count() == 0


def test_closure_of_more_parts_than_a_recursive_query_returns(spark, tmp_path):
    from sylvan.queries import QUERIES

    n = 120_000
    spark.range(n).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    want, above = 0, {}
    for k in range(n):
        above[k] = 0 if k < 4 else 1 + above[k // 4]
        want += above[k]
    assert want < 1_000_000  # at the session's limit of rows below
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1000")
    try:
        got = QUERIES["part_tree_closure"](spark, str(tmp_path))
        assert (got.count(), got.distinct().count()) == (want, want)
    finally:
        spark.conf.set(limit, before)
