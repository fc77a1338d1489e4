import numpy as np
import pytest

from sylvan.llm import common, topk


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        own = sorted(((-int(np.floor(256 * np.asarray(x)) @ np.floor(256 * np.asarray(y))), i) for i, y in rows if i != q and len(y) == len(x)))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(own[:k], 1)]
    return sorted(out)


def found(spark, queries, table, k=5):
    scratch = common.Scratch(spark, "t")
    return topk.search(queries, topk.build(spark, table, scratch), k, scratch).collect()


@pytest.mark.parametrize("block, part", [(7, 3), (64, 11), (16384, 128)])
def test_same_as_all_pairs(spark, monkeypatch, block, part):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", part)
    r = np.random.default_rng(block)
    x = r.normal(size=(300, 8)) * r.choice([0.05, 1, 3], (300, 1))
    x[50:90] = x[50]
    x[100] = 0
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000, [0.5, 0.25]), (1001, [1.0, -1.0])]
    table = spark.createDataFrame([(*v, 3, "c") for v in rows], "vec_id long, embedding array<float>, rank int, score string")
    rows = [(v.vec_id, v.embedding) for v in table.collect()]
    got = found(spark, table.where("vec_id % 10 = 0"), table)
    assert sorted(map(tuple, got)) == brute(rows, [v for v in rows if v[0] % 10 == 0], 5)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0]), (10, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(spark, table, table)
    assert sorted(map(tuple, got)) == [(0, 1, 10, 5 * 65536), (0, 2, 10, 5 * 65536), (10, 1, 0, 5 * 65536)]
    none = table.where("false")
    assert found(spark, none, none) == []


def test_large_components_are_exact(spark):
    rows = [(2**53 + 1, [1e6, 1.0]), (2**53 + 3, [1e6, 1.0 + 1 / 256]), (3, [-1e6, 3.0]), (4, [1e300, 1.0]), (5, [2.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in found(spark, table, table)}
    x = {i: [min(int(np.floor(256 * v)), 2**53) for v in e] for i, e in rows}
    want = {(a, b): min(max(sum(p * q for p, q in zip(x[a], x[b])), -(2**63)), 2**63 - 1) for a in x for b in x if a != b}
    assert got == want
