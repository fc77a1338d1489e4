import random
import zlib
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm import common, sharding
from tests.llm import odd


def brute(sizes, shards):
    """Smallest largest shard over all contiguous partitions."""
    best = [0, *accumulate(sizes)]
    for _ in range(shards - 1):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14), st.integers(1, 5))
def test_capacity_is_minimal(sizes, shards):
    capacity, cuts = sharding.minimax_cuts(sizes, shards)
    assert capacity == (brute(sizes, shards) if sizes else 0)
    assert cuts == sorted(cuts) and cuts[-1] == len(sizes) and len(cuts) == shards


def test_shards_keep_equal_texts_together_and_slots_gapless(spark):
    docs = odd.docs(spark, [f"text {i % 37} " * (i % 11) for i in range(400)] + ["hot"] * 300 + [None])
    rows = sharding.shard(spark, docs, common.Scratch(spark, "t")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == 701 and len({r.doc_id for r in rows}) == 701
    of = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert of.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < 16
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


@pytest.mark.parametrize("bits, split, more", [(2, 2, 1), (3, 1, 2), (16, 256, 8)])
def test_largest_shard_is_the_smallest_that_whole_groups_allow(spark, monkeypatch, bits, split, more):
    for name, value in (("CELL_BITS", bits), ("SPLIT", split), ("SPLIT_BITS", more)):
        monkeypatch.setattr(sharding, name, value)
    r = random.Random(bits)
    for hot in (0, 40):
        texts = [f"{k} " + "x" * r.randrange(60) for k in range(25) for _ in range(r.choice([1, 1, 1, 2, 6]))] + ["hot " * 9] * hot
        rows = sharding.shard(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), common.Scratch(spark, "t"), shards=5)
        hashed = rows.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").selectExpr("shard", "size", "xxhash64(encode(text, 'UTF-8')) as h").collect()
        groups = {}
        for x in hashed:
            groups[x.h] = groups.get(x.h, 0) + x.size
        shards = {}
        for x in hashed:
            shards[x.shard] = shards.get(x.shard, 0) + x.size
        assert max(shards.values()) == brute([groups[h] for h in sorted(groups)], 5)


def test_whole_ids_beside_a_null(spark):
    rows = spark.createDataFrame([(2**53 + 1, "a"), (2**53 + 3, None), (None, "a")], "doc_id long, text string")
    assert {r.doc_id for r in sharding.shard(spark, rows, common.Scratch(spark, "t")).collect()} == {2**53 + 1, 2**53 + 3, None}


def test_odd_tables(spark):
    assert sharding.shard(spark, odd.docs(spark), common.Scratch(spark, "t")).count() == len(odd.TEXTS) + 2
    assert sharding.shard(spark, odd.empty(spark), common.Scratch(spark, "t")).count() == 0
