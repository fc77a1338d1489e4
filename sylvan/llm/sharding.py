"""Minimax contiguous sharding, in DataFrame functions alone.

Equal texts stay together: their groups, ordered by a hash of the text, are the atomic sizes.  The driver sees sums over ranges of the hash,
at first ``1 << CELL_BITS`` of them, and binary-searches the smallest capacity for which filling shards greedily needs no more than the
shards there are.  A range isn't cut while it is known as a sum alone, so that capacity is an upper bound; if ranges could be cut anywhere,
the search would give a lower one.  Ranges in which a cut may lie for any capacity between the two are split further, the largest
``SPLIT`` of them by ``SPLIT_BITS`` more bits at a time, until the bounds meet or all such ranges are single groups.  So the capacity is the
smallest for the groups themselves, and what the driver holds is bounded, whatever the input.

Slots are counted without gathering a shard in one task: rows are sorted by range over (hash, doc_id), so that even the rows of one
huge group are dealt to many tasks, and each task's first row of each shard gets the number of that shard's rows in earlier tasks.

Law: ``bytes`` (sizes near equal).  Defined results: a null text has size 1, crc32 0, and goes with the empty texts; repeated rows each
have a slot of their own; null doc_ids sort first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 16
CELL_BITS = 16
SPLIT = 256
SPLIT_BITS = 8
#: Of monotonically_increasing_id(): the bits that count rows within a partition.
ROW_BITS = 33


class Range(NamedTuple):
    """The hashes whose first ``bits`` bits are ``key``, and the bytes of their texts."""

    first: int
    bits: int
    key: int
    size: int
    single: bool


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """ends: running sums of the atomic sizes.  The number of atoms up to the end of each shard, or None if the shards don't hold all."""
    cuts, at, full = [], 0, 0
    for _ in range(shards):
        at = bisect.bisect_right(ends, full + capacity, lo=at)
        full = ends[at - 1] if at else 0
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity of contiguous shards over ordered atomic sizes, and the cuts it gives."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0, [0] * shards
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low, greedy_cuts(ends, low, shards)


def reach(ends: list[int], single: list[bool], capacity: int, shards: int, loose: bool) -> list[int]:
    """Bytes before the end of each shard by greedy filling.  Ranges of several groups are cut nowhere or, with ``loose``, anywhere."""
    out, full = [], 0
    for _ in range(shards):
        at = bisect.bisect_right(ends, full + capacity)
        inside = loose and at < len(ends) and not single[at]
        full = full + capacity if inside else max(full, ends[at - 1] if at else 0)
        out.append(full)
    return out


def unsettled(ranges: list[Range], shards: int) -> tuple[list[int], list[Range]]:
    """The best cuts between ranges, and the ranges that would have to be split to know better ones."""
    sizes, single = [r.size for r in ranges], [r.single for r in ranges]
    high, cuts = minimax_cuts(sizes, shards)
    ends = list(accumulate(sizes))
    if not ends:
        return cuts, []
    low, most = max([r.size for r in ranges if r.single] + [-(-ends[-1] // shards)]), high
    while low < most:
        middle = (low + most) // 2
        if reach(ends, single, middle, shards, True)[-1] >= ends[-1]:
            most = middle
        else:
            low = middle + 1
    if low == high:
        return cuts, []
    least, furthest = reach(ends, single, low, shards, False), reach(ends, single, high, shards, True)
    found: set[int] = set()
    for a, b in zip(least[:-1], furthest[:-1]):
        # Ranges that end after a and begin before b.
        found.update(range(bisect.bisect_right(ends, a), min(len(ends), bisect.bisect_left(ends, b) + 1)))
    return cuts, [ranges[k] for k in sorted(found) if not single[k]]


def _sums(slim: DataFrame, bits: int) -> list[Range]:
    """The ranges of so many bits that have rows: a row for each."""
    by = slim.groupBy(F.shiftright("h", 64 - bits).alias("key")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
    return [Range(r["key"] << (64 - bits), bits, r["key"], r["size"], r["low"] == r["high"]) for r in by.collect()]


def boundaries(slim: DataFrame, shards: int) -> list[int]:
    """The least hash of shards 1, 2, ... (fewer, if the last are empty), from rows (h, size)."""
    ranges = sorted(_sums(slim, CELL_BITS))
    while True:
        cuts, todo = unsettled(ranges, shards)
        if not todo:
            return [ranges[c].first for c in cuts if c < len(ranges)]
        todo = set(sorted(todo, key=lambda r: -r.size)[:SPLIT])
        ranges = [r for r in ranges if r not in todo]
        for bits in sorted({r.bits for r in todo}):
            ranges += _sums(slim.where(F.shiftright("h", 64 - bits).isin([r.key for r in todo if r.bits == bits])), min(64, bits + SPLIT_BITS))
        ranges.sort()


def shard(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    slim = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h")), "slim")
    of = sum((F.when(F.col("h") >= h, 1).otherwise(0) for h in boundaries(slim, shards)), F.lit(0))
    keys = [F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    ordered = slim.withColumn("shard", of).repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys)
    ordered = scratch.table(ordered.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "ordered")
    scratch.drop("slim")
    ordered = ordered.withColumn("task", F.shiftright("at", ROW_BITS))
    tallies = sorted((r["shard"], r["task"], r["low"], r["n"]) for r in ordered.groupBy("shard", "task").agg(F.min("at").alias("low"), F.count("*").alias("n")).collect())  # tasks + shards rows at most
    bases, seen, last = [], 0, None
    for own, task, low, n in tallies:
        seen = seen if own == last else 0
        bases.append((own, task, seen - low))
        seen, last = seen + n, own
    base = F.broadcast(spark.createDataFrame(bases, "shard int, task long, base long"))
    return ordered.join(base, ["shard", "task"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("base")).alias("slot"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards of near equal bytes, equal texts together."""
    out = shard(spark, common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op7"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
