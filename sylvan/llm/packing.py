"""Best-two-fit packing of token sequences.

Only lengths decide a packing, so the packing is made on the histogram of lengths (at most ``size`` numbers, whatever the input):
the longest length left opens a sequence, the longest that still fits is added until none does; then the smallest piece gives way to
two unpacked ones if these fill the gap it leaves more tightly.  The filled sequence is a pattern of lengths, used as often as the
counts allow, which leaves fewer pieces of one of its lengths than the pattern needs: patterns are few, whatever the input.  Pieces then take the places of their
length in the order of their rank among equals, which needs counts by task and length alone: no text and no row is shuffled.

Defined results: a null or empty text is one piece of the end id; longer documents than ``size`` are cut into pieces of ``size``, the
last may be shorter; repeated rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SIZE = 2048


def patterns(counts: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """counts[n]: pieces of length n.  Returns (lengths of a sequence in its order, how many such sequences).  A sequence of one piece keeps it."""
    left = np.array(counts, np.int64)
    left[0] = 0
    out = []
    while left.any():
        filled: list[int] = []
        free = left.copy()
        gap = size
        while gap and len(fit := np.flatnonzero(free[: gap + 1])):
            n = int(fit[-1])
            filled.append(n)
            free[n] -= 1
            gap -= n
        if gap and len(filled) > 1:
            small = filled[-1]
            room = gap + small
            at = np.flatnonzero(free[: room + 1])
            best, pair = small, None
            for a in at[::-1].tolist():  # the larger of the two; the other is the longest that still fits
                if 2 * a <= best:
                    break
                free[a] -= 1
                other = np.flatnonzero(free[: min(a, room - a) + 1])
                free[a] += 1
                if len(other) and a + int(other[-1]) > best:
                    best, pair = a + int(other[-1]), [a, int(other[-1])]
                    if best == room:
                        break
            if pair:
                filled[-1:] = pair
        own, need = np.unique(filled, return_counts=True)
        times = int((left[own] // need).min())
        left[own] -= need * times
        out.append((filled, times))
    return out


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, found: list[tuple[list[int], int]], size: int = SIZE):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for lengths, times in found:
            at = 0
            for n in lengths:
                by.setdefault(n, []).append((used.get(n, 0), base, at, 0))
                used[n] = used.get(n, 0) + times
                at += n
            base += times
        self.by = {n: np.asarray(rows, np.int64) for n, rows in by.items()}
        self.sequences = base

    def of(self, n: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.by[n]
        own = rows[np.searchsorted(rows[:, 0], ranks, "right") - 1]
        return own[:, 1] + ranks - own[:, 0], own[:, 2]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, own_rank long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Tasks that are counted together first, so that no sum over tasks is long.
TASK_BITS = 10


def _pieces(tokenizer: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        seen, task = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in common.parts(batches, "text", common.PART):
            ids, ends = tokens.with_end(*enc.encode(batch.column("text")), end_id)
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            each = -(-(ends - begins) // size)  # pieces of each document
            doc = np.repeat(np.arange(len(each)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * size
            length = np.minimum(size, (ends - begins)[doc] - start)
            raw, at = memoryview(ids.astype("<u4").tobytes()), (begins[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            run_of = length[order]
            first = np.flatnonzero(np.diff(run_of, prepend=-1))
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) + seen[run_of]
            seen += np.bincount(length, minlength=size + 1)
            columns = [batch.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), start, length, crc, np.full(len(doc), task, np.int32), rank]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64() if isinstance(c, list) else None) for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "own_rank"])
        enc.rest()

    return run


def _before(tallies: DataFrame) -> DataFrame:
    """For each task and length, how many pieces of that length earlier tasks have: sums by groups of tasks, then within a group."""
    own = tallies.withColumn("group", F.shiftright("task", TASK_BITS))
    groups = own.groupBy("length", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("far"))
    within = own.select("task", "length", "group", (F.sum("n").over(Window.partitionBy("length", "group").orderBy("task")) - F.col("n")).alias("near"))
    return within.join(groups.hint("merge"), ["length", "group"]).select("task", "length", (F.col("near") + F.col("far")).alias("before"))


def pack(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = scratch.table(common.documents(docs).mapInArrow(_pieces(tokenizer, end_id, size), _PIECE), "pieces")
    tallies = scratch.table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "tallies")
    counts = np.zeros(size + 1, np.int64)
    for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(Places(patterns(counts, size), size))  # bounded by the number of lengths, not of pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    sequence[at], offset[at] = places.value.of(int(length[at[0]]), ranks[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # The tallies grow with the tasks, so they are merged, not broadcast; only the pieces' numbers move.
    ranked = pieces.join(_before(tallies).hint("merge"), ["task", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own_rank") + F.col("before")).alias("rank")).mapInArrow(run, _PLACED)


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """sequence_id, ids array: the packed ids themselves, for training.  doc_id must be unique in docs."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            every, ends = tokens.with_end(*enc.encode(batch.column("text")), end_id)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(every.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "every"])
        enc.rest()

    own = common.documents(docs).mapInArrow(ids, "doc_id long, every array<int>")
    part = packed.join(own, "doc_id").select("sequence_id", "offset", F.slice("every", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))
    return part.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` and their places in sequences of at most 2048 ids."""
    return pack(spark, common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op4"), tokens.public_path())
