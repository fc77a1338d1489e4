"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Vectors are integers, floor(256 * x).  They are indexed in blocks of ``BLOCK`` rows, dealt by id.  For every dimension a block has its rows
by descending value, in segments of one quantised impact (value // ``LEVEL``); a negative query component reads them from the other end.
A query reads segments by descending impact (|q| times the quantised value), one round after the other.  After each round R = sum of |q| *
last level bounds all that is unread, and the accumulator of a row is what it has above these levels: accumulator + R bounds its score, and
rows below the k-th best so far are proven out.  Reading stops as soon as no more than ``FEW`` of the block's rows are possible members, or
when R has come down to the last of ``DEPTHS`` times the k-th best; possible members are scored exactly.  Ties at the k-th place count as possible members.

Queries are written in parts of ``QUERY_ROWS``, and a task takes one part and up to ``BLOCKS`` index blocks, which it reads from the shared
folder; the k best of a query over all of its tasks are merged at last.  Nothing is broadcast but the names of the blocks, and no pair of rows is a row
of any table.  The k-th best so far carries over from block to block within a task.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; vectors of
other lengths than the query's are no candidates for it; a query's own row is left out, and any other row with the same id too; fewer
candidates than k give fewer rows; repeated candidate rows each have a place, and repeated query rows one result together; scores are exact
whatever their size, but for components beyond 2**53, which count as that, and scores beyond a long, which are given as its end; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 16_384
LEVEL = 16
#: Of the k-th best score: what the unread part may be after each round.  Below 0, what takes a row's score down has been read in part too.
DEPTHS = (0.4, -2.0)
#: Of a block's rows: how many may be left for reading to stop.
FEW = 0.05
#: Queries of a part, and blocks of a task; tasks for each core at least, where there are so many blocks.
QUERY_ROWS = 128
BLOCKS = 16
TASKS = 3
#: Components are cut there; sums below it are exact as floats.
EXACT = 1 << 53


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(uri: str):
    reader = common.RangeReader(uri)
    raw = reader.read(0, reader.size())
    reader.close()
    return np.load(io.BytesIO(raw))


class Block:
    """Rows, and for each dimension their order by descending value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(-x.T, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x.T, self.order, axis=1)

    def save(self) -> bytes:
        return _saved(ids=self.ids, x=self.x, order=self.order, values=self.values)

    @classmethod
    def load(cls, uri: str) -> Block:
        out, got = cls.__new__(cls), _loaded(uri)
        out.ids, out.x, out.order, out.values = got["ids"], got["x"], got["order"], got["values"]
        out.most = int(np.abs(out.x.astype(np.int64)).max(initial=0))
        out.places, out.real = out.order.astype(np.intp), out.values.astype(float)
        out.edges = [[cls._edges(row) for row in side] for side in (out.values, -out.values[:, ::-1])]  # a negative component reads from the other end
        return out

    @staticmethod
    def _edges(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantised impacts by descending value, and where each one's segment begins."""
        level = row // LEVEL
        first = np.flatnonzero(np.diff(level, prepend=level[0] + 1))
        return level[first].astype(np.int64), np.append(first, len(row))

    def _depth(self, q: np.ndarray, impact: float) -> np.ndarray:
        """The level of each dimension down to which impacts of at least ``impact`` go."""
        size = np.abs(q)
        with np.errstate(divide="ignore"):
            return np.where(size > 0, np.ceil(impact / np.maximum(size, 1) / LEVEL), 0).astype(np.int64)

    def _bounded(self, q: np.ndarray, bound: float) -> np.ndarray:
        """The deepest levels that are needed for an unread bound of at most ``bound``."""
        size = np.abs(q)
        low, high = -2.0 * (np.abs(self.x).max(initial=1) + LEVEL) * max(size.max(), 1), 2.0 * (np.abs(self.x).max(initial=1) + LEVEL) * max(size.max(), 1)
        for _ in range(24):
            middle = (low + high) / 2
            low, high = (middle, high) if (size * self._depth(q, middle) * LEVEL).sum() <= bound else (low, middle)
        return self._depth(q, low)

    def above(self, q: np.ndarray, level: np.ndarray) -> np.ndarray:
        """What each row has above the levels, from segments by descending impact."""
        rows, gains, n = [], [], len(self.ids)
        for d in np.flatnonzero(q).tolist():
            levels, first = self.edges[int(q[d] < 0)][d]
            b = int(first[np.searchsorted(-levels, -level[d], "right")])  # all segments from the highest down to the level
            if not b:
                continue
            if q[d] < 0:
                rows.append(self.places[d, n - b :])
                gains.append((self.real[d, n - b :] + float(level[d] * LEVEL)) * float(q[d]))
            else:
                rows.append(self.places[d, :b])
                gains.append((self.real[d, :b] - float(level[d] * LEVEL)) * float(q[d]))
        if not rows:
            return np.zeros(n)
        return np.bincount(np.concatenate(rows), weights=np.concatenate(gains), minlength=n)

    def possible(self, q: np.ndarray, least: float) -> np.ndarray:
        """Rows that aren't proven to score less."""
        n = len(self.ids)
        if least == -np.inf or int(np.abs(q).max(initial=0)) * self.most * len(q) >= EXACT // 4:  # bounds would be rounded
            return np.arange(n)
        for depth in DEPTHS:
            level = self._bounded(q, depth * least if least > 0 else least)
            unread = float((np.abs(q) * level * LEVEL).sum())
            rows = np.flatnonzero(self.above(q, level) + unread >= least)
            if len(rows) <= FEW * n or least <= 0:
                break
        return rows

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bound = int(np.abs(q).max(initial=0)) * self.most * len(q)
        if bound < EXACT:
            return (self.x[rows].astype(float) @ q.astype(float)).astype(np.int64)
        if bound < 1 << 63:
            return (self.x[rows].astype(np.int64) * q).sum(axis=1)
        return np.asarray([min(max(sum(a * b for a, b in zip(x, q.tolist())), -(1 << 63)), (1 << 63) - 1) for x in self.x[rows].tolist()], np.int64)


class Best:
    """The k best of one query so far."""

    def __init__(self, vec_id: int, q: np.ndarray, k: int):
        self.vec_id, self.q, self.k = vec_id, q.astype(np.int64), k
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = ids != self.vec_id
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores[keep]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def search(self, block: Block) -> int:
        """Take what the block has; returns how many rows were scored exactly."""
        q, scored = self.q, 0
        if len(block.ids) <= 4 * self.k + 1:
            self.offer(block.ids, block.exact(q, np.arange(len(block.ids))))
            return len(block.ids)
        least = self.least()
        if least == -np.inf and int(np.abs(q).max(initial=0)) * block.most * len(q) < EXACT // 4:  # a first threshold: exact scores of the rows with most above a shallow depth
            probe = Best(self.vec_id, q, self.k)
            got = block.above(q, block._bounded(q, 0.5 * float(np.abs(q) @ np.abs(block.x).max(axis=0).astype(np.int64))))
            rows = np.argpartition(-got, 4 * self.k)[: 4 * self.k + 1]
            probe.offer(block.ids[rows], block.exact(q, rows))
            least = probe.least()
        rows = block.possible(q, least)
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            self.offer(block.ids[part], block.exact(q, part))
            scored += len(part)
        return scored


def _quantise(values: pd.Series) -> np.ndarray:
    x = np.clip(np.floor(256 * np.asarray(values.tolist(), float)), -EXACT, EXACT)
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 14 else np.int32 if most < 1 << 30 else np.int64)


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, embedding, size of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    inf = F.lit(float("inf"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(sound).withColumn("size", F.size("x"))


def _write(folder: str, most: int, indexed: bool):
    """Rows of one length, ``most`` at a time, to files: index blocks, or parts of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def out(size: int, rows: pd.DataFrame) -> pd.DataFrame:
            uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.npz"
            ids, x = rows["vec_id"].to_numpy(np.int64), _quantise(rows["x"])
            n = common.write_file(uri, iter([Block(ids, x).save() if indexed else _saved(ids=ids, x=x)]))
            return pd.DataFrame({"uri": [uri], "size": [size], "rows": [len(rows)], "bytes": [n]})

        for pdf in batches:
            for size, own in pdf.groupby("size"):
                parts = held.setdefault(int(size), [])
                parts.append(own)
                while sum(map(len, parts)) >= most:
                    rows = pd.concat(parts)
                    yield out(int(size), rows[:most])
                    parts[:] = [rows[most:]]
        for size, parts in held.items():
            if len(rows := pd.concat(parts)):
                yield out(size, rows)

    return run


_FILES = "uri string, size int, rows long, bytes long"


def build(spark: SparkSession, rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Write the index below the scratch folder; returns its manifest (uri, size, rows, bytes)."""
    slim = vectors(rows).repartition(common.partitions(spark), F.xxhash64("vec_id"))
    return scratch.table(common.map_frames(slim, _write(scratch.path("blocks"), BLOCK, True), _FILES), "manifest")


def search(queries: DataFrame, manifest: DataFrame, k: int, scratch: common.Scratch) -> DataFrame:
    """query_id, rank, vec_id, score for every query row that takes part."""
    spark = queries.sparkSession
    by_size: dict[int, list[str]] = {}
    for r in manifest.select("size", "uri").collect():  # a row for each block file
        by_size.setdefault(r["size"], []).append(r["uri"])
    asked = vectors(queries).dropDuplicates(["vec_id", "x"]).repartition(common.partitions(spark), F.xxhash64("vec_id"))
    parts = scratch.table(common.map_frames(asked, _write(scratch.path("queries"), QUERY_ROWS, False), _FILES), "parts")
    n_parts, blocks = parts.count(), max(map(len, by_size.values()), default=1)
    groups = min(blocks, max(-(-blocks // BLOCKS), -(-TASKS * spark.sparkContext.defaultParallelism // max(n_parts, 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, size, group in zip(pdf["uri"], pdf["size"], pdf["group"]):
                part = _loaded(uri)
                best = [Best(int(i), q, k) for i, q in zip(part["ids"], part["x"])]
                for block_uri in sorted(by_size.get(int(size), []))[group::groups]:
                    block = Block.load(block_uri)
                    for b in best:
                        b.search(block)
                rows = [(b.vec_id, int(i), int(s)) for b in best for i, s in zip(b.ids, b.scores)]
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    tasks = parts.select("uri", "size", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).repartition(max(1, n_parts * groups))
    found = common.map_frames(tasks, run, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows a group of blocks
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all ``embeddings`` for every vec_id divisible by 50."""
    rows = common.read(spark, sf_dir, "embeddings")
    scratch = common.Scratch(spark, "op8")
    return search(rows.where("vec_id % 50 = 0"), build(spark, rows, scratch), 5, scratch)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
