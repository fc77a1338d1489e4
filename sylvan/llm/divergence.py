"""How far the sources of a language differ in their words, by integer-dictionary encoding.

1. Tasks count terms by (lang, source) and send on sums, not words; a term's rows meet by (lang, source, term), so no hot term or source is
   one task's.  What a language keeps (``LEAST`` documents or more) is a table sorted by (lang, term), dealt by ranges.
2. A task goes along its range block by block: the block's kept terms are a sorted array, whose places are the ids (``searchsorted``), and
   each group's counts become a dense vector over a chunk of ids (``bincount``).  As ids keep the order of UTF-8, ties between terms are
   ties between ids.  A chunk has as many ids as leave ``CELLS`` numbers for all groups of its language, so memory is bounded.
3. Chunks give partial sums of each pair of sources and their own best terms; Spark adds and ranks these.

Totals of groups are read by the tasks from the shared folder, language by language; nothing is collected or broadcast.

All arithmetic is on whole numbers: 1e9 * a / b is divided in three steps of a thousand, exact as long as a language has fewer than 9e15
occurrences.

Defined results: null text, lang and source count as ''; repeated rows are documents of their own; a text without terms still makes its
group occur; a language without kept terms gives all its pairs with 0; a language of one source gives no pairs; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST = 10
TOP = 10
SCALE_STEPS = 3
#: Distinct terms that a task holds before it sends their counts on; rows of a block; numbers of a dense chunk; groups up to which a task adds up pairs by itself.
HELD = 200_000
BLOCK_ROWS = 1 << 16
CELLS = 1 << 20
SUMMED = 1024

#: A-Z in lower case; all other bytes that are in no term are blanks.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A-Z, a-z and characters beyond ASCII of a UTF-8 text, A-Z in lower case."""
    return text.translate(_TABLE).split()


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sums() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            own = [None, *n]  # the row without a term says that the group occurs
            size = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size), pa.array([source] * size), pa.array(own, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    size = 0
    for batch in common.parts(batches, "text", common.PART):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _binary(batch.column("text")).to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            own = terms(text)
            n.update(own)
            docs.update(set(own))
            size += len(n)
        if size > HELD:
            yield from sums()
            held.clear()
            size = 0
    yield from sums()
    held.clear()
    common.give_back()


def kept_terms(docs: DataFrame, scratch: common.Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, term, n) of kept terms, and totals (lang, source, total, vocabulary) of every group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    counts = counts.select("*", F.sum("docs").over(own).alias("_docs"), (F.col("source") == F.min("source").over(own)).alias("once"))
    kept = scratch.table(counts.where(F.col("term").isNull() | (F.col("_docs") >= least)).select("lang", "source", "term", "n", "once"), "kept")
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("once") & F.col("term").isNotNull()).alias("once"))
    size = total.groupBy("lang").agg(F.sum("once").alias("vocabulary"))
    return kept.where("term is not null").select("lang", "source", "term", "n"), scratch.table(total.join(size, "lang").select("lang", "source", "total", "vocabulary"), "totals")


def scaled(n: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(1e9 * n / whole) for 0 <= n <= whole < 9e15."""
    out, rest = np.divmod(n, whole)
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


class _Language:
    """The groups of one language, in the order of their names."""

    def __init__(self, name: str, uri: str, cells: int, summed: int):
        filesystem, path = common._fs(uri)
        rows = pads.dataset(path, filesystem=filesystem, format="parquet").to_table(filter=pads.field("lang") == name)
        order = sorted((s, t, v) for s, t, v in zip(*(rows.column(c).to_pylist() for c in ("source", "total", "vocabulary"))))
        self.name, self.sources = name, [s for s, _, _ in order]
        self.place = {s: k for k, s in enumerate(self.sources)}
        total = np.asarray([t for _, t, _ in order], np.int64)
        self.whole = (total + 2 * order[0][2])[:, None]
        self.all = int(total.sum()) + 2 * order[0][2]
        size = len(order)
        self.sums = np.zeros((size, size), np.int64) if size <= summed else None
        self.width = max(1, cells // size)


def _divergence(uri: str, top: int, block_rows: int, cells: int, summed: int):
    """From rows sorted by (lang, term): partial sums of pairs (rank 0), and candidates for the best terms."""

    names = ["lang", "source", "part", "item", "value"]

    def rows(lang: _Language, part: str, source: list[int], item: list[bytes], value: np.ndarray) -> pa.RecordBatch:
        size = len(source)
        return pa.RecordBatch.from_arrays([pa.array([lang.name] * size, pa.string()), pa.array([lang.sources[k] for k in source], pa.string()), pa.array([part] * size, pa.string()), pa.array(item, pa.binary()), pa.array(value, pa.int64())], names)

    def pairs(lang: _Language, first: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of sources first, first + 1, ... with those behind each, both ways round."""
        for a, own in enumerate(sums, first):
            others = [k for k in range(len(lang.sources)) if k != a]
            yield rows(lang, "pair", [a] * len(others), [lang.sources[k].encode("utf-8", "surrogatepass") for k in others], own[others])

    def chunk(lang: _Language, kept: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        p = scaled(counts + 2, lang.whole)
        q = scaled(counts.sum(axis=0) + 2, lang.all)
        for a in range(len(p)):
            if lang.sums is None:
                yield from pairs(lang, a, apart(p[a], p).sum(axis=1)[None, :])
            elif a + 1 < len(p):
                own = apart(p[a], p[a + 1 :]).sum(axis=1)
                lang.sums[a, a + 1 :] += own
                lang.sums[a + 1 :, a] += own
        far, source, at = np.where((counts > 0) & (p > q), apart(p, q), -1), [], []
        for a, own in enumerate(far):
            best = np.argsort(-own, kind="stable")[:top]  # of equal ones the smallest id
            best = best[own[best] >= 0]
            source += [a] * len(best)
            at += best.tolist()
        if source:
            yield rows(lang, "term", source, kept[at].tolist(), far[source, at])

    def block(lang: _Language, table: pa.Table) -> Iterator[pa.RecordBatch]:
        term = np.empty(table.num_rows, object)
        term[:] = table.column("term").to_pylist()
        kept = np.unique(term)  # the dictionary: sorted, so that ids keep the order
        ids = np.searchsorted(kept, term)
        source = np.asarray([lang.place[s] for s in table.column("source").to_pylist()], np.int64)
        n = table.column("n").to_numpy()
        for at in range(0, len(kept), lang.width):
            width = min(lang.width, len(kept) - at)
            own = slice(*np.searchsorted(ids, [at, at + width]))
            # counts stay whole numbers: below 2**53 a sum of floats is exact
            counts = np.bincount(source[own] * width + ids[own] - at, weights=n[own], minlength=len(lang.sources) * width).astype(np.int64)
            yield from chunk(lang, kept[at : at + width], counts.reshape(len(lang.sources), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held, size = None, [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """All that is held but for the last term, which may go on, unless these are the last rows."""
            nonlocal lang, held, size
            table = pa.Table.from_batches(held)
            langs, term = table.column("lang").to_pylist(), table.column("term").to_pylist()
            end = len(term)
            if not last:
                while end and (langs[end - 1], term[end - 1]) == (langs[-1], term[-1]):
                    end -= 1
            at = 0
            while at < end:
                stop = at + 1
                while stop < end and langs[stop] == langs[at]:
                    stop += 1
                if lang is None or lang.name != langs[at]:
                    if lang is not None and lang.sums is not None:
                        yield from pairs(lang, 0, lang.sums)
                    lang = _Language(langs[at], uri, cells, summed)
                yield from block(lang, table.slice(at, stop - at))
                at = stop
            rest = table.slice(end)
            held, size = rest.to_batches(), rest.num_rows

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block_rows:
                yield from blocks(False)
        if size:
            yield from blocks(True)
        if lang is not None and lang.sums is not None:
            yield from pairs(lang, 0, lang.sums)
        common.give_back()

    return run


def divergence(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, least: int = LEAST, top: int = TOP, block_rows: int = BLOCK_ROWS, cells: int = CELLS, summed: int = SUMMED) -> DataFrame:
    """lang, source, part, item, value, rank: for each source all others of its language (``pair``), and the terms that mark it (``term``)."""
    kept, totals = kept_terms(docs, scratch, least)
    ranged = kept.repartitionByRange(common.partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    found = scratch.table(ranged.mapInArrow(_divergence(scratch.path("totals"), top, block_rows, cells, summed), "lang string, source string, part string, item binary, value long"), "found")
    found = found.withColumn("item", F.col("item").cast("string"))
    bare = totals.where("vocabulary = 0")  # languages without terms: their pairs are part of the result, with 0
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    marks = found.where("part = 'term'").select("lang", "source", "item", "value", F.row_number().over(by).alias("rank")).where(F.col("rank") <= top)
    pairs = pairs.select("lang", "source", "item", "value", F.row_number().over(by).alias("rank"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*order).unionByName(marks.withColumn("part", F.lit("term")).select(*order))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all ``documents``."""
    return divergence(spark, common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op11"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT g.lang, g.source, coalesce(max(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 2)) // (w.n + 2 * v.v) AS q FROM l JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY 1) w USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
m AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM o
UNION ALL
SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM m QUALIFY rank <= 10
"""
