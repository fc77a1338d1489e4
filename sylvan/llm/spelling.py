"""Spelling variants: words one inserted, deleted or replaced code point apart, by two-dimensional range reporting on wavelet trees.

1. Tasks count words; Spark adds the counts and keeps words of ``LONG`` code points and ``TIMES`` occurrences or more.
2. Two words that are near share their first ``HEAD`` code points, where the edit is behind these, or else their last ``TAIL``.  So words meet by
   head for edits from place ``HEAD`` on, and by tail for edits before it.  A group is dealt in tiles of at most ``BLOCK`` words that are searched
   and ``BLOCK`` that search, so that a common head is not one task's.
3. In a tile the searched words of each length stand in forward order and in the order of their reversed forms; a wavelet tree maps places
   of the first to places of the second.  A searching word's edit at place p is a prefix, an interval of the forward order, and a suffix, an
   interval of the reverse order: the words in both are reported.  A replacement looks among words of its own length, an insertion among those
   one longer; deletions are insertions seen from the other word.  An insertion that several places explain counts at the first of them.
4. Each pair is reported once, and a task sends on, for each word, how many near words it has and the commonest of them.
5. Forms are followed to the last by doubling: each form occurs twice as often at least, so the rounds grow as the logarithm of a logarithm.

Defined results: null and empty texts have no words; rows without an id count with an empty id; repeated rows count again; an empty table gives
an empty result; other columns are ignored.  Words have one byte a code point in Latin-1, so byte order is code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LONG, TIMES = 5, 3
#: Code points that words share before or behind an edit; for words of LONG code points or more one of the two holds.
HEAD, TAIL = 2, LONG - 2
#: Distinct words that a task holds before it sends their counts on; words on each side of a tile; searches that are done at once.
HELD = 200_000
BLOCK = 1 << 15
AT_ONCE = 1 << 15
#: One run in so many has a code point deleted.
NOISE = 97

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF as Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()  # what Latin-1 lacks becomes a question mark


def _noisy(run: bytes, start: int) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def sums() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in common.parts(batches, "text", common.PART):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(runs(text)).items():
                if len(run) >= LONG:
                    word = _noisy(run, start)  # the same for all of a document's equal runs
                    if len(word) >= LONG:
                        held[word] += n
        if len(held) > HELD:
            yield sums()
            held.clear()
    yield sums()
    held.clear()
    common.give_back()


class Wavelet:
    """A permutation, for reports of all its places in [lo, hi) whose values are in [low, high): a bit vector with ranks for each bit of a value."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(self.size - 1).bit_length())
        self.ones, self.zeros = [], []
        own = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (own >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(own) - bit.sum()))
            own = np.concatenate([own[bit == 0], own[bit == 1]])  # level by level, all zeros before all ones

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(search, value) of every hit, for many searches at once."""
        search = np.flatnonzero((lo < hi) & (low < high))
        lo, hi, low, high = lo[search], hi[search], low[search], high[search]
        first = np.zeros(len(search), np.int64)  # the least value below the node
        for k in range(self.bits):
            half = 1 << (self.bits - 1 - k)
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[lo], ones[hi]
            left, right = (lo - a, hi - b), (zeros + a, zeros + b)
            goes_left = (left[0] < left[1]) & (low < first + half)
            goes_right = (right[0] < right[1]) & (high > first + half)
            pick = lambda x, y: np.concatenate([x[goes_left], y[goes_right]])
            lo, hi = pick(left[0], right[0]), pick(left[1], right[1])
            search, low, high = pick(search, search), pick(low, low), pick(high, high)
            first = pick(first, first + half)
            inside = (first + half > low) & (first < high)
            lo, hi, search, low, high, first = (x[inside] for x in (lo, hi, search, low, high, first))
        return search, first


class Class:
    """Searched words of one length: both orders, and the tree from one to the other."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, length: int):
        order = np.argsort(words, kind="stable")
        self.length, self.words, self.ids = length, words[order], ids[order]
        back = _reversed(self.words, length)
        by_back = np.argsort(back, kind="stable")
        self.back = back[by_back]
        self.at = by_back  # place in reverse order -> place in forward order
        place = np.empty(len(order), np.int64)
        place[by_back] = np.arange(len(order))
        self.tree = Wavelet(place)

    def starting(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the forward order that begin with the words' first n code points."""
        return _interval(self.words, words, n, self.length)

    def ending(self, back: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of the reverse order, for reversed words."""
        return _interval(self.back, back, n, self.length)


def _letters(words: np.ndarray, length: int) -> np.ndarray:
    return np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1)[:, :length]


def _reversed(words: np.ndarray, length: int) -> np.ndarray:
    return np.ascontiguousarray(_letters(words, length)[:, ::-1]).view(f"S{length}").reshape(-1)


def _interval(order: np.ndarray, words: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    if n == 0:
        return np.zeros(len(words), np.int64), np.full(len(words), len(order), np.int64)
    own, place = np.unique(np.ascontiguousarray(_letters(words, n)).view(f"S{n}").reshape(-1), return_inverse=True)  # many words share a prefix
    high = np.full((len(own), length), 0xFF, np.uint8)  # no word has more than length code points, and none is above these
    high[:, :n] = _letters(own, n)
    return np.searchsorted(order, own.astype(f"S{length}"))[place], np.searchsorted(order, high.view(f"S{length}").reshape(-1), "right")[place]


def near(searched: list[bytes], searching: list[bytes], places: range | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places (searching, searched) of pairs one edit apart, and whether the searched word is the longer one (else they're of one length).

    Only edits at ``places``.  A pair of one length comes from either side, a longer searched word from the shorter one.
    """
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(searched):
        by_length.setdefault(len(w), []).append(k)
    classes = {n: Class(np.asarray([searched[k] for k in own], f"S{n}"), np.asarray(own, np.int64), n) for n, own in by_length.items()}
    asked: dict[int, list[int]] = {}
    for k, w in enumerate(searching):
        asked.setdefault(len(w), []).append(k)
    for n, own in asked.items():
        for longer in (0, 1):
            there = classes.get(n + longer)
            if there is None:
                continue
            for first in range(0, len(own), AT_ONCE):
                ids = np.asarray(own[first : first + AT_ONCE], np.int64)
                words = np.asarray([searching[k] for k in ids.tolist()], f"S{n}")
                letters, back = _letters(words, n), _reversed(words, n)
                for p in range(n + longer) if places is None else range(min(places.start, n + longer), min(places.stop, n + longer)):
                    lo, hi = there.starting(words, p)
                    low, high = there.ending(back, n + longer - 1 - p)
                    which, place = there.tree.report(lo, hi, low, high)
                    hit = there.at[place]
                    other = np.ascontiguousarray(there.words).view(np.uint8).reshape(-1, n + longer)[hit, p]
                    if longer:  # at the first place that explains it
                        keep = other != letters[which, p - 1] if p else np.ones(len(which), bool)
                    else:
                        keep = other != letters[which, p]
                    yield ids[which[keep]], there.ids[hit[keep]], bool(longer)


class _Best:
    """For each word of a tile: how many near words it has, and the commonest of them, the first of equals."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.words, self.n = words, n
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank, -n))
        self.by_place = order
        self.place = np.empty(len(words), np.int64)  # 0: the commonest
        self.place[order] = np.arange(len(words))
        self.count = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words), np.int64)

    def add(self, word: np.ndarray, other: np.ndarray) -> None:
        self.count += np.bincount(word, minlength=len(self.count))
        np.minimum.at(self.best, word, self.place[other])

    def rows(self) -> pa.RecordBatch:
        hit = np.flatnonzero(self.count)
        best = self.by_place[self.best[hit]]
        text = lambda ks: pa.array([self.words[k].decode("latin-1") for k in ks.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([text(hit), pa.array(self.count[hit]), text(best), pa.array(self.n[best])], ["word", "n_near", "form", "form_n"])


def _tile(table: pa.Table) -> pa.RecordBatch:
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n, role = table.column("n").to_numpy(), table.column("role").to_numpy()
    searched, searching = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    places = range(HEAD, 1 << 40) if table.column("side")[0].as_py() == 0 else range(HEAD)
    best = _Best(words, n)
    for one, other, longer in near([words[k] for k in searched.tolist()], [words[k] for k in searching.tolist()], places):
        best.add(searching[one], searched[other])
        if longer:
            best.add(searched[other], searching[one])
    return best.rows()


_TILE = ["side", "key", "i", "j"]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile; a tile's rows are held together, at most twice BLOCK or so."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _TILE)))
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            if keys[at] != now and held:
                yield _tile(pa.Table.from_batches(held))
                held = []
            now = keys[at]
            held.append(batch.slice(at, stop - at))
            at = stop
    if held:
        yield _tile(pa.Table.from_batches(held))
    common.give_back()


def words(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n of all words of ``LONG`` code points or more that occur ``times`` times or more."""
    return common.documents(docs).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _dealt(kept: DataFrame, block: int) -> DataFrame:
    """Rows (word, n, side, key, i, j, role) of the tiles; role: 1 is searched, 2 searches, 3 both."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, HEAD).alias("key")), F.struct(F.lit(1).alias("side"), F.expr(f"right(word, {TAIL})").alias("key")))
    rows = kept.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.side", "e.key")
    size = rows.groupBy("side", "key").agg(F.count("*").alias("size"))
    # Groups are few: keys of three of 90 letters at most, so no more than 90**3 + 90**2 rows are broadcast.
    large = size.where(F.col("size") > block).select("side", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(large), ["side", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    every, at = F.sequence(F.lit(0), F.col("blocks") - 1), lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    searched = F.transform(every, lambda j: at(F.col("own"), j, F.when(j == F.col("own"), 3).otherwise(1)))
    searching = F.transform(F.filter(every, lambda i: i != F.col("own")), lambda i: at(i, F.col("own"), F.lit(2)))
    return rows.select("word", "n", "side", "key", F.explode(F.concat(searched, searching)).alias("t")).select("word", "n", "side", "key", "t.i", "t.j", "t.role")


def _roots(forms: DataFrame, scratch: common.Scratch) -> DataFrame:
    """word, root: forms followed to the last.  Each round doubles the steps taken."""
    now, k = scratch.table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots-0"), 0
    while not now.where("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        now, k = scratch.table(moved, f"roots-{k + 1}"), k + 1
        scratch.drop(f"roots-{k - 1}")
    return now.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every kept word."""
    kept = scratch.table(words(docs, times), "words")
    tiles = _dealt(kept, block).repartition(common.partitions(spark), *_TILE).sortWithinPartitions(*_TILE)
    found = tiles.mapInArrow(_tiles, "word string, n_near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    joined = kept.join(best, "word", "left")
    is_form = -F.col("best.less") >= 2 * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    joined = scratch.table(joined, "near")
    roots = _roots(joined.where("form is not null"), scratch)
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of all ``documents``."""
    return variants(spark, common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op12"))
