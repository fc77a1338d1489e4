"""Benchmark decontamination with one Aho-Corasick automaton.

Items (questions and answers) are normalised to words; every window of ``WINDOW`` words of an item is a pattern of one automaton, as is a
shorter item as a whole.  Each text is normalised the same way and scanned once; a pattern's place in the normalised text gives the
words it covers, and those words' places in the original text.

Words are matched as UTF-8 bytes, one character a byte, between single spaces: a pattern can only match at word ends, and offsets need
no decoding.  The automaton goes to every task, so its size is checked: ``MAX_PATTERN_BYTES`` at most at a time; a larger benchmark is
dealt into several automata, and the documents are scanned with one after the other.

Defined results: null and empty texts have no words, and hit nothing; items without words or with a null id or text are no items; repeated
rows each have a result; items with the same id count as one; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MAX_PATTERN_BYTES = 64 << 20

#: Bytes of words: digits, lower-case letters and all of other characters; capitals become lower-case, the rest white space.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(items: Iterable[tuple[str, str]], width: int = WINDOW) -> dict[bytes, set[str]]:
    """Each window, between spaces, and the items that have it."""
    out: dict[bytes, set[str]] = {}
    for item, text in items:
        own = words(text)
        for at in range(max(1, len(own) - width + 1) if own else 0):
            out.setdefault(b" " + b" ".join(own[at : at + width]) + b" ", set()).add(item)
    return out


def automaton(found: dict[bytes, set[str]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for pattern, items in found.items():
        out.add_word(pattern.decode("latin-1"), (len(pattern), pattern.count(b" ") - 1, tuple(sorted(items))))
    if found:
        out.make_automaton()
    return out


class Scan:
    """One text against an automaton: its number of words, the items, and the hit words as a mask."""

    def __init__(self, machine, text: str):
        own = words(text)
        self.n_words = len(own)
        joined = b" " + b" ".join(own) + b" "
        self.items: set[str] = set()
        ends, sizes = [], []
        if len(machine) and own:
            for end, (_, n, items) in machine.iter(joined.decode("latin-1")):
                ends.append(end)
                sizes.append(n)
                self.items.update(items)
        self.hit = np.zeros(self.n_words, bool)
        if ends:
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            last = np.searchsorted(spaces, ends)  # words that end before this space
            change = np.zeros(self.n_words + 1, np.int64)
            np.add.at(change, last - np.asarray(sizes), 1)
            np.add.at(change, last, -1)
            self.hit = np.cumsum(change)[:-1] > 0


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points of the original text that runs of hit words cover."""
    raw = text.encode("utf-8", "surrogatepass")
    mapped = np.frombuffer(raw.translate(_TABLE), np.uint8)
    inside = np.concatenate([[False], mapped != 32, [False]])
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(point[starts[a]]), int(point[ends[b - 1]])) for a, b in zip(edge[::2], edge[1::2])]


def _machines(spark: SparkSession, benchmark: DataFrame, width: int) -> list:
    """The benchmark's windows as broadcast automata, each of a checked size."""
    machines, found, size = [], {}, 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    for r in items.toLocalIterator():
        for pattern, own in windows([(r["item"], r["text"])], width).items():
            size += 0 if pattern in found else len(pattern)
            found.setdefault(pattern, set()).update(own)
        if size > MAX_PATTERN_BYTES:
            machines.append(spark.sparkContext.broadcast(found))
            found, size = {}, 0
    if found or not machines:
        machines.append(spark.sparkContext.broadcast(found))
    return machines


_built: dict[int, object] = {}


def _kept(machines: list[_Id]) -> list:
    """The automata of this benchmark, each built once a worker from its broadcast windows; those of another benchmark go."""
    for gone in _built.keys() - {m.id for m in machines}:
        del _built[gone]
    for m in machines:
        if m.id not in _built:
            _built[m.id] = automaton(m.value)
            m.unload()
    return [_built[m.id] for m in machines]


class _Id:
    """A broadcast with a key that is the same in every task of a worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast else id(broadcast)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value

    def unload(self) -> None:
        """The windows go from the worker's memory once the automaton is built; another task can load them again."""
        if self.broadcast._jbroadcast is None:
            self.broadcast.__dict__.pop("_value", None)


def _scanned(machines: list, text: str | None) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, the hit words as a mask, and the items, over all automata."""
    first, *others = (Scan(m, text or "") for m in machines)
    for got in others:
        first.hit |= got.hit
        first.items |= got.items
    return first.n_words, first.hit, first.items


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, cut: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 of every row; with ``cut`` also the text without the hit passages."""
    machines = [_Id(m) for m in _machines(spark, benchmark, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _kept(machines)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [_scanned(built, t) for t in texts]
            out = {"doc_id": batch.column("doc_id")}
            for name, values in (("n_words", [n for n, _, _ in found]), ("n_hit", [int(hit.sum()) for _, hit, _ in found]), ("n_items", [len(items) for *_, items in found])):
                out[name] = pa.array(values, pa.int64())
            out["items_sha256"] = pa.array([hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for *_, items in found], pa.string())
            if cut:
                out["text"] = pa.array([_without(t, spans(t, hit)) if items else t for t, (_, hit, items) in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
    return common.documents(docs).mapInArrow(run, schema + ", text string" * cut)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = 2) -> DataFrame:
    """Rows, with all of their columns, without those that hit ``most`` items or more; of the others the hit passages are cut out."""
    machines = [_Id(m) for m in _machines(spark, benchmark, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _kept(machines)
        for batch in common.parts(batches, "text", common.PART):
            texts = batch.column("text").to_pylist()
            found = [_scanned(built, t) for t in texts]
            out = {"text": [_without(t, spans(t, hit)) if items else t for t, (_, hit, items) in zip(texts, found)]}
            if "n_chars" in batch.schema.names:
                out["n_chars"] = [len(t) if items else n for t, n, (*_, items) in zip(out["text"], batch.column("n_chars").to_pylist(), found)]
            yield common.replaced(batch, **out).filter(pa.array([len(items) < most for *_, items in found], pa.bool_()))
        common.give_back()

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, cut: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in cut:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def op10_benchmark_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    found = scan(spark, common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.col("n_items") >= 2)


#: The same by hashing every window of every document; words and lower-casing as above.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + 7], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN items USING (doc_id)
"""
