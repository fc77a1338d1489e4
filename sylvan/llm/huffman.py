"""Token-id files: canonical length-limited Huffman coding with table-driven decoding of independent blocks.

The code comes from the ids' global counts.  Code lengths never exceed ``MAX_BITS``, so one table of 2**MAX_BITS entries decodes any
code in one look-up.  A block holds whole documents and can be decoded alone; within a block the bit offset of every ``LANE``-th id
is kept, so that all lanes of a block are decoded side by side, one vector step for the n-th id of every lane.

File: magic | code lengths (zlib) | blocks | directory (zlib JSON: offset, size, documents, ids, first doc_id) | its length | magic.
Block: documents without a doc_id, documents, ids, lanes, payload bytes (u32 each) | doc_ids (i64) | ids of each document (u32) | lane offsets (u64) | payload.

Defined results: a null text is an empty one; an empty text is the end id alone; a null doc_id sorts first and comes back null; rows
with the same doc_id stay separate rows; an empty table gives no file and an empty result; more than 2**MAX_BITS different ids in use stop
the query with an error, as no code of that length has room for them (vocabularies of public tokenizers are smaller).
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAX_BITS = 18
LANE = 64
#: Ids in a block, unless one document alone has more.
BLOCK_IDS = 1 << 19
MAGIC = b"SYLHUF02"
#: Instead of an id's width: the row has a task's counts.
COUNTS = 0


# --- the code ---------------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with none above ``limit`` (package-merge); 0 where the count is 0."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaves]
    n = len(leaves)
    # Each level merges the leaves with the pairs of the level below; only how many leaves lie before each place is needed later.
    before: list[np.ndarray] = []
    level = weight
    is_leaf = np.ones(n, bool)
    for _ in range(limit):
        before.append(np.concatenate([[0], np.cumsum(is_leaf)]))
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        order = np.argsort(np.concatenate([weight, pairs]), kind="stable")
        level, is_leaf = np.concatenate([weight, pairs])[order], order < n
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for seen in reversed(before):
        take = min(take, len(seen) - 1)
        own = int(seen[take])
        lengths[:own] += 1
        take = 2 * (take - own)
    out[leaves] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), each one more than the one before."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    size = lengths[order].astype(int)
    for n in np.unique(size):
        code <<= int(n) - last
        own = order[size == n]
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(n)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical(self.lengths)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every window of MAX_BITS bits: the id it begins with, and that code's length."""
        if self._table is None:
            ids, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            spread = 1 << (MAX_BITS - self.lengths[order].astype(np.int64))
            n = int(spread.sum())
            ids[:n], sizes[:n] = np.repeat(order, spread), np.repeat(self.lengths[order], spread)
            self._table = ids, sizes
        return self._table

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids' bits, and the bit offset of every LANE-th id."""
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and not size.all():
            raise ValueError("an id without a code")
        end = np.cumsum(size)
        start = end - size
        if not len(ids):
            return b"", start.astype(np.uint64)
        word, over = start >> 6, (start & 63) + size - 64  # over: bits that go on in the next word
        codes = self.codes[ids].astype(np.uint64)
        own = np.where(over <= 0, codes << np.minimum(-over, 63).clip(0).astype(np.uint64), codes >> over.clip(0).astype(np.uint64))
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # a word has the start of one code at least
        out[:-1] = np.bitwise_or.reduceat(own, first)
        cut = np.flatnonzero(over > 0)
        out[word[cut] + 1] |= codes[cut] << (64 - over[cut]).astype(np.uint64)
        return out.astype(">u8").tobytes(), start[::LANE].astype(np.uint64)

    def unpack(self, payload: bytes, lanes: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        ids, sizes = self.table()
        raw = np.frombuffer(payload + bytes(MAX_BITS * LANE // 8 + 8), np.uint8).astype(np.uint32)  # the last lane may run on
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.zeros((len(lanes), LANE), np.uint32)
        at = lanes.astype(np.int64)
        for k in range(LANE):
            got = (window[at >> 3] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
            out[:, k] = ids[got]
            at += sizes[got]
        return out.reshape(-1)[:n]


# --- the file ---------------------------------------------------------------------------------------------------------------------


def file_chunks(lengths: np.ndarray, blocks: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[bytes]:
    """blocks: how many documents at their beginning have no doc_id, doc_ids, ids of each document, all ids."""
    code = Code(lengths)
    packed = zlib.compress(code.lengths.tobytes(), 6)
    head = MAGIC + struct.pack("<I", len(packed)) + packed
    yield head
    at, directory = len(head), []
    for none, docs, each, ids in blocks:
        payload, lanes = code.pack(ids)
        raw = struct.pack("<5I", none, len(docs), len(ids), len(lanes), len(payload)) + docs.astype("<i8").tobytes() + each.astype("<u4").tobytes() + lanes.astype("<u8").tobytes() + payload
        directory.append([at, len(raw), len(docs), len(ids), int(docs[0])])
        at += len(raw)
        yield raw
    tail = zlib.compress(json.dumps(directory).encode())
    yield tail + struct.pack("<I", len(tail)) + MAGIC


class Reader:
    """Blocks of one file, each by a range read of its own."""

    def __init__(self, uri: str):
        self.file = common.RangeReader(uri)
        size, foot = self.file.size(), len(MAGIC) + 4
        end = self.file.read(size - foot, foot)
        if end[4:] != MAGIC:
            raise ValueError(f"{uri} isn't whole")
        n = struct.unpack("<I", end[:4])[0]
        self.directory = json.loads(zlib.decompress(self.file.read(size - foot - n, n)))
        n = struct.unpack("<I", self.file.read(len(MAGIC), 4))[0]
        self.code = Code(np.frombuffer(zlib.decompress(self.file.read(len(MAGIC) + 4, n)), np.uint8))

    def block(self, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        at, size, *_ = self.directory[k]
        raw = self.file.read(at, size)
        none, docs, ids, lanes, payload = struct.unpack_from("<5I", raw)
        parts, at = [], 20
        for kind, n in (("<i8", docs), ("<u4", docs), ("<u8", lanes)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        return none, parts[0], parts[1], self.code.unpack(raw[at : at + payload], parts[2], ids)


# --- Spark ------------------------------------------------------------------------------------------------------------------------


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of the ids of each document, from one buffer."""
    offsets = np.concatenate([[0], ends * ids.itemsize]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def _tokenise(tokenizer: str, end_id: int):
    """A row for each document, and at last one for the task: its counts by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        size = max(enc.size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, ends = tokens.with_end(*enc.encode(batch.column("text")), end_id)
            total += np.bincount(ids, minlength=size)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": _binary(ids.astype(kind), ends), "width": pa.array([int(kind[2])] * len(ends), pa.int32())})
        enc.rest()
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), "ids": [total.tobytes()], "width": pa.array([COUNTS], pa.int32())})

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            total = np.frombuffer(raw, np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole documents until a block has BLOCK_IDS ids: how many have no doc_id (they come first), doc_ids, ids of each, all ids."""
    parts, held = [], 0
    for batch in batches:
        docs, raw, width = batch.column("doc_id"), batch.column("ids"), batch.column("width")
        if not len(docs):
            continue
        none, ids = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
        kind = np.dtype(f"<u{width[0].as_py()}")
        edges = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        every = np.frombuffer(raw.buffers()[2], kind, int(edges[-1] - edges[0]) // kind.itemsize, int(edges[0]))
        ends, at = (edges - edges[0]) // kind.itemsize, 0
        while at < len(docs):
            stop = min(len(docs), at + max(1, int(np.searchsorted(ends[at + 1 :] - ends[at], BLOCK_IDS - held, "left")) + 1))
            parts.append((none[at:stop], ids[at:stop], np.diff(ends[at : stop + 1]), every[ends[at] : ends[stop]]))
            held, at = held + len(parts[-1][3]), stop
            if held >= BLOCK_IDS:
                missing, *own = (np.concatenate(p) for p in zip(*parts))
                yield int(missing.sum()), *own
                parts, held = [], 0
    if parts:
        missing, *own = (np.concatenate(p) for p in zip(*parts))
        yield int(missing.sum()), *own


def _write(lengths: bytes, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0, 0]

        def counted() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            for block in itertools.chain([first], source):
                seen[0], seen[1] = seen[0] + len(block[1]), seen[1] + len(block[3])
                yield block

        source = _blocks(batches)
        first = next(source, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.huf"
        size = common.write_file(uri, file_chunks(np.frombuffer(lengths, np.uint8), counted()))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "docs": [seen[0]], "ids": [seen[1]], "bytes": [size]})

    return run


def write(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents, in ascending doc_id order, to files below the scratch folder; returns the manifest (part, uri, docs, ids, bytes).

    Only files that the manifest names count: a task that is run twice leaves a file that nobody reads.
    """
    n = common.partitions(spark)
    ids = scratch.table(common.documents(docs).mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, ids binary, width int"), "ids")
    counts = ids.where(F.col("width") == COUNTS).select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary at most
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ordered = ids.where(F.col("width") != COUNTS).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.crc32("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids"))
    manifest = scratch.table(ordered.mapInArrow(_write(code_lengths(total).tobytes(), scratch.path("files")), "part int, uri string, docs long, ids long, bytes long"), "manifest")
    scratch.drop("ids")
    return manifest


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files that the manifest names."""
    files = sorted((r["part"], r["uri"], r["ids"]) for r in manifest.select("part", "uri", "ids").collect())  # a row for each file
    starts = np.cumsum([0, *(f[2] for f in files)]).tolist()
    rows = [(uri, start) for (_, uri, _), start in zip(files, starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                reader = Reader(uri)
                for k in range(len(reader.directory)):
                    none, docs, each, ids = reader.block(k)
                    ends = np.cumsum(each.astype(np.int64))
                    raw, cut = memoryview(ids.astype("<u4").tobytes()), (ends * 4).tolist()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *cut], cut)]
                    named = pa.array(docs, mask=np.arange(len(docs)) < none)
                    yield pa.RecordBatch.from_pydict({"doc_id": named, "start": start + ends - each, "n_tokens": each.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})
                    start += int(ends[-1])

    listed = spark.createDataFrame(rows, "uri string, start long")
    return listed.repartition(max(1, len(rows)), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` to Huffman-coded token files and back: doc_id, start, n_tokens, ids_crc32."""
    scratch = common.Scratch(spark, "op2")
    return read_back(spark, write(spark, common.read(spark, sf_dir, "documents"), scratch, tokens.public_path(), end_id=1))
