"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, one gzip member each, so that any record is one range read.  Of records with equal payloads of
``REVISIT_BYTES`` at least, the one with the smallest page_id is a response and the others revisit it.  Only page_id, digest and size are
grouped by payload; the payloads themselves move once, by page_id, so a page that is copied a million times is no hot spot.

Index: captures are sorted by reversed-host URL key and page_id into compressed blocks of ``BLOCK_LINES`` lines; at the end of each index
file a sparse directory has the first key of every block.  A look-up picks the file by the files' first keys, binary-searches its
directory, reads the block, binary-searches it, and then range-reads the record.

Defined results: a null html is an empty payload; null or empty URLs have the key "-"; rows with the smallest page_id and the same payload
are all responses; rows without a page_id are responses that nobody refers to; repeated rows are records of their own; an empty table gives
no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 100
BLOCK_LINES = 500
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 4 << 20
MAGIC = b"SYLCDX01"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the path: com,example,www)/path?query.  Scheme, port and fragment don't count."""
    rest = (url or "").strip().partition("#")[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].partition(":")[0].lower()
    if not rest:
        return "-"
    return quote(",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/"), safe="/?&=,)(;:@!$'*+~%._-")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts as its UTF-8 bytes: by URL key, then page_id."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}:{digest}')}>"
    body = _HTTP + (payload if refers_to is None else b"")
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": "1970-01-01T00:00:00Z"}
    head |= {"WARC-Target-URI": quote(url or "", safe="/?&=,)(;:@!$'*+~%#[]._-"), "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": name(refers_to), "X-Refers-To-Page": refers_to, "X-Payload-Length": len(payload)}
    if page_id is not None:
        head["X-Page"] = page_id
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(body)}
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(raw.encode() + body + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


# --- archives -----------------------------------------------------------------------------------------------------------------------

#: Pages of one payload beyond which they are no longer brought together.
HOT = 10_000
_CAPTURE = "key string, page_id long, kind string, uri string, offset long, length long"


def _archive(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        uri, rows, at = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz", [], 0

        def chunks() -> Iterator[bytes]:
            nonlocal at
            for pdf in (x for source in ([first], batches) for x in source):
                for page, url, html, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers_to"]):
                    page, refers = None if pd.isna(page) else int(page), None if pd.isna(refers) else int(refers)
                    raw = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                    rows.append((capture_key(url, page), page, "response" if refers is None else "revisit", uri, at, len(raw)))
                    at += len(raw)
                    yield raw

        common.write_file(uri, chunks())
        for k in range(0, len(rows), 10_000):
            yield pd.DataFrame(rows[k : k + 10_000], columns=["key", "page_id", "kind", "uri", "offset", "length"], dtype=object)

    return run


def _revisits(slim: DataFrame, first: DataFrame, hot: int) -> DataFrame:
    """page_id, digest, refers_to of the copies of each payload's first page.

    Payloads of more than ``hot`` pages are no task's alone: they are few (a ``hot``-th of the pages at most) and go to the pages, behind a count; the
    pages that they settle are spread by their own ids in the join with the rest.
    """
    many = first.where(F.col("n") > hot).select("digest", F.col("refers_to").alias("_hot"))
    if many.count() > common.BROADCAST_IDS:
        return slim.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    few = first.where(F.col("n") <= hot).select(F.col("digest").alias("_key"), F.col("refers_to").alias("_few"))
    own = slim.where("page_id is not null").join(F.broadcast(many), "digest", "left")
    own = own.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("settled "), F.col("page_id").cast("string"))))
    own = own.join(few, "_key", "left").select("page_id", "digest", F.coalesce("_hot", "_few").alias("refers_to"))
    return own.where("page_id > refers_to").distinct()


def write(spark: SparkSession, pages: DataFrame, scratch: common.Scratch, hot: int = HOT) -> DataFrame:
    """Write archives and index below the scratch folder; returns the index manifest (part, uri, first key, captures)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    slim = pages.select("page_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("size")).where(F.col("size") >= REVISIT_BYTES)
    first = scratch.table(slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first")
    revisit = _revisits(slim, first, hot)
    rows = pages.withColumn("digest", F.sha2(raw, 256)).join(revisit, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    captures = scratch.table(common.map_frames(rows, _archive(scratch.path("warc")), _CAPTURE), "captures")
    ordered = captures.repartitionByRange(common.partitions(spark), "key").sortWithinPartitions("key")
    manifest = scratch.table(common.map_frames(ordered, _index(scratch.path("index")), "part int, uri string, first string, captures long"), "manifest")
    scratch.drop("captures", "first")
    return manifest


# --- index --------------------------------------------------------------------------------------------------------------------------


def index_chunks(lines: Iterator[tuple[str, str]]) -> Iterator[bytes]:
    """(key, rest of the line) in key order to blocks, directory and foot."""
    yield MAGIC
    at, directory, block = len(MAGIC), [], []

    def pack() -> bytes:
        nonlocal at, block
        raw = zlib.compress("\n".join(f"{k}\t{v}" for k, v in block).encode(), 6)
        directory.append([block[0][0], at, len(raw)])
        at, block = at + len(raw), []
        return raw

    for line in lines:
        block.append(line)
        if len(block) == BLOCK_LINES:
            yield pack()
    if block:
        yield pack()
    tail = zlib.compress(json.dumps(directory).encode(), 6)
    yield tail + struct.pack("<I", len(tail)) + MAGIC


def _index(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list = [None, 0]

        def lines() -> Iterator[tuple[str, str]]:
            for pdf in batches:
                for key, *rest in pdf[["key", "page_id", "kind", "uri", "offset", "length"]].itertuples(index=False):
                    seen[0] = key if seen[0] is None else seen[0]
                    seen[1] += 1
                    yield key, "\t".join(str("-" if pd.isna(x) else int(x) if isinstance(x, float) else x) for x in rest)

        source = lines()
        head = next(source, None)
        if head is None:
            return
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.cdx"
        common.write_file(uri, index_chunks(x for s in ([head], source) for x in s))
        yield pd.DataFrame({"part": [part], "uri": [uri], "first": [seen[0]], "captures": [seen[1]]})

    return run


class Index:
    """Look-ups in one index file; the block that was read last is kept."""

    def __init__(self, uri: str):
        self.file = common.RangeReader(uri)
        size, foot = self.file.size(), len(MAGIC) + 4
        end = self.file.read(size - foot, foot)
        if end[4:] != MAGIC:
            raise ValueError(f"{uri} isn't whole")
        n = struct.unpack("<I", end[:4])[0]
        self.directory = json.loads(zlib.decompress(self.file.read(size - foot - n, n)))
        self.firsts = [d[0].encode() for d in self.directory]
        self.at, self.keys, self.lines = -1, [], []

    def _block(self, k: int) -> None:
        if k != self.at:
            _, at, size = self.directory[k]
            self.lines = [line.split("\t") for line in zlib.decompress(self.file.read(at, size)).decode().split("\n")]
            self.at, self.keys = k, [line[0].encode() for line in self.lines]

    def find(self, key: str) -> list[list[str]]:
        """All captures of the key: [key, page_id, kind, uri, offset, length]."""
        raw, out = key.encode(), []
        k = max(bisect.bisect_left(self.firsts, raw) - 1, 0)  # captures of one key may begin in the block before
        while k < len(self.firsts) and self.firsts[k] <= raw:
            self._block(k)
            at = bisect.bisect_left(self.keys, raw)
            while at < len(self.keys) and self.keys[at] == raw:
                out.append(self.lines[at])
                at += 1
            k += 1
        return out


def look_up(spark: SparkSession, wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Captures (page_id, kind, uri, offset, length) of distinct (url, page_id), found through the index."""
    files = sorted((r["part"], r["first"], r["uri"]) for r in manifest.collect())  # a row for each index file
    firsts, uris = [f[1].encode() for f in files], [f[2] for f in files]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [capture_key(u, None if pd.isna(p) else int(p)) for u, p in zip(pdf["url"], pdf["page_id"])]
            yield pd.DataFrame({"key": keys, "file": [max(bisect.bisect_right(firsts, k.encode()) - 1, 0) for k in keys]})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, index = -1, None
        for pdf in batches:
            rows = []
            for key, file in zip(pdf["key"], pdf["file"]):
                if file != at:
                    at, index = file, Index(uris[file])
                rows += [(None if p == "-" else int(p), kind, uri, int(o), int(n)) for _, p, kind, uri, o, n in index.find(key)]
            yield pd.DataFrame(rows, columns=["page_id", "kind", "uri", "offset", "length"], dtype=object)

    if not files:
        return spark.createDataFrame([], "page_id long, kind string, uri string, offset long, length long")
    asked = common.map_frames(wanted.select("url", F.col("page_id").cast("long").alias("page_id")), route, "key string, file int").distinct()
    return common.map_frames(asked.repartition(max(1, min(len(files), common.partitions(spark))), "file").sortWithinPartitions("file", "key"), find, "page_id long, kind string, uri string, offset long, length long")


def read_records(spark: SparkSession, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with ``payloads``, html of captures, by range reads in file order."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * payloads]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, reader = None, None
        for pdf in batches:
            rows, k = [], 0
            todo = list(zip(pdf["uri"], pdf["offset"], pdf["length"]))
            while k < len(todo):
                end = k
                while end + 1 < len(todo) and todo[end + 1][0] == todo[k][0] and todo[end + 1][1] == todo[end][1] + todo[end][2] and todo[end + 1][1] + todo[end + 1][2] - todo[k][1] <= READ_BYTES:
                    end += 1
                if todo[k][0] != uri:
                    if reader:
                        reader.close()
                    uri, reader = todo[k][0], common.RangeReader(todo[k][0])
                start = int(todo[k][1])
                raw = reader.read(start, int(todo[end][1] + todo[end][2]) - start)
                for _, o, n in todo[k : end + 1]:
                    head, payload = parse(raw[int(o) - start : int(o) - start + int(n)])
                    page = int(head["X-Page"]) if "X-Page" in head else None
                    if head["WARC-Type"] == "response":
                        rows.append((page, head["WARC-Target-URI"], len(payload), hashlib.sha256(payload).hexdigest(), "response", None, *[payload.decode("utf-8", "surrogatepass")] * payloads))
                    else:
                        rows.append((page, head["WARC-Target-URI"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", int(head["X-Refers-To-Page"]), *[None] * payloads))
                k = end + 1
            yield pd.DataFrame(rows, columns=names, dtype=object)

    ordered = captures.select("uri", "offset", "length").repartition(common.partitions(spark), "uri").sortWithinPartitions("uri", "offset")
    return common.map_frames(ordered, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payloads)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` to archives, and every one looked up and read back."""
    pages = common.read(spark, sf_dir, "pages")
    manifest = write(spark, pages, common.Scratch(spark, "op3"))
    return read_records(spark, look_up(spark, pages, manifest), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
