"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds the distinct hashes of its word shingles.  One hash per shingle gives all of the sketch: the hash picks one of
``BANDS * ROWS`` bins, each bin keeps its least hash, and an empty bin borrows from the first filled one that its own probe sequence hits.
``ROWS`` bins make the key of a band; documents with a key in common share a bucket.  At a similarity of 0.8 a pair shares no bucket
with a probability of 3e-6, and no cap is set on buckets.

Documents with equal sets are one node from the start.  The centre of a bucket is its node with the most neighbours over all buckets,
mostly the original of a group of copies; a node's first candidate edge goes to the centre that most of its buckets have.  So there are
no more first candidates than nodes.

A star can miss links between nodes that its centre isn't linked with.  Buckets that still hold several components go on in tiles: the
nodes of the bucket's largest component in chunks of ``TILE`` against chunks of the others, so that no task holds a whole bucket and no
pair is ever a row.  A tile compares sketches: sizes, odd sketches (two sets differ in as many shingles at least as these do in bits)
and four bits of each bin, which may differ in as many places as for a pair at the limit at ``DEVIATIONS`` standard deviations (one such
pair in 50 million differs in more).  Of the pairs that may be linked it gives only edge-disjoint spanning forests of the components,
first one, then more (``FORESTS``), and all as soon as those held back are no more than the bucket rows, until a round in which nothing was
held back: so every pair of a bucket that may be linked was either confirmed, found not to be linked, or joins nodes that are in one
component already.  Where the first forest holds, as among true copies, nothing is left for the second.

Every edge is confirmed on the full sets.  A centre's text goes to tasks once for every ``SPREAD`` of its edges.

Components come from alternating large-star and small-star steps on tables in the shared folder.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; texts of fewer words than a shingle count
as one shingle; rows without an id are linked with nothing, have no component and stay; rows with the same id are one node, whose text is
that of any of them where texts differ; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
PERCENT = 80
BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
#: Nodes of one side of a tile; edges of a centre that one copy of its text serves; pairs that are compared at once.
TILE = 1024
SPREAD = 1024
BLOCK = 1 << 17
#: Spanning forests that a tile gives in each round; None: all of its pairs.
FORESTS = (1, 16, None)
#: Longs that hold four bits of every bin; the standard deviations from 0.8 at which a pair's bins differ too much to be worth a comparison.
DIGESTS = BINS // 16
DEVIATIONS = 5.5
#: Longs of the odd sketch, a parity for each of so many bits: two sets differ in as many shingles at least as their odd sketches in bits.
ODD = 16
PROBES = 256

_random = np.random.default_rng(9)
_U = np.uint64


def _odd(n: int) -> np.ndarray:
    return _random.integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


#: Lower-cases A-Z; white space of ASCII is a blank.
_TABLE = bytes(0x20 if b in b" \t\n\v\f\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _odd(64)
_BASE = int(_odd(1)[0])
_UNBASE = pow(_BASE, -1, 1 << 64)
_BAND = _odd(ROWS)
_PROBE = _random.integers(0, BINS, (BINS, PROBES))
#: Bytes of a text that are hashed at once, up to the end of a word: what that holds is some 40 times as much.
STRETCH = 1 << 16


def _powers_of(n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))]) for base in (_BASE, _UNBASE))


_powers = _powers_of(STRETCH + 256)


def _powers_to(n: int) -> tuple[np.ndarray, ...]:
    """Kept for a stretch, made anew for a word that goes on beyond its end."""
    return tuple(p[:n] for p in (_powers if n <= len(_powers[0]) else _powers_of(n)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)  # after a word
        end = len(data) if end < 0 else end
        out.append(_hashes(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashes(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 0x20, out=inside[1:-1])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    power, unpower = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * unpower[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < words:
        return _mix(np.asarray([(h * _PLACE[:n]).sum() + _U(n)], np.uint64)) if n <= len(_PLACE) else _mix(np.asarray([(h * _powers_to(n)[0]).sum()], np.uint64))
    total = np.full(n - words + 1, _U(words), np.uint64)
    for k in range(words):
        total += h[k : n - words + 1 + k] * (_PLACE[k] if k < len(_PLACE) else _powers_to(k + 1)[0][k])
    return np.unique(_mix(total))


def sketch(own: np.ndarray) -> np.ndarray:
    """One hash a bin from a sorted, non-empty set."""
    bins = ((own >> _U(40)) * _U(BINS) >> _U(24)).astype(np.int64)
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    rest = _mix(own + _U(0x9E3779B97F4A7C15))
    order = np.argsort(rest)[::-1]
    out[bins[order]] = rest[order]
    filled[bins] = True
    empty = np.flatnonzero(~filled)
    for t in range(PROBES):
        if not len(empty):
            break
        at = _PROBE[empty, t]
        hit = filled[at]
        out[empty[hit]] = out[at[hit]]
        empty = empty[~hit]
    if len(empty):
        out[empty] = out[np.flatnonzero(filled)[0]]
    return out


def bands(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, and the digests of the bins."""
    bins = sketch(own)
    keys = _mix((bins.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_BASE)).view(np.int64)
    digests = ((bins >> _U(60)).reshape(DIGESTS, 16) << (_U(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)
    odd = np.packbits((np.bincount((own & _U(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD) & 1).astype(np.uint8)).view(np.int64)
    return keys, np.concatenate([digests, odd])


def worth(a: np.ndarray, b: np.ndarray, n: np.ndarray, d: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows a and b (places in n: sizes, d: digests and odd sketches) can be linked, for many pairs."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    left = np.flatnonzero(100 * small >= percent * large)
    apart = np.bitwise_count(d[a[left], DIGESTS:] ^ d[b[left], DIGESTS:]).sum(axis=1, dtype=np.int64)
    left = left[(100 + percent) * apart <= (100 - percent) * (small[left] + large[left])]
    x = d[a[left], :DIGESTS] ^ d[b[left], :DIGESTS]
    x |= x >> _U(1)
    x |= x >> _U(2)
    differ = np.bitwise_count(x & _U(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    filled = BINS * (1 - (1 - 1 / BINS) ** small[left])
    p = (1 - percent / 100) * 15 / 16
    left = left[differ <= BINS * (p + DEVIATIONS * (p * (1 - p)) ** 0.5 / np.sqrt(filled))]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def _longs(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in common.parts(batches, "text", common.PART):
            n, one, two, keys, digests = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, words)
                n.append(len(own))
                one.append(int(_mix(own + _U(1)).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(_mix(own ^ _U(_BASE)).sum(dtype=np.uint64).view(np.int64)))
                got = bands(own) if len(own) else (none, none)
                keys.append(got[0])
                digests.append(got[1])
            whole = [pa.array(x, pa.int64()) for x in (n, one, two)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *whole, _longs(keys), _longs(digests)], ["doc_id", "n", "one", "two", "keys", "d"])
        common.give_back()

    return run


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the distinct pairs (u, v) those that are linked.  A centre u with many edges is dealt to several tasks, its text once to each."""
    share = pairs.groupBy("u").agg((F.floor(F.count("*") / SPREAD) + 1).cast("int").alias("shares"))
    dealt = pairs.join(share, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int").alias("share"))
    own = texts.join(share.withColumnRenamed("u", "node"), "node").select(F.col("node").alias("u"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("v"), "text")
    other = dealt.join(texts.withColumnRenamed("node", "v"), "v").select("u", "share", "v", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, text in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text"))):
                if v is None:  # comes before its edges
                    centre, own = u, shingles(text, words)
                elif u == centre and linked(own, shingles(text, words), percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
        common.give_back()

    met = own.unionByName(other).repartition(common.partitions(pairs.sparkSession), "u", "share").sortWithinPartitions("u", "share", F.col("v").asc_nulls_first())
    return met.mapInArrow(run, "u long, v long")


def components(spark: SparkSession, edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """node, root of every node of the edges (u, v); root is the smallest node that can be reached."""
    state = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    k = 0
    while True:
        state = scratch.table(state, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if not now[0] or k and now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        state = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, k = now, k + 1


def forests(p: np.ndarray, q: np.ndarray, cost: np.ndarray, component: np.ndarray, most: int | None) -> np.ndarray:
    """Which of the pairs (p, q) make up ``most`` edge-disjoint spanning forests of the components, the cheapest first; with None, all."""
    chosen = component[p] != component[q]
    if most is None:
        return chosen
    open_pairs = np.flatnonzero(chosen)[np.argsort(cost[chosen], kind="stable")]
    chosen = np.zeros(len(p), bool)
    for _ in range(most):
        parent = list(range(int(component.max(initial=-1)) + 1))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        label, left, some = component, open_pairs, False
        while len(left):  # every component takes its cheapest edge, until none is left between two
            ends = np.stack([label[p[left]], label[q[left]]], axis=1).ravel()
            for k in left[np.unique(np.unique(ends, return_index=True)[1] // 2)].tolist():
                a, b = find(int(component[p[k]])), find(int(component[q[k]]))
                if a != b:
                    parent[a], chosen[k], some = b, True, True
            label = np.fromiter(map(find, range(len(parent))), np.int64, len(parent))[component]
            left = left[label[p[left]] != label[q[left]]]
        open_pairs = open_pairs[~chosen[open_pairs]]
        if not some:
            break
    return chosen


def _tiles(most: int | None, percent: int):
    """Rows come by tile, and within it those of the open chunk first.  Gives edges (u, v, null), and rows (null, null, pairs held back)."""

    def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = [rows.column(c).to_numpy() for c in ("bucket", "i", "k")]
        node, root, n, right = (rows.column(c).to_numpy() for c in ("node", "root", "n", "right"))
        lists = rows.column("d").combine_chunks()
        d = lists.flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        change = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        begins = np.concatenate([[0], change])
        tile = np.zeros(len(node), np.int64)
        tile[change] = 1
        tile = np.cumsum(tile)
        ends = np.append(change, len(node))[tile]
        first_right = begins + np.add.reduceat((right == 0).astype(np.int64), begins)
        left = np.flatnonzero(right == 0)
        since = np.where(key[2][left] == 0, left + 1, first_right[tile[left]])  # the first tile of an open chunk compares it with itself too
        each = ends[left] - since
        total = np.cumsum(each)
        found, at, size = [], 0, 0
        while at < len(left):
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + BLOCK, "right")))
            own = each[at:stop]
            p = np.repeat(left[at:stop], own)
            q = np.arange(len(p)) + np.repeat(since[at:stop] - (np.cumsum(own) - own), own)
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
            keep = worth(p, q, n, d, percent)
            found.append((p[keep], q[keep]))
            size += len(found[-1][0])
            if size and (stop == len(left) or size >= 8 * BLOCK and tile[left[stop]] != tile[left[stop - 1]]):
                p, q = (np.concatenate(x) for x in zip(*found))
                used, place = np.unique(np.concatenate([p, q]), return_inverse=True)
                component = np.unique(np.stack([tile[used], root[used]]), axis=1, return_inverse=True)[1].reshape(-1)
                cost = np.bitwise_count(d[p, DIGESTS:] ^ d[q, DIGESTS:]).sum(axis=1, dtype=np.int64) / (n[p] + n[q])
                chosen = forests(place[: len(p)], place[len(p) :], cost, component, most)
                held = int((~chosen).sum())
                p, q = node[p[chosen]], node[q[chosen]]
                u, v = np.minimum(p, q).tolist(), np.maximum(p, q).tolist()
                if held:
                    u, v = [*u, None], [*v, None]
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "held": pa.array([None] * len(chosen[chosen]) + [held] * bool(held), pa.int64())})
                found, size = [], 0
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = np.ones(batch.num_rows, bool)
            for c in ("bucket", "i", "k"):
                x = batch.column(c).to_numpy()
                last &= x == x[-1]
            start = batch.num_rows - int(last.sum())
            if not start and held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("bucket", "i", "k")):
                held.append(batch)
                continue
            before = [*held, batch.slice(0, start)]
            if any(b.num_rows for b in before):
                yield from edges(pa.Table.from_batches(before))
            held = [batch.slice(start)]
        if held:
            yield from edges(pa.Table.from_batches(held))
        common.give_back()

    return run


def _dealt(member: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, node, root, right, i, k) of the tiles of buckets that hold several components."""
    state = member.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    by = state.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"))
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
    by = by.where("parts > 1").select("bucket", F.col("top.root").alias("home"), chunks(F.col("top.n")).alias("homes"), chunks(F.col("size") - F.col("top.n")).alias("opens"))
    rows = state.join(by, "bucket").withColumn("at_home", F.col("root") == F.col("home"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("at_home"), F.col("homes")).otherwise(F.col("opens"))).cast("int")
    rows = rows.withColumn("own", own)
    at = lambda right, i, k: F.struct(F.lit(right).alias("right"), i.cast("int").alias("i"), k.cast("int").alias("k"))
    # Tile (i, k): open chunk i against chunk k of the largest component or, from k = homes on, open chunk k - homes > i.
    home = F.transform(F.sequence(F.lit(0), F.col("opens") - 1), lambda i: at(1, i, F.col("own")))
    first = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda k: at(0, F.col("own"), k))
    others = F.filter(F.sequence(F.lit(0), F.col("opens") - 1), lambda j: j != F.col("own"))
    more = F.transform(others, lambda j: F.when(j > F.col("own"), at(0, F.col("own"), F.col("homes") + j)).otherwise(at(1, j, F.col("homes") + F.col("own"))))
    return rows.withColumn("tile", F.when(F.col("at_home"), home).otherwise(F.concat(first, more))).select("bucket", "node", "root", "tile")


def classes(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = common.documents(docs)
    base = scratch.table(docs.mapInArrow(_sketches(words), "doc_id long, n long, one long, two long, keys array<long>, d array<long>"), "base")
    same = ["one", "two", "n"]
    nodes = scratch.table(base.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("d").alias("d")), "nodes")
    rows = nodes.select(F.explode("keys").alias("bucket"), "node")
    member = scratch.table(rows.join(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"), "members")
    wanted = scratch.table(member.select(F.col("node").alias("_node")).distinct(), "wanted")
    texts = docs.withColumnRenamed("doc_id", "node")
    texts = scratch.table(common.by_ids(texts, wanted, texts["node"] == wanted["_node"], "left_semi"), "texts")

    # First each node's favourite centre alone: where that is linked, the node's other edges are needless.
    rank = member.groupBy("node").agg(F.sum("size").alias("near"))
    centre = member.join(rank, "node").groupBy("bucket").agg(F.max(F.struct("near", (-F.col("node")).alias("less"))).alias("c"))
    stars = member.join(centre, "bucket").select(F.col("node").alias("v"), (-F.col("c.less")).alias("u"), F.col("c.near").alias("near")).where("u <> v")
    stars = stars.groupBy("v", "u").agg(F.count("*").alias("n"), F.max("near").alias("near")).groupBy("v").agg(F.max(F.struct("n", "near", "u")).alias("c")).select("v", F.col("c.u").alias("u"))
    links = _verify(scratch.table(stars, "stars"), texts, words, percent)
    roots = components(spark, links, scratch, "roots-0")
    tried, most = None, FORESTS[0]
    sketches = nodes.select("node", "n", "d")
    for k in range(len(FORESTS)):
        dealt = scratch.table(_dealt(member, roots), f"dealt-{k}")
        tiles = dealt.join(sketches, "node").select("bucket", "node", "root", "n", "d", F.explode("tile").alias("t")).select("bucket", "t.i", "t.k", "t.right", "node", "root", "n", "d")
        order = ["bucket", "i", "k"]
        tiles = tiles.repartition(common.partitions(spark), *order).sortWithinPartitions(*order, "right")
        found = scratch.table(tiles.mapInArrow(_tiles(most, percent), "u long, v long, held long"), f"found-{k}")
        held = found.agg(F.sum("held")).first()[0] or 0
        fresh = found.where("u is not null").select("u", "v").distinct()
        fresh = scratch.table(fresh if tried is None else fresh.join(tried, ["u", "v"], "left_anti"), f"fresh-{k}")
        links = _verify(fresh, texts, words, percent).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = components(spark, links, scratch, f"roots-{k + 1}")
        if not held:
            break
        tried = fresh if tried is None else tried.unionByName(fresh)
        most = None if held <= dealt.count() else FORESTS[k + 1]
        member = dealt.select("bucket", "node")
    scratch.drop("members", "texts")

    of = nodes.select(*same, "node").join(roots, "node", "left").select(*same, F.coalesce("root", "node").alias("component_id"))
    return base.select("doc_id", "n", "one", "two").join(of, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def distinct(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows, with all of their columns, of one document of each class: that with the smallest id."""
    gone = classes(spark, docs, scratch, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = scratch.table(gone, "gone")
    return common.by_ids(docs, gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op9_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` by 2-word shingles at 0.8."""
    found = classes(spark, common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op9"), words=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same over all pairs that share a shingle.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(a, b) AS (SELECT u, v FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c
"""
