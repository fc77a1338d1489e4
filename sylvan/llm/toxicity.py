"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (and of itself), hashed into ``BUCKETS`` embeddings: its vector is their mean.  A text is the
weighted mean of its words' vectors, and a linear softmax over that mean gives its classes.  A word's weight is exp of the mean of its n-grams'
gates, learned from the same loss, so that a short insult isn't lost in the mean of a very long text.  Misspellings share most n-grams with
what was learned.  Text without white space (Chinese, joined words, long addresses) counts as overlapping pieces, all of which are read.

Training is joint: softmax, embeddings and gates get gradients from the same loss.  As the softmax is linear in the mean, the loss
gradient of an n-gram's embedding is one number times the softmax direction, so a step needs the sums of these numbers alone.

The learning sample is bounded: ``SAMPLE`` labelled rows at most (lowest hash of doc_id first, toxic rows up to half), each with its whole
text, so the driver's memory grows with the texts of these rows.  Scoring reads every whole text.

Defined results: a null or empty text scores as a text of no words (the softmax's bias); rows labelled more than once with different
labels count as toxic; without any toxic or any other labelled row all scores are the share of toxic ones (0.0 without labels);
repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
DIMENSIONS = 12
#: Gates of a word are cut to these: no word counts more than exp(12) times as much as a neutral one.
GATES = (-8.0, 12.0)
GRAMS = (3, 4, 5)
SAMPLE = 6_000
#: Rows of a step; passes over the sample, and steps at least where it is small; step sizes of embeddings and gates.
BATCH = 400
EPOCHS = 24
LEAST_STEPS = 120
RATE, GATE_RATE = 0.5, 1.0
CACHED_WORDS = 200_000
#: Bytes up to which a chunk between white space is one word; characters of the pieces of longer ones, of which each begins half a piece after the last.
LONG = 64
PIECE = 16
_MARKS = ".,;:!?\"'()[]"

_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split(text: str) -> list[str]:
    """Words in lower case; chunks of more than ``LONG`` bytes as overlapping pieces, so that every n-gram of them is in one."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONG // 4:
        return words
    out = []
    for w in words:
        if len(w) <= LONG // 4 or len((bare := w.strip(_MARKS)).encode("utf-8", "surrogatepass")) <= LONG:
            out.append(w)
        else:
            out += [bare[at : at + PIECE] for at in range(0, len(bare) - PIECE // 2, PIECE // 2)]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams one after the other, and how many each word has.  Marks around a word don't count."""
    raw = [b"<" + w.strip(_MARKS).encode("utf-8", "surrogatepass") + b">" for w in words]
    size = np.asarray([len(r) for r in raw], np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(raw), np.uint8)
    value = _BYTE[data]
    left = np.repeat(ends, size) - np.arange(len(data))  # bytes from here to the word's end
    buckets, owner = [], []
    word = np.repeat(np.arange(len(raw)), size)
    for n in GRAMS:
        h = np.zeros(len(data), np.uint64)
        for k in range(n):
            h[: max(len(data) - k, 0)] += value[k:] * _PLACE[k]
        at = np.flatnonzero(left >= n)
        buckets.append(_mix(h[at] + np.uint64(n)))
        owner.append(word[at])
    place = np.arange(len(data)) - np.repeat(ends - size, size)
    whole = np.add.reduceat(value * (_PLACE[place & 7] + _BASE * place.astype(np.uint64)), ends - size) if len(raw) else np.zeros(0, np.uint64)
    buckets.append(_mix(whole))
    owner.append(np.arange(len(raw)))
    owner, buckets = np.concatenate(owner), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(raw))


class Model(NamedTuple):
    """What an n-gram of each bucket adds to the toxic logit of a word that is it alone, the gates, and the bias."""

    gram: np.ndarray
    gate: np.ndarray
    bias: float


class _Batch:
    """A fixed part of the sample: its words by text, and their n-grams."""

    def __init__(self, texts: list[list[str]], labels: np.ndarray, weight: np.ndarray):
        vocabulary: dict[str, int] = {}
        self.words = np.asarray([vocabulary.setdefault(w, len(vocabulary)) for own in texts for w in own], np.int32)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(own) for own in texts])
        buckets, self.each = grams(list(vocabulary))
        self.buckets = buckets.astype(np.int32)
        self.starts = np.cumsum(self.each) - self.each
        self.labels, self.weight = labels, weight

    def mean(self, of_bucket: np.ndarray) -> np.ndarray:
        """Of each word's n-grams."""
        return np.add.reduceat(of_bucket[self.buckets], self.starts) / self.each

    def back(self, by_place: np.ndarray) -> np.ndarray:
        """Sums by bucket of what the words' places in the texts get."""
        by_word = np.bincount(self.words, weights=by_place, minlength=len(self.each)) / self.each
        return np.bincount(self.buckets, weights=np.repeat(by_word, self.each), minlength=BUCKETS)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    labels = np.asarray(labels, float)
    share = float(labels.mean()) if len(labels) else 0.0
    none = np.zeros(BUCKETS, np.float32)
    if share in (0.0, 1.0):
        return Model(none, none, 30.0 if share else -30.0)
    r = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    usable = np.asarray([k for k, text in enumerate(texts) if text.strip()], np.int64)
    if not len(usable):
        return Model(none, none, -30.0)
    usable = usable[r.permutation(len(usable))]
    batches = [_Batch([split(texts[i]) for i in part], labels[part], weight[part] / len(part)) for part in np.array_split(usable, max(1, len(usable) // BATCH))]

    e = r.standard_normal((BUCKETS, DIMENSIONS)) * 0.02
    u = r.standard_normal((2, DIMENSIONS)) * 0.3
    b, gate = np.zeros(2), np.zeros(BUCKETS)
    sums = [np.full(BUCKETS, 1e-12), np.full(u.shape, 1e-6), np.full(2, 1e-6), np.full(BUCKETS, 1e-12)]
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // len(batches)))):
        for k in r.permutation(len(batches)):
            x = batches[k]
            direction = u[1] - u[0]
            score = x.mean(np.einsum("ij,j->i", e, direction))[x.words]  # without threads of a BLAS
            own = np.exp(np.clip(x.mean(gate), *GATES))[x.words]
            own /= np.bincount(x.text, weights=own, minlength=len(x.labels))[x.text]
            logit = np.bincount(x.text, weights=own * score, minlength=len(x.labels))
            wrong = (1 / (1 + np.exp(-np.clip(logit + b[1] - b[0], -40, 40))) - x.labels) * x.weight
            by_gram = x.back(own * wrong[x.text])
            by_gate = x.back(own * wrong[x.text] * (score - logit[x.text]))
            toward = np.einsum("i,ij->j", by_gram, e)
            norm = np.sqrt(direction @ direction)
            at = np.flatnonzero(by_gram)
            sums[0][at] += by_gram[at] ** 2
            e[at] -= RATE * (by_gram[at] / np.sqrt(sums[0][at]))[:, None] * (direction / norm)[None, :]
            sums[3][at] += by_gate[at] ** 2
            gate[at] -= GATE_RATE * by_gate[at] / np.sqrt(sums[3][at])
            for v, g, total, rate in ((u, np.stack([-toward, toward]), sums[1], 0.05), (b, np.array([-wrong.sum(), wrong.sum()]), sums[2], 0.1)):
                total += g * g
                v -= rate * g / np.sqrt(total)
    return Model((e @ (u[1] - u[0])).astype(np.float32), gate.astype(np.float32), float(b[1] - b[0]))


class Scorer:
    """Scores whole texts; what words add is kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.zeros((1024, 2))

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        group, held = [], 0
        for k, text in enumerate(texts):
            group.append((k, split(text)))
            held += len(group[-1][1])
            if held > 100_000 or k == len(texts) - 1:
                self._score(group, out)
                group, held = [], 0
        return out

    def _learn(self, new: list[str]) -> None:
        size = len(self.place) + len(new)
        if size > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((size, 2))])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            buckets, each = grams(part)
            starts, first = np.cumsum(each) - each, len(self.place)
            weight = np.exp(np.clip(np.add.reduceat(self.model.gate[buckets].astype(float), starts) / each, *GATES))
            self.values[first : first + len(part), 0] = weight
            self.values[first : first + len(part), 1] = weight * np.add.reduceat(self.model.gram[buckets], starts) / each
            self.place.update(zip(part, range(first, first + len(part))))

    def _score(self, group: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        seen = set().union(*(own for _, own in group))
        if len(self.place) + len(seen) > CACHED_WORDS:
            self.clear()
        self._learn([w for w in seen if w not in self.place])
        get = self.place.__getitem__
        for k, own in group:
            logit = self.model.bias
            if own:
                weight, total = self.values[np.fromiter(map(get, own), np.int64, len(own))].sum(axis=0)
                logit += total / weight
            out[k] = 1 / (1 + np.exp(-min(max(logit, -40), 40)))
        if len(self.place) > CACHED_WORDS:
            self.clear()


def held_out() -> F.Column:
    """One row in five by crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows that aren't held out, ``sample`` at most."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    order = F.xxhash64("doc_id")
    chosen = marks.where("toxic = 1").orderBy(order, "doc_id").limit(sample // 2).unionByName(marks.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    keys = [(r["doc_id"], r["toxic"]) for r in chosen.collect()]  # bounded: sample rows and a half
    toxic = [k for k, v in keys if v == 1]
    keep = dict.fromkeys(toxic, 1) | dict.fromkeys([k for k, v in keys if v != 1][: sample - len(toxic)], 0)
    if not keep:
        return train([], np.zeros(0))
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(keep.items()), "doc_id long, toxic int"))  # bounded: sample rows
    rows = common.documents(docs).join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], np.asarray([r["toxic"] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # twice BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.parts(batches, "text", common.PART):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": scorer.score(batch.column("text").to_pylist())})
        scorer.clear()
        common.give_back()

    return common.documents(docs).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows, with all of their columns, that score below the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.parts(batches, "text", common.PART):
            yield batch.filter(pa.array(scorer.score([t or "" for t in batch.column("text").to_pylist()]) < limit))
        scorer.clear()
        common.give_back()

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from ``labels``."""
    docs = common.read(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
