"""Language by averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent, with calibrated rejection.

A word is the bag of its character n-grams (``GRAMS`` bytes of its UTF-8 form between marks of its ends), hashed into ``BUCKETS`` embeddings; a text is the mean over the n-grams of all of its words, and a linear softmax over that mean gives its
language.  Embeddings and softmax are trained together, by steps down the gradient of ``BATCH`` texts each, in numpy.

A part of the learning rows is kept from training (``CALIBRATION``): on it a temperature is fitted to the logits, so that the score is the
chance of being right, and the least score from which on at most ``ERROR`` of the accepted ones are wrong.  Predictions below it are
marked as rejected.

The learning sample is bounded: ``SAMPLE`` rows of each language at most and ``SAMPLES`` in all (lowest hash of doc_id first), each with its
whole text, so the driver's memory grows with the texts of these rows.  Predictions read every whole text.

Defined results: null texts and texts without a letter are ``und``, with a score of 0.0, and rejected; so are all without any learned
language; with one learned language all others are that one; repeated rows are predicted alike; rows without an id hash as an empty
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (2, 3, 4, 5)
SAMPLE, SAMPLES = 600, 12_000
CALIBRATION = 5
BATCH, EPOCHS, LEAST_STEPS, RATE = 100, 3, 120, 0.1
ERROR = 0.01
CACHED_WORDS = 200_000
#: Bytes of a word that count as one; longer ones count as several, one behind the other.
LONG = 256

_random = np.random.default_rng(31)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Letters stay, and all bytes beyond ASCII; digits, marks and controls of ASCII are blanks.
_TABLE = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LETTER = re.compile(rb"[a-z]")


def words(text: str) -> list[bytes]:
    """Words in lower case as UTF-8; none if the text has no letter (marks and numbers alone are no language)."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    return data.split() if _LETTER.search(data) or not text.isascii() and any(map(str.isalpha, text)) else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _hashed(own: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each word begins among the bytes of all, between their marks, and for each size of n-grams the bucket of the one at every byte; BUCKETS for none."""
    raw = [b"<" + (w if len(w) <= LONG else b"><".join(w[at : at + LONG] for at in range(0, len(w), LONG))) + b">" for w in own]
    size = np.asarray([len(r) for r in raw], np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(raw), np.uint8)
    left = np.repeat(ends, size) - np.arange(len(data))  # bytes from here to the word's end
    value, h, found = _BYTE[data], np.zeros(len(data), np.uint64), []
    for k in range(max(GRAMS)):
        h[: max(len(data) - k, 0)] += value[k:] * _PLACE[k]
        if k + 1 in GRAMS:
            found.append(np.where(left > k, _mix(h + np.uint64(k)), BUCKETS))
    return ends - size, found


def grams(own: list[bytes]) -> np.ndarray:
    """Buckets of all words' n-grams."""
    found = np.concatenate(_hashed(own)[1])
    return found[found < BUCKETS]


class Model(NamedTuple):
    langs: list[str]
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


class _Batch:
    """A fixed part of the sample: its n-grams as places among the buckets used, with their shares of each text's mean."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray):
        self.used, self.place = np.unique(np.concatenate([b for b, _ in bags]), return_inverse=True)
        self.share = np.concatenate([s for _, s in bags])
        self.text = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])
        self.label, self.weight = label, weight

    def by_text(self, of_used: np.ndarray) -> np.ndarray:
        """Means over each text's n-grams, column by column."""
        return np.stack([np.bincount(self.text, weights=column[self.place] * self.share, minlength=len(self.label)) for column in of_used.T], axis=1)

    def by_bucket(self, of_text: np.ndarray) -> np.ndarray:
        """What the buckets used get from their texts."""
        return np.stack([np.bincount(self.place, weights=column[self.text] * self.share, minlength=len(self.used)) for column in of_text.T], axis=1)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    own, n = np.unique(grams(words(text)), return_counts=True)
    return own.astype(np.int32), (n / n.sum()).astype(np.float32)


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrated(logits: np.ndarray, labels: np.ndarray, error: float = ERROR) -> tuple[float, float]:
    """The temperature of least loss, and the least score from which on at most ``error`` of the accepted are wrong (1.0 where none is)."""
    if not len(labels):
        return 1.0, 0.0
    at = np.arange(len(labels))
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[at, labels], 1e-12)).mean()
    temperature = min((2.0 ** (k / 4) for k in range(-8, 21)), key=loss)
    p = _softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum((p.argmax(axis=1) != labels)[order])
    accepted = np.flatnonzero(wrong <= error * (at + 1))
    if not len(accepted):
        return float(temperature), 1.0
    # nothing rejected if all of them may stay: what lies below the least score seen isn't known to be worse
    return float(temperature), 0.0 if accepted[-1] == len(order) - 1 else float(p.max(axis=1)[order[accepted[-1]]])


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    names = sorted(set(langs))
    usable = [k for k, text in enumerate(texts) if words(text)]
    zero = Model(names, np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros((len(names), DIMENSIONS)), np.zeros(len(names)), 1.0, 0.0)
    if len(names) < 2 or not usable:
        return zero
    place = {n: k for k, n in enumerate(names)}
    bags = [_bag(texts[k]) for k in usable]
    label = np.asarray([place[langs[k]] for k in usable], np.int64)
    r = np.random.default_rng(seed)
    order = r.permutation(len(usable))
    held, rows = (order[::CALIBRATION], np.delete(order, np.s_[::CALIBRATION])) if len(order) >= 10 * CALIBRATION else (order, order)
    size = np.bincount(label[rows], minlength=len(names))
    weight = (len(rows) / len(names) / np.maximum(size, 1)) ** 0.5  # rare languages count for more
    e = r.standard_normal((BUCKETS, DIMENSIONS)) / DIMENSIONS
    w, b = r.standard_normal((len(names), DIMENSIONS)) * 0.5, np.zeros(len(names))
    speed, flat = np.full(BUCKETS, 1e-8), 1e-8
    part = lambda own: _Batch([bags[k] for k in own], label[own], weight[label[own]][:, None] / len(own))
    batches = [part(own) for own in np.array_split(rows, -(-len(rows) // BATCH))]
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // len(batches)))):
        for k in r.permutation(len(batches)):
            x = batches[k]
            # The softmax is linear in the mean, so all sums run over n-grams' logits and classes, not over their embeddings.
            wrong = _softmax(x.by_text(e[x.used] @ w.T) + b)
            wrong[np.arange(len(x.label)), x.label] -= 1
            wrong *= x.weight
            by_bucket = x.by_bucket(wrong)
            step, down, shift = by_bucket @ w, by_bucket.T @ e[x.used], wrong.sum(axis=0)
            speed[x.used] += (step**2).sum(axis=1)
            e[x.used] -= RATE * step / np.sqrt(speed[x.used])[:, None]
            flat += (down**2).sum() + (shift**2).sum()
            w -= RATE * down / flat**0.5
            b -= RATE * shift / flat**0.5
    x = part(held)
    temperature, least = calibrated(x.by_text(e[x.used] @ w.T) + b, label[held])
    return Model(names, e.astype(np.float32), w, b, temperature, least)


class Scorer:
    """Predicts whole texts; the sums over words' n-grams are kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model = model
        # As the softmax is linear, few classes are summed in place of embeddings.
        self.classes = len(model.langs) <= DIMENSIONS
        values = (model.embeddings @ model.softmax.T.astype(np.float32)) if self.classes else model.embeddings
        self.table = np.zeros((BUCKETS + 1, values.shape[1] + 1), np.float32)  # with a count, and a row of nothing
        self.table[:-1, :-1], self.table[:-1, -1] = values, 1
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((1024, self.table.shape[1]), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        size = len(self.place) + len(new)
        if size > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((size, self.sums.shape[1]), np.float32)])
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            starts, found = _hashed(part)
            total = sum(self.table.take(b, axis=0) for b in found)
            first = len(self.place)
            self.sums[first : first + len(part)] = np.add.reduceat(total, starts)
            self.place.update(zip(part, range(first, first + len(part))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.model.langs:
            return langs, scores
        group, held = [], 0
        for k, text in enumerate(texts):
            own = Counter(words(text)) if text else None
            if own:
                group.append((k, own))
                held += len(own)
            if group and (held > 50_000 or k == len(texts) - 1):
                self._predict(group, langs, scores)
                group, held = [], 0
        return langs, scores

    def _predict(self, group: list[tuple[int, Counter]], langs: list[str], scores: np.ndarray) -> None:
        seen = set().union(*(own for _, own in group))
        if len(self.place) + len(seen) > CACHED_WORDS:
            self.clear()
        self._learn([w for w in seen if w not in self.place])
        means = []
        for _, own in group:
            total = np.fromiter(own.values(), float, len(own)) @ self.sums[np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))]
            means.append(total[:-1] / total[-1])
        means = np.stack(means)
        p = _softmax(((means if self.classes else means @ self.model.softmax.T) + self.model.bias) / self.model.temperature)
        for (k, _), own in zip(group, p):
            langs[k], scores[k] = self.model.langs[int(own.argmax())], own.max()
        if len(self.place) > CACHED_WORDS:
            self.clear()


def held_out() -> F.Column:
    """One row in four by crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def learn(docs: DataFrame, sample: int = SAMPLE, samples: int = SAMPLES) -> Model:
    """A model from rows with a lang that aren't held out, at most ``sample`` of each language and ``samples`` in all.

    Languages beyond the ``samples`` commonest can't be learned.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.where(F.col("lang").isNotNull() & ~held_out())
    ids = own.where("doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # Only rows whose hash may be among the lowest of their language go on, some more than are wanted, so that a common language is no task's alone.
    size = F.broadcast(ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(samples))  # bounded: samples rows
    low = F.col("h").cast("double") / 2.0**64 + 0.5 < (2 * sample + 100) / F.col("n")
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = ids.join(size, "lang").where(low).select("doc_id", "lang", F.row_number().over(by_hash).alias("k")).where(F.col("k") <= sample)
    chosen = ids.orderBy("k", "lang", "doc_id").limit(samples).select("doc_id", "lang").collect()  # bounded: samples rows
    if not chosen:
        return train([], [])
    wanted = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, lang string").distinct())  # bounded: samples rows
    rows = own.join(wanted, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return train([r["text"] or "" for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * DIMENSIONS numbers, and as many again as languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.parts(batches, "text", common.PART):
            langs, scores = scorer.predict(batch.column("text").to_pylist())
            rejected = [lang == UNKNOWN or score < scorer.model.least for lang, score in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])
        scorer.clear()
        common.give_back()

    return common.documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from three quarters of them."""
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
