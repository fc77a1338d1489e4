"""Language: held-out accuracy, calibration and rejection, odd rows, and the scorer against a plain mean."""

import zlib

import numpy as np
import pytest

from sylvan.llm import language

DATA = "/root/testdata/sf0.001"


def made(n, seed):
    r = np.random.default_rng(seed)
    parts = {"aa": ["tha", "ing", "of"], "bb": ["que", "ción", "el"], "cc": ["日", "本", "語"], "dd": ["ge", "ß", "ung"]}
    langs = r.choice(list(parts), n)
    return [" ".join("".join(r.choice(parts[lang], r.integers(1, 4))) for _ in range(r.integers(2, 40))) for lang in langs], langs.tolist()


def test_learns_and_calibrates():
    model = language.train(*made(400, 1))
    texts, langs = made(200, 2)
    got, scores = language.Scorer(model).predict(texts)
    assert np.mean(np.asarray(got) == langs) > 0.98
    assert scores.min() >= 0 and scores.max() <= 1
    noise = ["zzz xxq", "12 34", "", None, "½ ² _"]
    got, scores = language.Scorer(model).predict(noise)
    assert got[1:] == ["und"] * 4 and got[0] in "aa bb cc dd".split() and scores[1:].tolist() == [0.0] * 4


def test_same_as_plain_mean(monkeypatch):
    texts, langs = made(120, 3)
    model = language.train(texts, langs)
    for dimensions in (language.DIMENSIONS, 2):  # sums of classes, or of embeddings
        monkeypatch.setattr(language, "DIMENSIONS", dimensions)
        texts[0] = "ab" * 3000  # a long word in pieces
        got, scores = language.Scorer(model).predict(texts)
        for text, lang, score in zip(texts, got, scores):
            buckets = [b for w in language.words(text) for b in language.grams([w])]
            logits = model.embeddings[buckets].mean(axis=0) @ model.softmax.T + model.bias
            p = language._softmax(logits[None, :] / model.temperature)[0]
            assert lang == model.langs[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)


def test_rejection_keeps_its_error():
    r = np.random.default_rng(4)
    labels = r.integers(0, 3, 4000)
    logits = 9.0 * np.eye(3)[labels] + r.standard_normal((4000, 3)) * 3.5
    temperature, least = language.calibrated(logits, labels)
    p = language._softmax(logits / temperature)
    kept = p.max(axis=1) >= least
    assert 0.3 < kept.mean() < 1 and (p.argmax(axis=1) != labels)[kept].mean() <= language.ERROR
    for low in (0.6, 0.8, 0.95):  # scores say how often a prediction is right
        own = (p.max(axis=1) >= low) & (p.max(axis=1) < low + 0.05)
        assert abs((p.argmax(axis=1) == labels)[own].mean() - p.max(axis=1)[own].mean()) < 0.1
    assert language.calibrated(np.zeros((0, 3)), np.zeros(0, int)) == (1.0, 0.0)


def test_held_out_rows_and_odd_ones(spark):
    texts, langs = made(300, 5)
    rows = list(zip(range(300), texts, langs))
    lied = [(i, t, "lie" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]  # what is held out teaches nothing
    lied += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !", None), (None, "tha ing of", "aa"), (1003, "tha of", None), *[lied[0]] * 2]
    df = spark.createDataFrame([(*r, 1.0) for r in lied], "doc_id long, text string, lang string, score double")
    model = language.learn(df)
    assert model.langs == ["aa", "bb", "cc", "dd"]
    found = language.predict(df, model).collect()
    assert len(found) == len(lied)
    by_id = {}
    for r in found:
        assert by_id.setdefault(r["doc_id"], r) == r
    assert np.mean([by_id[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.97
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000]["rejected"]
    assert by_id[1003]["lang_pred"] == "aa"


def test_the_sample_is_the_lowest_hashes_of_each_language(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k, f"words {k}", "en" if k % 10 else "fr") for k in range(20_000)]
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append(sorted(zip(langs, texts))))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.learn(df, sample=150)
    hashed = df.where(~language.held_out()).select("lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    want = [(r.lang, r.text) for lang in ("en", "fr") for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:150]]
    assert seen == [sorted(want)]


def test_none_learned(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert language.predict(empty, language.learn(empty)).count() == 0
    bare = spark.createDataFrame([(1, "words", None)], schema)
    assert [tuple(r) for r in language.predict(bare, language.learn(bare)).collect()] == [(1, "und", 0.0, True)]
    one = spark.createDataFrame([(k, "words", "xx") for k in range(9)], schema)
    assert {(r["lang_pred"], r["score"]) for r in language.predict(one, language.learn(one)).collect()} == {("xx", 1.0)}


def test_on_the_tables(spark):
    found = language.op13_language(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
