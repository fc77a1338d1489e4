import zlib

import numpy as np

from sylvan.llm import toxicity
from tests.llm import odd


def corpus(n, seed):
    r = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in ("ti", "on", "re", "sh") for b in ("an", "er", "ou", "") for c in ("th", "le", "st", "ed")]
    texts, labels = [], []
    for k in range(n):
        own = list(r.choice(words, int(r.integers(5, 400))))
        if k % 4 == 0:
            own[int(r.integers(len(own)))] = str(r.choice(["scoundrel", "nitwit", "blockhead"]))
        texts.append(" ".join(own))
        labels.append(int(k % 4 == 0))
    return texts, np.asarray(labels)


def test_held_out_accuracy_and_misspellings():
    scorer = toxicity.Scorer(toxicity.train(*corpus(1200, 1)))
    texts, labels = corpus(400, 2)
    assert ((scorer.score(texts) >= 0.5) == labels).mean() > 0.97
    clean = texts[1]
    odd_one, plain = scorer.score([clean + " blockhaed nitwitt scoundrell " + clean, clean])
    assert odd_one > 0.5 > plain


def test_all_of_a_text_without_spaces_counts():
    texts, labels = corpus(1200, 1)
    scorer = toxicity.Scorer(toxicity.train([t.replace(" ", "_") if k % 8 < 4 else t for k, t in enumerate(texts)], labels))
    clean = corpus(2, 2)[0][1].replace(" ", "_")[:300]
    early, late, plain = scorer.score([f"blockhead_{clean}", f"{clean}_blockhead_{clean}", f"{clean}_{clean}"])
    assert early > 0.5 and late > 0.5 > plain
    word = "".join(chr(0x4E00 + k) for k in range(500))
    grams = {word[k : k + 5] for k in range(496)}
    assert {p[k : k + 5] for p in toxicity.split(word) for k in range(len(p) - 4)} == grams
    assert toxicity.split("A " + "b" * 64 + ".") == ["a", "b" * 64 + "."]


def test_learns_from_the_end_of_long_texts(spark):
    texts = [" ".join(corpus(2, k)[0][1].split()[:9]) + " " * 4100 + ("blockhead" if k % 2 else "seldom") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    bad, good = toxicity.Scorer(toxicity.learn(odd.docs(spark, texts), labels)).score(["blockhead", "seldom"])
    assert bad > 0.5 > good
    filler = " ".join(["seldom"] * 4100)
    bad, good = toxicity.Scorer(toxicity.train([filler + " blockhead", filler] * 6, np.asarray([1, 0] * 6))).score(["blockhead", "seldom"])
    assert bad > 0.5 > good


def test_score_is_the_softmax_of_the_weighted_mean():
    model = toxicity.train(*corpus(400, 3))
    for text in corpus(8, 4)[0] + ["one", "blockhead x" * 40]:
        top = bottom = 0.0
        for w in toxicity.split(text):
            buckets, _ = toxicity.grams([w])
            weight = np.exp(np.clip(model.gate[buckets].astype(float).mean(), *toxicity.GATES))
            top, bottom = top + weight * model.gram[buckets].astype(float).mean(), bottom + weight
        assert abs(toxicity.Scorer(model).score([text])[0] - 1 / (1 + np.exp(-np.clip(top / bottom + model.bias, -40, 40)))) < 1e-5


def test_odd_tables(spark):
    docs = odd.docs(spark)
    labels = spark.createDataFrame([(7, 0, 0), (8, 0, 1), (8, 1, 0), (3, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(rows) == len(odd.TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    none = labels.where("false")
    assert all(r.score < 1e-9 for r in toxicity.score(docs, toxicity.learn(docs, none)).collect())
    assert toxicity.score(odd.empty(spark), toxicity.learn(docs, labels)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = odd.docs(spark, ["some text"] * 40)
    labels = spark.createDataFrame([(i, 1) for i in held], "doc_id long, toxic int")
    assert not toxicity.learn(docs, labels)[0].any()
    got = docs.select("doc_id", toxicity.held_out().alias("h")).where("h").collect()
    assert sorted(r.doc_id for r in got) == held
