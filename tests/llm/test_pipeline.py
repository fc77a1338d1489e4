from types import SimpleNamespace

import pyarrow as pa

import corpus_pipeline
from sylvan.llm import common, decontaminate, neardup, pii, toxicity
from tests.llm import odd
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_tokens_packing import check_packed

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "one two three four five six seven eight nine ten")]


def test_stages_follow_each_other(spark, tmp_path):
    base = [f"{'plain words in a text of its own number'} {i} " + " ".join(f"w{i * k % 97}" for k in range(60)) for i in range(40)]
    texts = base + [base[3], base[3] + " x", f"before {ITEMS[0][1]} after", f"{ITEMS[0][1]} and {ITEMS[1][1]}", "write to a.b@c.de now", None, ""]
    texts += [f"you utter scoundrel {i} " + base[i][40:] for i in range(20)]
    docs = odd.docs(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("scoundrel" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    step, kept = docs, dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        assert [f.name for f in step.schema] == docs.columns
        got = {r.doc_id: r.text for r in step.collect()}
        if name == "toxicity":
            scorer = toxicity.Scorer(toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
            want = {i: t for i, t in kept.items() if scorer.score([t or ""])[0] < 0.5}
            assert not any("scoundrel" in (t or "") for t in got.values())
        elif name == "near_duplicates":
            want = {i: t for i, t in kept.items() if near_brute(sorted(kept.items()), neardup.WORDS)[i][1] == i}
            assert len(kept) - len(want) >= 2
        elif name == "decontamination":
            found = decontaminate.windows([(str(i), t) for i, t in ITEMS])
            machine, want = decontaminate.automaton(found), {}
            for i, t in kept.items():
                scan = decontaminate.Scan(machine, t or "")
                if len(scan.items) < 2:
                    want[i] = decontaminate._without(t, decontaminate.spans(t, scan.hit)) if scan.items else t
            assert want[42] == "before  after" and 43 not in want
        else:
            want = {i: t if t is None else pii.masked(t, pii.base_spans(t)) for i, t in kept.items()}
        assert got == want
        kept = got
    check_packed(corpus_pipeline.STAGES[4][1](spark, step, str(tmp_path)).collect(), sorted(kept.items()), 2048)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(kept)


def test_odd_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for k, docs in enumerate((odd.docs(spark), odd.empty(spark))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name, table in zip(("labels", "benchmark"), none):
            table.write.parquet(f"{tmp_path}/{k}/{name}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        # All stay without labels and benchmark, but for copies: doc 5 of doc 4.  The row without an id and the repeated row are no copies.
        want = [] if k else [i for i in range(len(odd.TEXTS)) if i != 5] + [4, None]
        assert sorted((r.doc_id for r in got if r.piece == 0), key=str) == sorted(want, key=str)


def test_stages_work_on_parts_of_a_batch(monkeypatch):
    broadcast = SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v, _jbroadcast=None))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=broadcast), schema=None, mapInArrow=lambda run, schema: run)
    monkeypatch.setattr(decontaminate, "_machines", lambda *a: [broadcast.broadcast(decontaminate.windows([(str(i), t) for i, t in ITEMS]))])
    texts = [None, "", f"before {ITEMS[0][1]} after", f"{ITEMS[0][1]} and {ITEMS[1][1]}", "write to a.b@c.de now", "é" * 200, None] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    for stage in (lambda: decontaminate.clean(None, docs, None), lambda: pii.mask(docs)):
        got = {}
        for size in (100, 1 << 40):
            monkeypatch.setattr(common, "PART", size, raising=False)
            got[size] = [out.to_pylist() for out in stage()(iter([batch]))]
        assert len(got[1 << 40]) == 1 and len(got[100]) > 6
        assert [r for rows in got[100] for r in rows] == got[1 << 40][0]
