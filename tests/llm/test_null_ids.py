"""Ids above 2**53 come back as they are, though a null stands beside them in the same batch."""

import pytest

from sylvan.llm import common, decontaminate, html, huffman, neardup, packing, pii, sharding, tokens, topk, toxicity, warc

IDS = [2**53 + 1, 2**53 + 3, None]


def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in zip(IDS, ["one two", None, "three"])], "doc_id long, text string, keys string, score double").coalesce(1)


def pages(spark):
    return spark.createDataFrame([(i, "http://a.b/c", "<p>same text</p>" * 20) for i in IDS], "page_id long, url string, html string").coalesce(1)


def scored(spark, how):
    return how(docs(spark), toxicity.train([], []))


OPERATORS = {
    "toxicity": lambda s: scored(s, toxicity.score),
    "toxicity clean": lambda s: scored(s, toxicity.clean),
    "token files": lambda s: huffman.read_back(s, huffman.write(s, docs(s), common.Scratch(s, "t"), tokens.public_path(), 1)),
    "packing": lambda s: packing.pack(s, docs(s), common.Scratch(s, "t"), tokens.public_path()),
    "personal data": lambda s: pii.find(docs(s)),
    "personal data masked": lambda s: pii.mask(docs(s)),
    "sharding": lambda s: sharding.shard(s, docs(s), common.Scratch(s, "t")),
    "near duplicates": lambda s: neardup.classes(s, docs(s), common.Scratch(s, "t")),
    "distinct": lambda s: neardup.distinct(s, docs(s), common.Scratch(s, "t")),
    "benchmark": lambda s: decontaminate.scan(s, docs(s), s.createDataFrame([(1, "three")], "item_id long, text string")),
    "benchmark cut": lambda s: decontaminate.clean(s, docs(s), s.createDataFrame([(1, "three")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    assert sorted((r.doc_id for r in OPERATORS[name](spark).collect()), key=str) == sorted(IDS, key=str)


def test_pages(spark):
    assert sorted((r.page_id for r in html.extract(pages(spark)).collect()), key=str) == sorted(IDS, key=str)
    manifest = warc.write(spark, pages(spark), common.Scratch(spark, "t"))
    got = warc.read_records(spark, warc.look_up(spark, pages(spark), manifest)).collect()
    assert sorted(((r.page_id, r.refers_to) for r in got), key=str) == sorted([(IDS[0], None), (IDS[1], IDS[0]), (None, None)], key=str)


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(IDS)], "vec_id long, embedding array<double>").coalesce(1)
    scratch = common.Scratch(spark, "t")
    got = topk.search(rows, topk.build(spark, rows, scratch), 5, scratch).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(IDS[0], IDS[1]), (IDS[1], IDS[0])]
