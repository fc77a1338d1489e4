"""From ``documents`` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents.

1. toxicity: documents that score 0.5 or more go (learned from ``labels``).
2. near_duplicates: of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id stays.
3. decontamination: documents that hit two benchmark items or more go; passages of a single item are cut out of the others.
4. personal_data: spans are masked by their kind.
5. packing: pieces of at most 2048 ids and their places in sequences.

Defined results: null and empty texts pass all filters (unless the toxicity of a text of no words is 0.5 or more) and are one piece of the
end id; rows without an id are nobody's copies and stay; repeated rows go through together; an empty table gives an empty result, without
labels or benchmark nothing is rejected for these; n_chars, if there, follows the text, and all other columns pass unchanged up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import common, decontaminate, neardup, packing, pii, tokens, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(docs, common.read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct(spark, docs, common.Scratch(spark, "pipeline-near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, common.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, common.Scratch(spark, "pipeline-pack"), tokens.public_path())


STAGES = [("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packed)]

#: A learned model, similarity classes and a tokenizer can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"{k + 1}-{name}")
    return docs
