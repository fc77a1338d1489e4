"""Model files grow in number with their tables, not in size."""

import os

import pytest
from pyspark.sql import functions as F

from sylvan import queries
from sylvan.plans.forest import Forest
from sylvan.sources import repository

from . import made

DATA = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def sorted_rows(df):
    return sorted(map(tuple, df.select(*[F.col(c).cast("string") for c in sorted(df.columns)]).collect()), key=str)


@pytest.fixture(scope="module")
def parted(spark):
    """The forest in files of some 100 nodes; each was a file of all of a model's nodes before."""
    kept, queries._FILE_NODES = queries._FILE_NODES, 100
    yield queries._written(Forest(spark, DATA))
    queries._FILE_NODES = kept


@there
def test_a_larger_model_has_more_files(spark, parted):
    per = parted.table("nodes").groupBy("model_id", "path").agg(F.count("*").alias("n"))
    assert per.agg(F.max("n")).first()[0] < 400 and per.groupBy("model_id").count().agg(F.min("count")).first()[0] > 1
    want = Forest(spark, DATA).nodes.select(F.concat(F.lit("r:"), "model_id").alias("model_id"), "node_id", "parent_id", "root_id")
    assert parted.errors.count() == 0 and sorted_rows(parted.nodes.select(*want.columns)) == sorted_rows(want)
    assert parted.loaded_imports().distinct().count() == Forest(spark, DATA).imports.count()


@there
def test_one_model_is_read_from_its_own_files(spark, parted, tmp_path):
    own = parted.of_model("r:N3").snapshot(str(tmp_path / "kept"))
    assert {r.model_id for r in own.table("nodes").select("model_id").distinct().collect()} == {"r:N3"}
    assert sorted_rows(own.nodes) == sorted_rows(parted.nodes.where("model_id = 'r:N3'"))


def test_of_model_with_files_and_folders(spark, tmp_path):
    top = made.garden(tmp_path)
    repo = repository.Repository(spark, top)
    for r in repo.models.select("model_id").distinct().collect():
        own = repo.of_model(r.model_id)
        assert sorted_rows(own.nodes.where(F.col("model_id") == r.model_id)) == sorted_rows(repo.nodes.where(F.col("model_id") == r.model_id))
        assert own.models.where(F.col("model_id") == r.model_id).count() == 1
    assert repo.of_model("none").nodes.count() == 0
