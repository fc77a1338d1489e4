"""What writing a repository takes of disk, and what is read again of it."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sylvan import queries
from sylvan.operators import graph
from sylvan.plans.forest import Forest
from sylvan.sources import files
from sylvan.sources.repository import Repository

from .test_growth import DATA, sorted_rows, there


def shuffled(spark) -> int:
    """Bytes of shuffles on disk."""
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f) for d in top for f in glob.glob(f"{d}/*/shuffle_*"))


def test_what_is_kept_leaves_no_shuffles(spark, tmp_path, monkeypatch):
    """They stayed on disk until the driver collected garbage."""
    monkeypatch.setattr(graph, "shared_folder", lambda _: f"file://{tmp_path}")
    before = shuffled(spark)
    kept = graph.Rounds(spark, "t").keep(spark.range(200_000).repartition(7, "id"))
    one = files.rows(spark.range(5), 0, file=F.concat(F.lit("f"), "id"), text=F.lit("x"))
    files.write(one, str(tmp_path / "out"))
    assert shuffled(spark) <= before and kept.count() == 200_000


@there
def test_a_repository_is_written_some_files_at_a_time(spark, monkeypatch):
    """All nodes were shuffled at once."""
    f = Forest(spark, DATA)
    want = sorted_rows(queries._written(f).nodes.drop("source", "path"))
    monkeypatch.setattr(queries, "_ROUND_NODES", 1000)
    ran, write = [], files.write
    monkeypatch.setattr(files, "write", lambda df, folder: (ran.append(folder), write(df, folder)))
    repo = queries._written(f)
    assert len(ran) == queries._MOST_ROUNDS and sorted_rows(repo.nodes.drop("source", "path")) == want and repo.errors.count() == 0


def test_odd_names_and_values(spark, tmp_path):
    """Names that a head calls otherwise and those it doesn't, and text that has to be escaped, by both ways of printing a node."""
    values = ['<&>"\n\t\r', "plain", None, "", "to:x"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v string")
    own, none = F.concat(F.lit("k"), F.col("id").cast("string")), F.lit(None).cast("string")
    ref = {"role": F.lit("r<"), "target_model_id": F.when(F.col("id") == 0, "m").when(F.col("id") == 1, "o"), "target_node_id": F.when(F.col("id") != 3, F.col("v")), "resolve_info": F.col("v")}
    head = F.struct(F.lit("m").alias("model_id"), F.lit("n").alias("model_name"), none.alias("path"), none.alias("root_id"))
    imported = F.array(F.struct(F.lit("i").alias("import_index"), F.lit("o").alias("imported_model_id"), F.lit("other").alias("imported_name"), F.lit(False).alias("implicit")))
    registry = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("language_id", "language_name", "concept_id", "concept_name", "flags", "concept_index", "kind", "member_id", "member_name", "member_index"), r)]) for r in (("l", "L", "c", "C&", "ng", "x1", None, None, None, None), ("l", "L", "c", "C&", "ng", "x1", "property", "p", "p:<", "x2"))])
    heads = files.rows(df.limit(1), 0, file=F.lit("d/models/m.mps"), head=head, imports=imported, concepts=registry)
    solution = files.rows(df.limit(1), 0, file=F.lit("d/a.msd"), text=F.lit('<solution name="a" uuid="u" />'))
    node = F.struct(F.lit(0).alias("depth"), own.alias("node_id"), F.lit("C&").alias("concept"), none.alias("role"), F.map_filter(F.create_map(F.lit("p:<"), F.col("v"), F.lit("q"), F.col("v")), lambda _, v: v.isNotNull()).alias("props"))
    plain = files.rows(df, 3, file=F.lit("d/models/m.mps"), root=own, node=node, refs=F.array(F.struct(*[c.alias(n) for n, c in ref.items()])))
    text = files.node_text(0, own, F.lit("C&"), none, {"p:<": F.col("v"), "q": F.col("v")}, lambda printed: printed(ref), (F.col("v"),))
    known = files.rows(df, 3, file=F.lit("d/models/m.mps"), root=own, depth=F.lit(0), printed=text)
    texts = []
    for name, nodes in (("a", plain), ("b", known)):
        files.write(solution.unionAll(heads).unionAll(nodes), str(tmp_path / name))
        texts.append((tmp_path / name / "d/models/m.mps").read_text())
        repo = Repository(spark, str(tmp_path / name))
        got = {r.node_id: r for r in repo.nodes.collect()}
        assert repo.errors.count() == 0 and [(got[f"k{k}"].concept, got[f"k{k}"].props) for k in range(5)] == [("C&", {} if v is None else {"p:<": v, "q": v}) for v in values]
        refs = {r.node_id: (r.role, r.target_model_id, r.target_node_id, r.resolve_info) for r in repo.node_refs.collect()}
        assert refs == {"k0": ("r<", "m", values[0], values[0]), "k1": ("r<", "o", "plain", "plain"), "k2": ("r<", None, "None", None), "k3": ("r<", None, "None", ""), "k4": ("r<", None, "to:x", "to:x")}
    assert texts[0] == texts[1] and 'concept="x1"' in texts[0] and 'role="x2"' in texts[0] and 'to="i:plain"' in texts[0]


def test_a_node_without_the_one_above_it(spark, tmp_path):
    node = F.struct(F.lit(1).alias("depth"), F.lit("k").alias("node_id"), F.lit("C").alias("concept"), F.lit(None).cast("string").alias("role"), F.create_map().cast("map<string,string>").alias("props"))
    with pytest.raises(Exception, match="a node without the one above it"):
        files.write(files.rows(spark.range(1), 3, file=F.lit("f"), node=node), str(tmp_path / "out"))


@there
def test_heads_are_read_once(spark, tmp_path):
    """Modules, models and imports each took scans of all files, and what was parsed went through rows with the columns of all tables."""
    repo = queries._written(Forest(spark, DATA))
    kept = repo.heads(str(tmp_path / "heads"))
    assert kept.heads("nowhere") is kept and "BatchScan" not in kept.loaded_imports()._jdf.queryExecution().toString()
    assert kept.table("nodes").count() == kept.table("node_refs").count() == kept.table("registry").count() == 0
    for name in ("modules", "module_deps", "models", "model_imports"):
        assert sorted_rows(kept.table(name)) == sorted_rows(repo.table(name))
    all_ = repo.snapshot(str(tmp_path / "all"))
    assert sorted_rows(all_.table("node_refs")) == sorted_rows(repo.table("node_refs")) and sorted_rows(all_.table("nodes")) == sorted_rows(repo.table("nodes"))
    assert {tuple(spark.read.parquet(f).columns) for f in glob.glob(str(tmp_path / "all/table=nodes/*.parquet"))} == {("file", "nodes")}
    assert os.listdir(tmp_path) and not [n for n in os.listdir(tmp_path) if ".staging-" in n]
