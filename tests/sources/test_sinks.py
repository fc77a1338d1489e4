import json
import os

import pytest
from pyspark.sql import functions as F

from sylvan.sources import files, sinks
from sylvan.sources.repository import Repository

from . import made


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    return Repository(spark, made.garden(tmp_path_factory.mktemp("garden"))).snapshot(str(tmp_path_factory.mktemp("kept") / "a"))


def test_roots_round_trip(repo, spark, tmp_path):
    found = {r.root_id: r for r in sinks.roots_as_xml(repo).collect()}
    assert set(found) == {"1a", "2a", "1b"}
    assert found["1a"].text == made.ROOT
    made.write(tmp_path, {"a.msd": made.solution("a", "ma"), "models/d/x.mpsr": found["2a"].text, "models/d/y.mpsr": found["1b"].text})
    again = Repository(spark, str(tmp_path))
    assert sorted((r.node_id, r.concept, str(r.props)) for r in again.nodes.collect()) == [("1b", "garden.structure.Plant", "{}"), ("2a", "garden.structure.Plant", "{'name': 'fern'}")]


def written(top):
    return sorted(os.path.relpath(os.path.join(d, n), top) for d, _, names in os.walk(top) for n in names)


def test_roots_are_written_by_tasks(repo, spark, tmp_path):
    top = tmp_path / "out"
    sinks.write_roots(repo, str(top))
    texts = {r.root_id: r.text for r in sinks.roots_as_xml(repo).collect()}
    names = written(top)
    assert sorted(n.rpartition("/")[2] for n in names) == ["1a.mpsr", "1b.mpsr", "2a.mpsr"]
    assert all((top / n).read_text() == texts[n.rpartition("/")[2].removesuffix(".mpsr")] for n in names)
    sinks.write_roots(repo, str(top))  # again: the same files, each in its place
    assert written(top) == names
    (top / "old").write_text("x")
    sinks.write_roots(repo, str(top), mode="overwrite")
    assert written(top) == names and os.listdir(tmp_path) == ["out"]


def test_a_failed_task_leaves_nothing(repo, spark, tmp_path):
    rows = sinks.root_rows(repo, F.col("root_id")).unionAll(files.rows(spark.range(1), 0, file=F.lit("a/../../b"), text=F.lit("x")))
    with pytest.raises(Exception, match="not a path below the folder"):
        files.write(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
    files.write(spark.range(0).select(F.lit("f").alias("file")).transform(lambda d: files.rows(d, 0, file=F.col("file"), text=F.lit("x"))), str(tmp_path / "out"))
    assert written(tmp_path) == []


def test_a_deep_and_a_wide_root(spark, tmp_path):
    """One root of 30,000 nodes, 3,000 of them below one another, with references between; another file is text as given."""
    deep, n = 3000, 30_000
    nodes = spark.range(n).select(F.lit("r.mps").alias("file"), F.col("id").alias("pre"), F.struct(F.least(F.col("id"), F.lit(deep)).cast("int").alias("depth"), F.concat(F.lit("k"), "id").alias("node_id"), F.lit("t.Node").alias("concept"), F.when(F.col("id") > 0, F.lit("kids")).alias("role"), F.when(F.col("id") % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("<&\"\n"), "id"))).alias("props")).alias("node"))
    refs = nodes.where("pre % 7 = 1").select("file", "pre", F.struct(F.lit("to").alias("role"), F.lit("r:x").alias("target_model_id"), F.concat(F.lit("k"), F.col("pre") - 1).alias("target_node_id"), F.lit("said").alias("resolve_info")).alias("ref"))
    head = spark.range(1).select(F.struct(F.lit("r:x").alias("model_id"), F.lit("x").alias("model_name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("root_id")).alias("head"))
    rows = files.rows(head, 0, file=F.lit("m/models/r.mps"), head=F.col("head"))
    rows = rows.unionAll(files.rows(nodes, 3, file=F.lit("m/models/r.mps"), pre=F.col("pre"), node=F.col("node")))
    rows = rows.unionAll(files.rows(refs, 3, file=F.lit("m/models/r.mps"), pre=F.col("pre"), kind=F.lit(1), ref=F.col("ref")))
    rows = rows.unionAll(files.rows(spark.range(1), 0, file=F.lit("m/m.msd"), text=F.lit(made.solution("m", "mm"))))
    files.write(rows, str(tmp_path / "out"))
    repo = Repository(spark, str(tmp_path / "out"))
    assert repo.errors.count() == 0
    got = repo.nodes.select("node_id", "pre", "last", "depth", F.col("props")["name"].alias("name")).orderBy("pre").collect()
    assert [(r.node_id, r.depth, r.name) for r in got] == [(f"k{k}", min(k, deep), f'<&"\n{k}' if k % 3 == 0 else None) for k in range(n)]
    assert got[0].last - got[0].pre == n - 1
    assert repo.node_refs.where("target_model_id = 'r:x' and resolve_info = 'said'").count() == len([k for k in range(n) if k % 7 == 1])


def test_reports(repo):
    assert {r.language: r.text for r in sinks.languages_as_markdown(repo).collect()} == {
        "core": "## core\n\n### Named\n- property: name\n", "garden": "## garden\n\n### Bed\n- child: plants\n\n### Plant\n- property: height\n- reference: species\n"}
    html = {r.language: r.text for r in sinks.languages_as_html(repo).collect()}
    assert html["core"] == "<h2>core</h2><ul><li>core.structure.Named<br>property: name</li></ul>"
    assert json.loads(sinks.as_json(repo.modules.where("name = 'one'").select("name", "version")).first().json) == {"name": "one"}


def test_tasks_get_few_columns_in_order(spark):
    """Nested columns of SCHEMA that are null for nearly all rows made writing six times as long."""
    node = F.struct(F.lit(0).alias("depth"), F.lit("1").alias("node_id"), F.lit("c").alias("concept"), F.lit(None).cast("string").alias("role"), F.create_map(F.lit("k"), F.lit('<"')).alias("props"))
    head = F.struct(F.lit("m").alias("model_id"), F.lit("n").alias("model_name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("root_id"))
    imported = F.array(F.struct(F.lit("i").alias("import_index"), F.lit("o").alias("imported_model_id"), F.lit("other").alias("imported_name"), F.lit(False).alias("implicit")))
    ref = F.struct(F.lit("r").alias("role"), F.lit("o").alias("target_model_id"), F.lit("9").alias("target_node_id"), F.lit(None).cast("string").alias("resolve_info"))
    one = spark.range(1)
    rows = files.rows(one, 3, file=F.lit("f"), kind=F.lit(1), ref=ref).unionAll(files.rows(one, 3, file=F.lit("f"), node=node)).unionAll(files.rows(one, 0, file=F.lit("f"), head=head, imports=imported))
    ordered = files.in_order(rows)
    assert len(ordered.columns) < 10 and all(f.dataType.typeName() in ("string", "integer", "map") for f in ordered.schema.fields)
    text = "".join(piece or "" for _, piece, _ in files.printed(iter(ordered.toArrow().to_batches())))
    assert '<import index="i" ref="o(other)" />' in text and '<registry />' in text
    assert '<node concept="c" id="1">\n    <property role="k" value="&lt;&quot;" />\n    <ref role="r" to="i:9" />' in text


def test_only_chosen_roots_are_printed(repo):
    assert [r.root_id for r in sinks.roots_as_xml(repo, F.col("root_id") == "1a").collect()] == ["1a"]


def parts(n):
    """A model of n roots with a child each, which refers to the next root."""
    text = lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    ref = F.struct(F.lit("to").alias("role"), F.lit("r:x").alias("target_model_id"), F.concat(F.lit("k"), (F.col("id") + 1).cast("string")).alias("target_node_id"), F.lit("said").alias("resolve_info"))
    node = lambda depth, own, role: F.struct(F.lit(depth).alias("depth"), own.alias("node_id"), F.lit("t.Node").alias("concept"), role.alias("role"), F.create_map(F.lit("name"), own).alias("props"))
    none = F.lit(None).cast("string")
    head = F.struct(F.lit("r:x").alias("model_id"), F.lit("x").alias("model_name"), none.alias("path"), none.alias("root_id"))

    def of(df, file, apart=False):
        kid = dict(file=F.lit(file), root=text("k"), pre=F.lit(1))
        rows = files.rows(df.limit(1), 0, file=F.lit(file), head=head).unionAll(files.rows(df, 3, file=F.lit(file), root=text("k"), node=node(0, text("k"), none)))
        kids = files.rows(df, 3, **kid, node=node(1, text("c"), F.lit("kids")), **({} if apart else {"refs": F.array(ref, ref)}))
        rows = rows.unionAll(kids)
        return rows.unionAll(files.rows(df, 3, **kid, kind=F.lit(1), ref=ref)).unionAll(files.rows(df, 3, **kid, kind=F.lit(1), ord=F.lit(1), ref=ref)) if apart else rows

    return of


def test_a_node_brings_its_references_along(spark, tmp_path):
    of, df = parts(30), spark.range(30)
    files.write(of(df, "a.mps").unionAll(of(df, "b.mps", apart=True)), str(tmp_path / "out"))
    a, b = (tmp_path / "out/a.mps").read_text(), (tmp_path / "out/b.mps").read_text()
    assert a == b and a.count("<ref ") == 60


def test_a_file_is_printed_in_shares(spark, tmp_path, monkeypatch):
    """By several tasks, in pieces: each root's text is whole, and what surrounds the roots is there once, with a share that has no root too."""
    of, df = parts(40), spark.range(40)
    files.write(of(df, "a.mps"), str(tmp_path / "one"))
    rows = of(df, "a.mps").unionAll(of(df.limit(1), "b.mps")).unionAll(files.rows(df.limit(1), 0, file=F.lit("a.msd"), text=F.lit("<solution />")))
    files.write(rows, str(tmp_path / "some"), shares=5)
    assert (tmp_path / "some/a.msd").read_text() == "<solution />"
    one, some = (tmp_path / "one/a.mps").read_text(), (tmp_path / "some/a.mps").read_text()
    first = one.index("  <node")
    assert one != some and some.startswith(one[:first]) and some.endswith("  </node>\n</model>\n\n")
    split = lambda t: sorted(t[first:].removesuffix("</model>\n\n").split("\n  </node>\n"))
    assert split(one) == split(some) and some.count("</model>") == some.count("<?xml") == 1
    assert (tmp_path / "some/b.mps").read_text().count("<node") == 2


def test_roots_as_entries_of_archives(spark, tmp_path, monkeypatch):
    """Files of a jar come as its entries, larger ones are unpacked as they are parsed; all archives of a module count if all are kept."""
    from sylvan.sources import repository

    monkeypatch.setattr(repository, "HELD", 100)
    df, rows = spark.range(20), None
    for jar, ids in (("j1", df.where("id < 8")), ("j2", df.where("id >= 8"))):
        own = parts(20)(ids, f"s/{jar}.jar!/models/m.mps").unionAll(files.rows(df.limit(1), 0, file=F.lit(f"s/{jar}.jar!/a.msd"), text=F.lit('<solution name="a" uuid="u" />')))
        rows = own if rows is None else rows.unionAll(own)
    files.write(rows, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out/s")) == ["j1.jar", "j2.jar"]
    for repo in (Repository(spark, str(tmp_path / "out"), keep_all=True), Repository(spark, str(tmp_path / "out"), keep_all=True).snapshot(str(tmp_path / "kept"))):
        assert repo.errors.count() == 0 and repo.nodes.count() == 40 and repo.node_refs.count() == 40 and repo.models.count() == 2
        assert {r.node_id for r in repo.nodes.where("depth = 0").collect()} == {f"k{k}" for k in range(20)}
