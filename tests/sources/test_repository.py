import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from sylvan.operators import graph
from sylvan.sources import binary_models, listing
from sylvan.sources.changes import changed_files
from sylvan.sources.repository import Repository, union

from . import made


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return made.garden(tmp_path_factory.mktemp("garden"))


@pytest.fixture(scope="module")
def repo(spark, folder, tmp_path_factory):
    return Repository(spark, folder).snapshot(str(tmp_path_factory.mktemp("kept") / "a"))


def test_modules_and_dependencies(repo):
    assert rows(repo.modules, "module_id", "name", "kind") == [(made.GARDEN, "garden", "language"), ("m1", "one", "solution"), ("m2", "two", "solution")]
    assert rows(repo.module_deps, "module_id", "dep_module_id", "dep_name") == [("m1", "m2", "two")]


def test_models(repo):
    got = rows(repo.models, "name", "module_id", "persistency", "is_do_not_generate")
    assert got == [("garden.species", "m2", "default", False), ("garden.structure", made.GARDEN, "default", False), ("garden.top", "m1", "file_per_root", True)]
    assert rows(repo.model_languages, "language_name", "version") == [("garden", 3), ("garden", 3)]
    assert rows(repo.aspect_models, "language", "name") == [("garden", "garden.structure")]


def test_a_broken_file_is_an_error_alone(repo):
    assert [(p.rsplit("/", 1)[1], stage) for p, stage in rows(repo.errors, "path", "stage")] == [("broken.mps", "parse")]


def test_nodes_and_intervals(repo):
    top = repo.nodes.where("source like '%garden.top'")
    assert rows(top, "node_id", F.coalesce("parent_id", F.lit("")), "root_id", F.coalesce("role", F.lit("")), "depth", "pre", "last") == [("1a", "", "1a", "", 0, 1, 4), ("1b", "1a", "1a", "plants", 1, 2, 2), ("1c", "1a", "1a", "plants", 1, 3, 3), ("1d", "1a", "1a", "plants", 1, 4, 4)]
    assert rows(top.where("node_id = '1b'"), "concept", F.col("props")["name"], F.col("props")["height"]) == [("garden.structure.Plant", "Fern", "40")]
    assert rows(repo.descendants(top.where("node_id = '1a'")), "node_id") == [("1b",), ("1c",), ("1d",)]
    assert repo.nodes_of_short_concept("Plant").count() == 5 and repo.nodes_of_concept("garden.structure.Bed").count() == 1


def test_references_resolve_in_their_own_model(repo):
    got = rows(repo.resolved(), "node_id", "target_node_id", F.coalesce(F.col("target.props")["name"], F.lit("")), "resolve_info")
    assert got == [("1b", "2a", "fern", "fern"), ("1c", "1b", "Fern", "Fern"), ("1d", "9z", "", "gone")]


def test_languages_from_registries(repo):
    assert rows(repo.languages, "name", F.coalesce("version", F.lit(-1))) == [("core", -1), ("garden", 7)]
    assert rows(repo.concepts, "name") == [("core.structure.Named",), ("garden.structure.Bed",), ("garden.structure.Plant",)]
    assert rows(repo.concept_members, "kind", "name") == [("child", "plants"), ("property", "height"), ("property", "name"), ("reference", "species")]


def test_single_tables_are_as_in_the_snapshot(spark, folder, repo):
    direct = Repository(spark, folder)
    for name in ("modules", "models", "model_imports", "nodes"):
        columns = [c for c in getattr(repo, name).columns if c != "props"]
        assert rows(getattr(direct, name).fillna("").select(*columns), *columns) == rows(getattr(repo, name).fillna("").select(*columns), *columns)


def test_archives_and_duplicates(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    made.archive(tmp_path / "in/z.jar", folder)
    (tmp_path / "in/bad.jar").write_bytes(b"no zip")
    repo = Repository(spark, str(tmp_path / "in"))
    assert rows(repo.modules, "name") == [("garden",), ("one",), ("two",)] and repo.nodes.count() == 6
    assert all(r.path.startswith("jar:file:") and "z.jar!/" in r.path for r in repo.models.collect())
    assert {r.stage for r in repo.errors.collect()} == {"open", "parse"}
    both = Repository(spark, folder, str(tmp_path / "in"))
    assert both.modules.where("jar is not null").isEmpty() and both.nodes.count() == 6
    assert Repository(spark, folder, str(tmp_path / "in"), keep_all=True).modules.count() == 6


def test_paths_that_are_no_directories(spark, tmp_path, folder):
    (tmp_path / "file").write_text("x")
    repo = Repository(spark, str(tmp_path / "none"), str(tmp_path / "file"), folder)
    assert rows(repo.errors.where("stage = 'list'"), "message") == [("no such directory",), ("not a directory",)]
    assert repo.models.count() == 3
    assert Repository(spark, str(tmp_path)).nodes.count() == 0


def test_roots_without_header(spark, tmp_path):
    made.write(tmp_path, {"a.msd": made.solution("a", "ma"), "models/d/x.mpsr": made.ROOT, "models/d/y.mpsr": made.ROOT.replace('"1', '"5')})
    repo = Repository(spark, str(tmp_path))
    assert rows(repo.models, "name") == [("garden.top",)] and repo.nodes.count() == 8
    assert rows(repo.errors, "stage") == [("header",)]


def test_refresh_parses_what_changed(spark, tmp_path):
    folder = made.garden(tmp_path / "in")
    repo = Repository(spark, folder)
    repo.snapshot(str(tmp_path / "s1"))
    (tmp_path / "in/two/models/species.mps").write_text(made.single(made.SPECIES, '<node concept="p" id="7" />'))
    shutil.rmtree(tmp_path / "in/one/models")
    fresh = repo.refresh(str(tmp_path / "s1"), str(tmp_path / "s2"))
    assert rows(fresh.nodes, "node_id") == [("7",)] and rows(fresh.models, "name") == [("garden.species",), ("garden.structure",)]
    parsed = spark.read.parquet(str(tmp_path / "s2-parsed")).where("table = 'files' and files.fresh")
    assert {r[0].rsplit("/", 1)[1] for r in parsed.select("files.path").collect()} >= {"species.mps"}


@pytest.mark.parametrize("version", [2, 3])
def test_binary(spark, tmp_path, version):
    made.write(tmp_path, {"a.msd": made.solution("a", "ma"), "models/x.mpb": made.binary(version), "models/cut.mpb": made.binary(version)[:-9], "models/v1.mpb": b"\x91\xab\xab\xa9\0\0\3\0"})
    repo = Repository(spark, str(tmp_path))
    assert rows(repo.models, "model_id", "name", "persistency", "is_do_not_generate") == [("r:00000000-0000-0000-0000-00000000000b", "garden.binary", "binary", True)]
    assert rows(repo.nodes, "node_id", "depth", "pre", "last", "concept") == [("0", 1, 2, 2, "garden.structure.Plant"), ("fZZZZZZZZZZ", 0, 1, 2, "garden.structure.Bed")]
    assert rows(repo.node_refs.fillna("-"), "ord", "target_model_id", "target_node_id", "resolve_info") == [
        (0, "r:00000000-0000-0000-0000-00000000000b", "5", "self"), (1, "r:00000000-0000-0000-0000-000000000002", "1a", "fern"), (2, "java:java.lang", "~String", "String"), (3, "-", "-", "odd")]
    assert rows(repo.languages, "language_id", "name") == [("00000000-0000-0007-0000-000000000008", "garden")]
    assert repo.errors.count() == 2


def test_deep_trees_need_no_recursion():
    place = {"source": "s", "path": "p", "scan_ord": 0, "dir": "d", "persistency": "binary"}
    nodes = [row for table, row in binary_models.model(made.binary(2, 5000), place) if table == "nodes"]
    assert len(nodes) == 5001 and max(n["depth"] for n in nodes) == 5000 and nodes[-1]["last"] == 5001


def test_changed_files(spark):
    assert rows(changed_files(spark, files=["b", "a"]), "path") == [("a",), ("b",)]
    for bad in ({}, {"files": ["a"], "branch": "b"}):
        with pytest.raises(ValueError):
            changed_files(spark, **bad)


def test_refresh_of_changed_vanished_moved_and_unchanged_files(spark, tmp_path):
    top = tmp_path / "r"
    made.garden(top)
    repo = Repository(spark, str(top))
    repo.snapshot(str(tmp_path / "s1"))
    files = sorted(p for p in top.rglob("*") if p.suffix in (".mps", ".mpsr"))
    assert len(files) > 2
    moved = files[0].with_name("moved" + files[0].suffix)
    files[0].rename(moved)
    files[1].unlink()
    (tmp_path / "r" / "one" / "notes.txt").parent.mkdir(exist_ok=True)
    again = Repository(spark, str(top), str(tmp_path / "nowhere"))
    kept = again.refresh(str(tmp_path / "s1"), str(tmp_path / "s2"))
    whole = Repository(spark, str(top), str(tmp_path / "nowhere")).snapshot(str(tmp_path / "s3"))
    for name in ("modules", "models", "nodes", "node_refs", "registry", "errors"):
        assert sorted(map(str, getattr(kept, name).drop("scan_ord").collect())) == sorted(map(str, getattr(whole, name).drop("scan_ord").collect())), name
    fresh = {r.path for r in kept.table("files").where("fresh").collect()}
    assert fresh == {str(moved)} and str(files[1]) not in {r.path for r in kept.table("files").collect()}


def test_filters_reach_the_scan(spark, tmp_path):
    """Fewer files become tasks and are opened: a broken file that no filter lets through is never read."""
    files = {"a/a.msd": made.solution("a", "ma")} | {f"a/models/m{k}.mps": made.single(f"r:{k}(m{k})", f'<node concept="c" id="{k}" />') for k in range(6)}
    made.write(tmp_path, files | {"a/models/broken.mps": "<model", "b/b.msd": made.solution("b", "mb")})
    repo = Repository(spark, str(tmp_path))
    assert repo.errors.count() == 1
    scan = lambda where: repo.scan(task_bytes="1").where(where)
    parts = lambda where: scan(where).rdd.getNumPartitions()
    assert parts("table is not null") == 9
    assert parts("table = 'modules'") == 2 and parts("table in ('modules', 'module_deps')") == 2
    one = f"{tmp_path}/a/models/m3.mps"
    assert parts(f"file = '{one}'") == 1 and parts(f"table = 'nodes' and startswith(file, '{tmp_path}/a/models/m')") == 6 and parts("table = 'nodes'") == 7 and parts("file like '%.msd'") == 2
    assert [r.nodes.node_id for r in scan(f"table = 'nodes' and file = '{one}'").collect()] == ["3"]
    assert scan(f"file = '{one}' and table = 'errors'").count() == 0
    assert scan("table = 'nodes' and nodes.node_id = '4'").count() == 1
    assert sorted(r.file.rpartition("/")[2] for r in scan(f"table = 'models' and file in ('{one}', '{tmp_path}/a/models/m1.mps')").collect()) == ["m1.mps", "m3.mps"]


def odd_tree(top):
    """Directories with and without descriptors, headers and roots, modules in modules, odd names."""
    root = made.ROOT
    made.write(top, {
        "a/a.msd": made.solution("a", "ma"), "a/models/x.mps": "<model/>", "a/models/deep/er/y.mpb": b"", "a/other/z.mps": "", "a/models.mps": "", "a/models/é/_ b.mpsr": root,
        "a/models/two/1.mpsr": root, "a/models/two/0.mpsr": root, "a/models/headed/.model": "", "a/models/headed/r.mpsr": root, "a/models/named/own.model": "", "a/models/named/r.mpsr": root,
        "a/models/inner/b.mpl": "", "a/models/inner/s.mps": "", "a/models/inner/models/t.mps": "", ".c/.msd": "", ".c/models/.mps": "", "lone.mps": "", "models/q.mps": "", "lib/one.jar": b"zip", "noending": "", "d.msd/e.mps": "",
    })


@pytest.mark.parametrize("at_once", [1, 256])
def test_tasks_find_what_the_driver_finds(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(listing, "LISTED_AT_ONCE", at_once)
    top, bare = tmp_path / "in", tmp_path / "bare"
    odd_tree(top)
    bare.mkdir()
    paths = (str(top), str(tmp_path / "none"), str(bare), str(top / "a"))
    rounds = graph.Rounds(spark, "test")
    found = listing.found_files(spark, paths, rounds)
    got = sorted((r.top, *tuple(r)[1:]) for r in listing.items(found, rounds).select("top", *[c for c in listing.Item._fields if c not in ("first", "last")]).collect())
    want = sorted((path, *tuple(i)[:-2]) for nth, path in enumerate(paths) for i in listing.classify(listing.listing(path)[0], nth))
    assert str(got) == str(want) and len(want) > 20
    assert rows(found.where("wrong is not null"), "path", "wrong") == [(paths[1], "no such directory")]
    assert listing.items(listing.found_files(spark, paths[1:3], rounds), rounds).count() == 0


def test_a_new_file_leaves_others_as_they_are(spark, tmp_path):
    folder = made.garden(tmp_path / "in")
    repo = Repository(spark, folder)
    repo.snapshot(str(tmp_path / "s1"))
    made.write(tmp_path / "in", {"aaa/first.msd": made.solution("first", "m0"), "lang/models/zz.mps": made.single("r:9(last)")})
    kept = repo.refresh(str(tmp_path / "s1"), str(tmp_path / "s2"))
    assert sorted(r.path.rpartition("/")[2] for r in kept.table("files").where("fresh").collect()) == ["first.msd", "zz.mps"]
    assert rows(kept.modules, "name") == [("first",), ("garden",), ("one",), ("two",)]
    # What another file makes of it counts: with a descriptor of its own a directory's models change their module.
    made.write(tmp_path / "in", {"lang/models/lang2.msd": made.solution("second", "m9")})
    kept = repo.refresh(str(tmp_path / "s2"), str(tmp_path / "s3"))
    assert {r.path.rpartition("/")[2] for r in kept.table("files").where("fresh").collect()} == {"lang2.msd"}
    assert rows(kept.models.where("name like 'last'"), "name") == []


def large_archive(top, models):
    files = {"a/a.msd": made.solution("a", "ma")} | {f"a/models/m{k}.mps": made.single(f"r:{k}(m{k})", f'<node concept="c" id="{k}" />') for k in range(models)}
    made.write(top / "raw", files)
    (top / "in").mkdir()
    made.archive(top / "in/large.jar", str(top / "raw"))
    made.write(top / "raw2", {"readme.txt": "x" * 5000, "models/m.mps": made.single("r:1(m)")})
    made.archive(top / "in/beside.jar", str(top / "raw2"))
    return str(top / "in")


def test_archives_are_dealt_by_entries(spark, tmp_path):
    repo = Repository(spark, large_archive(tmp_path, 40))
    whole = repo.scan().where("table <> 'files'")
    dealt = repo.scan(task_bytes="2000").where("table <> 'files'")
    assert whole.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() > 20
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    assert repo.scan(task_bytes="2000").where("table = 'files'").count() == 2 and dealt.where("table = 'nodes'").count() == 40
    # Runs have all entries once; an archive without descriptors is one run of nothing; what isn't an archive is left to its reading.
    top = str(tmp_path / "in")
    beside, large = (i for i in listing.classify(listing.listing(top)[0]))
    runs = listing.divided(top, large, 2000)
    assert [r.first for r in runs] == [0, *[r.last for r in runs[:-1]]] and runs[-1].last == 41 and all(r.last > r.first for r in runs)
    assert [(r.first, r.last) for r in listing.divided(top, beside, 1)] == [(0, 0)]
    (tmp_path / "in/bad.jar").write_bytes(b"no zip" * 1000)
    bad = large._replace(path=f"{top}/bad.jar")
    assert listing.divided(top, bad, 1) == [bad] and repo.scan(task_bytes="2000").where("table = 'errors'").count() == 1


def test_a_snapshot_deals_entries(spark, tmp_path, monkeypatch):
    from sylvan.sources import repository

    repo = Repository(spark, large_archive(tmp_path, 12))
    want = sorted(map(str, repo.scan().where("table <> 'files'").collect()))
    monkeypatch.setattr(repository, "SHARE", 2000)
    monkeypatch.setattr(repository, "OPEN_COST", 100)
    kept = repo.snapshot(str(tmp_path / "s"))
    read = spark.read.schema(repository.SCHEMA).parquet(str(tmp_path / "s")).select(repo.scan().columns)
    assert sorted(map(str, read.where("table <> 'files'").collect())) == want
    assert kept.nodes.count() == 12 and spark.read.parquet(str(tmp_path / "s-listed")).where("table = 'files'").count() == 2


def test_models_of_no_id_all_stay(spark, tmp_path):
    made.write(tmp_path, {"a.msd": made.solution("a", "ma"), "models/x.mps": "<model><node concept='c' id='1' /></model>", "models/y.mps": "<model><node concept='c' id='2' /></model>"})
    repo = Repository(spark, str(tmp_path))
    assert repo.models.where("model_id is null").count() == 2 and rows(repo.nodes, "node_id") == [("1",), ("2",)]


def test_changed_files_of_a_branch(spark, tmp_path):
    """A working copy: committed and uncommitted changes since it left the branch; what the branch did since then doesn't count."""

    def git(*words):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *words], check=True, capture_output=True)

    folder = made.garden(tmp_path)
    (tmp_path / "two/models/broken.mps").unlink()  # a file beside a changed one that holds no model would leave the cone of modules
    git("init", "-q", "-b", "trunk")
    git("add", "-A")
    git("commit", "-qm", "first")
    git("checkout", "-qb", "work")
    made.write(tmp_path, {"two/models/species.mps": made.single(made.SPECIES), "one/é.txt": "new"})
    git("add", "-A")
    git("commit", "-qm", "second")
    git("checkout", "-q", "trunk")
    made.write(tmp_path, {"lang/models/structure.mps": made.single("r:5(garden.structure)", "", '<attribute name="x" value="y" />')})
    git("commit", "-qam", "third")
    git("checkout", "-q", "work")
    (tmp_path / "one/one.msd").write_text(made.solution("one", "m1"))
    got = changed_files(spark, folder, branch="trunk")
    assert rows(got, "path") == [("one/one.msd",), ("one/é.txt",), ("two/models/species.mps",)]
    modules, models = Repository(spark, folder).cone_of_influence(got, folder)
    assert rows(modules.where("affected"), "module_id") == [("m1",), ("m2",)]
    species, top = (ref.partition("(")[0] for ref in (made.SPECIES, made.TOP))
    assert rows(models, "model_id", "affected") == [(top, True), (species, True)]
    with pytest.raises(RuntimeError, match="merge-base"):
        changed_files(spark, folder, branch="nowhere")


def test_union_of_repositories(spark, tmp_path, repo):
    made.write(tmp_path, {"b.msd": made.solution("b", "mb"), "models/y.mps": made.single("r:77(other)", '<node concept="p" id="77" />')})
    other = Repository(spark, str(tmp_path))
    assert rows(union([repo, other], "modules"), "name") == [("b",), ("garden",), ("one",), ("two",)]
    assert union([repo, other], "nodes").count() == repo.nodes.count() + 1 and union([other], "models").count() == 1
