"""Small files are read by patterns or as trees, and give what the parser gives."""

import io
import json
import os
import random

import pytest

from sylvan import queries
from sylvan.plans.forest import Forest
from sylvan.sources import files, xml_models
from sylvan.sources.repository import Repository
from sylvan.sources.rows import MODEL_TABLES, TABLES

from . import made

DATA = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<model ref="r:1(m)" content="root">\n  <imports>\n    <import index="i" ref="r:2(n)" />\n  </imports>\n  <registry>\n    <language id="l" name="L">\n      <concept id="c" name="L.C" index="x"><property id="p" name="name" index="pn" /><child id="k" name="kids" index="kk" /><reference id="r" name="to" index="rr" /></concept>\n    </language>\n  </registry>\n'
NODES = '  <node concept="x" id="1">\n    <property role="pn" value="a > b é" />\n    <property role="pn" value="again" />\n    <ref role="rr" to="i:7" resolve="R" />\n    <node concept="y" id="2" role="kk" />\n    <node concept="x" id="3" role="other">\n      <ref role="q" node="1" />\n      <ref to="i:8" />\n    </node>\n  </node>\n  <node concept="x" id="4" role="kk" />\n'
END = "</model>\n\n"
ODD = [
    "", END, NODES + "</model", NODES, NODES + END + "<!-- after -->", NODES.replace("a > b", "&lt;&#10;b") + END, NODES.replace("a > b", "&none;") + END, NODES.replace("a > b", "a\tb\nc") + END,
    NODES.replace("a > b", "\x01") + END, NODES.replace("a > b", "￿") + END, NODES.replace('role="pn" value="again"', 'value="again" role="pn"') + END, NODES.replace('value="again"', 'value="again" value="b"') + END, NODES.replace('<property role="pn" value="again" />', "<property role='pn' value='again'></property>") + END,
    NODES.replace("</node>\n  <node", "</node>\n <!-- <node > --> text <![CDATA[<node concept='x'>]]>\n  <node") + END, NODES.replace("  </node>\n  <node", "  <node") + END, NODES + "  </node>\n" + END, NODES + '  <import index="j" ref="r:3(o)" />\n' + NODES + END,
    NODES + "<deep><node id='9' /><property role='pn' value='of none' /></deep>" + END, '<property role="pn" value="of none" /><ref role="rr" to="i:1" />' + NODES + END, NODES.replace("again", "ab\r\n") + END, NODES.replace('id="1"', 'id="1" xmlns="u"') + END, NODES.replace('id="3"', 'id="3" a:b="u"') + END,
    "<node id='0'><property role='pn' value='v' /></node>" + NODES + END, NODES + '<node concept="x" id="5">' + END, NODES + END + END, NODES.replace(' concept="y"', "") + END, NODES.replace(' concept="y" id="2"', "") + END, NODES + '<attribute name="doNotGenerate" value="true" />' + END,
]
HEADS = [
    HEAD, HEAD.replace("</registry>", "</registry>\n<!-- <node concept -->"), HEAD.replace('encoding="UTF-8"', 'encoding="ISO-8859-1"'), HEAD.replace("<model ", '<!DOCTYPE model [<!ENTITY none "e">]>\n<model '), HEAD.replace("<model ", '<model xmlns="u" '), HEAD.replace("</registry>", "</registry>\n<node>\n</node>"),
    HEAD.replace("</registry>", "</registry>\n<attribute name='doNotGenerate' value='true' /><?odd <node ?>"), "<model>", "", HEAD.replace("</registry>", '</registry><use id="u" version="none" />'),
]


def parsed(data, place, wanted):
    """By the parser alone; the rows of columns one by one."""
    try:
        xml_models.check(io.BytesIO(data))
        return flat(xml_models.model(io.BytesIO(data), place, wanted), wanted)
    except (xml_models.expat.ExpatError, ValueError, LookupError) as e:
        return str(e)


def flat(rows, wanted):
    out = {t: [] for t in wanted}
    for table, row in rows:
        if table not in wanted:
            continue
        if isinstance(row, xml_models.Columns):
            props, at = list(zip(*row.entries)), 0
            for k, own in enumerate(row.rows):
                out[table].append((dict(zip(row.names, own)) | row.same, props[at : at + row.sizes[k]] if table == "nodes" else None))
                at += row.sizes[k] if table == "nodes" else 0
        else:
            out[table].append(row)
    return out


def test_small_files_give_what_the_parser_gives():
    place = {"scan_ord": 0, "dir": "d", "source": "s", "path": "p", "jar": None, "lead": True, "persistency": "default"}
    usual, heads = 0, {}
    for head in HEADS:
        for body in [NODES + END, *ODD]:
            data = (head + body).encode("iso-8859-1" if "8859" in head and "￿" not in body else "utf-8")
            for wanted in (set(TABLES), {"nodes"}, {"nodes", "node_refs"}, set(MODEL_TABLES)):
                for lead in (True, False):
                    want = parsed(data, place | {"lead": lead}, wanted)
                    try:
                        got = xml_models.small_model(data, place | {"lead": lead}, wanted, heads)
                    except ValueError as e:
                        assert want == str(e), (head, body)
                        continue
                    if got is not None:  # else it is left to the parser
                        usual += 1
                        assert flat(got, wanted) == want, (head, body, wanted)
    assert usual > 300 and len(heads) <= xml_models.HEADS


def test_any_cut_of_a_file(monkeypatch):
    """Every beginning and random changes of a file, with and without the pattern."""
    place, chance, tree = {"scan_ord": 0, "dir": "d", "source": "s", "path": "p", "jar": None, "lead": False, "persistency": "default"}, random.Random(5), xml_models.ElementTree.fromstring
    data, by_pattern, taken = (HEAD + NODES + END).encode(), 0, []
    monkeypatch.setattr(xml_models.ElementTree, "fromstring", lambda d: (taken.append(len(d)), tree(d))[1])
    for k in range(3000):
        if k < len(data):
            some = data[:k]
        else:
            some = bytearray(data)
            for _ in range(chance.randint(1, 2)):
                at = chance.randrange(len(some))
                some[at : at + chance.randint(0, 2)] = chance.choice([b"", b'"', b"<", b">", b"/", b" ", b"x", b"&", b"\n", b"</node>", b"<node ", b"=", b"\xc3", b"\x00"])
            some = bytes(some)
        want, heads = parsed(some, place, {"nodes", "node_refs"}), {}
        taken.clear()
        got = xml_models.small_model(some, place, {"nodes", "node_refs"}, heads)
        by_pattern += got is not None and len(some) not in taken
        assert got is None or flat(got, {"nodes", "node_refs"}) == want, some
    assert by_pattern > 100


@there
def test_roots_are_read_once_and_by_their_own_columns(spark, monkeypatch):
    """All files were read for modules and models, and nodes came with the columns of all tables; archives of a model stayed as many for any size."""
    monkeypatch.setattr(queries, "_FILE_NODES", 10)
    monkeypatch.setattr(queries, "_JARS", 2)
    repo = queries._written(Forest(spark, DATA), by_root=True)
    jars = {r.jar for r in repo.modules.select("jar").collect()}
    assert len(jars) > 25 * queries._JARS
    assert repo.table("nodes", "node_id", "props").columns == ["node_id", "props"] and "registry" not in repo.table("nodes")._jdf.queryExecution().toString()
    kept = repo.snapshot(f"{repo.paths[0]}-models", MODEL_TABLES)
    assert sorted(map(str, kept.models.collect())) == sorted(map(str, repo.models.collect())) and kept.table("errors").count() == 0
    whole = repo.scan().where("table = 'nodes'").select("nodes.*")
    assert sorted(map(str, repo.table("nodes").collect())) == sorted(map(str, whole.collect()))


def test_only_the_root_that_speaks_for_a_model_is_opened(spark, tmp_path):
    made.write(tmp_path, {"a/a.msd": made.solution("a", "ma"), "a/models/m/a.mpsr": made.ROOT, "a/models/m/b.mpsr": "<broken", "a/models/m/c.mpsr": made.ROOT})
    repo = Repository(spark, str(tmp_path))
    assert repo.models.count() == 1 and repo.errors.where("path like '%b.mpsr'").count() == 1
    assert repo.scan(task_bytes="1").where("table = 'models'").rdd.getNumPartitions() == 1  # a task for each root before


def test_equal_heads_are_printed_once(monkeypatch):
    """Each file's head was read from JSON and printed anew."""
    import pyarrow as pa

    head = json.dumps({"section": 0, "text": None, "head": {"model_id": "m", "model_name": "n", "path": None, "root_id": ""}, "imports": [{"import_index": "i", "imported_model_id": "o", "imported_name": "other", "implicit": False}], "concepts": None})
    rows = [r for k in range(40) for r in ((f"f{k}", None, None, head), (f"f{k}", 0, f'  <node id="{k}">\n    <ref\2to:o\2k" />\n', None))]
    rows += [("text", None, None, json.dumps({"section": 0, "text": "as it is", "head": None, "imports": None, "concepts": None})), ("both", None, None, head), ("both", None, None, json.dumps({"section": 3, "text": "more", "head": None, "imports": None, "concepts": None})), ("empty", None, None, head)]
    schema = pa.schema([("file", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("other", pa.string())])
    fed, feed = [], files.Printer.feed
    monkeypatch.setattr(files.Printer, "feed", lambda self, row: (fed.append(row["text"]), feed(self, row))[1])
    texts = {}
    for size in (1, 7, 1000):
        for heads in (1, 16):
            monkeypatch.setattr(files, "HEADS", heads)
            fed.clear()
            some: dict[str, str] = {}
            for file, piece, _ in files.printed(pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[k : k + size]], schema) for k in range(0, len(rows), size)):
                some[file] = some.get(file, "") + (piece or "")
            assert fed.count(None) <= 4
            texts.setdefault("", some)
            assert some == texts[""]
    assert len(some) == 43 and some["f7"].startswith("<?xml") and some["f7"].endswith(' to="i:k" />\n  </node>\n</model>\n\n') and some["text"] == "as it is" and some["empty"].endswith("  <registry />\n</model>\n\n")
