import json

import pytest

from sylvan.sources import languages, sinks
from sylvan.sources.changes import changed_files
from sylvan.sources.repository import Repository

from . import made

LANG = "77777777-2222-3333-4444-555555555555"
STRUCTURE = """<model ref="r:9(shop.structure)"><persistence version="9" /><imports /><registry>
<language id="c" name="lang.structure"><concept id="1" name="lang.structure.ConceptDeclaration" flags="ng" index="cd">
<property id="2" name="name" index="n" /><property id="3" name="abstract" index="ab" /><property id="4" name="rootable" index="ro" /><property id="5" name="alias" index="al" />
<child id="6" name="propertyDeclaration" index="pd" /><child id="7" name="linkDeclaration" index="ld" /><child id="8" name="implements" index="im" /><reference id="9" name="extends" index="ex" /></concept>
<concept id="20" name="lang.structure.PropertyDeclaration" flags="ng" index="pr"><reference id="21" name="dataType" index="dt" /></concept>
<concept id="30" name="lang.structure.LinkDeclaration" flags="ng" index="li"><property id="31" name="role" index="rl" /><property id="32" name="metaClass" index="mc" /><property id="33" name="sourceCardinality" index="sc" /><reference id="34" name="target" index="tg" /></concept>
<concept id="40" name="lang.structure.InterfaceConceptReference" flags="ng" index="ir"><reference id="41" name="intfc" index="ii" /></concept></language></registry>
<node concept="cd" id="a1"><property role="n" value="Basket" /><property role="ro" value="true" /><property role="al" value="basket" /><ref role="ex" to="x:1" resolve="core.Base" />
<node concept="ir" id="a2" role="im"><ref role="ii" to="x:2" resolve="core.INamed" /></node>
<node concept="pr" id="a3" role="pd"><property role="n" value="size" /><ref role="dt" to="x:3" resolve="integer" /></node>
<node concept="li" id="a4" role="ld"><property role="rl" value="fruits" /><property role="mc" value="fLJj/aggregation" /><property role="sc" value="fLJe/_0__n" /><ref role="tg" node="b1" resolve="Fruit" /></node>
<node concept="li" id="a5" role="ld"><property role="rl" value="owner" /><property role="mc" value="fLJk/reference" /><ref role="tg" to="x:4" resolve="Person" /></node></node>
<node concept="cd" id="b1"><property role="n" value="Fruit" /><property role="ab" value="true" /></node></model>"""


@pytest.fixture(scope="module")
def top(tmp_path_factory):
    top = tmp_path_factory.mktemp("shop")
    made.garden(top)
    made.write(top, {"shop/shop.mpl": f'<language namespace="shop" uuid="{LANG}" languageVersion="2" />', "shop/models/structure.mps": STRUCTURE})
    return top


@pytest.fixture(scope="module")
def repo(spark, top, tmp_path_factory):
    return Repository(spark, str(top)).snapshot(str(tmp_path_factory.mktemp("kept") / "a"))


def test_declared_concepts(repo):
    got = {r.name: r for r in languages.concept_declarations(repo).collect()}
    basket, fruit = got["Basket"], got["Fruit"]
    assert set(got) == {"Basket", "Fruit"}
    assert (basket.is_root, basket.is_abstract, basket.alias, basket.extends, basket.implements) == (True, False, "basket", "core.Base", ["core.INamed"])
    assert [tuple(x) for x in basket.properties] == [("size", "integer")]
    assert [tuple(x) for x in basket.child_links] == [("fruits", "Fruit", "_0__n")] and [tuple(x) for x in basket.reference_links] == [("owner", "Person", "")]
    assert (fruit.is_abstract, fruit.properties, fruit.extends) == (True, [], "")
    assert sinks.declarations_as_markdown(repo).first().text == (
        f"## shop\n\nuuid: {LANG}  \nversion: 2  \nconcepts: 2\n\n```\nconcept Basket - extends Base\n                 implements INamed\n\nalias: basket\ninstance can be root: yes\n"
        "\nproperties:\n  size : integer\n\nchildren:\n  fruits : Fruit [_0__n]\n\nreferences:\n  owner : Person\n```\n\n```\nabstract concept Fruit\n```\n")  # fmt: skip


def test_super_concepts_and_reports(repo):
    assert {("garden.structure.Bed", "core.structure.Named"), ("garden.structure.Plant", "core.structure.Named")} <= {tuple(r) for r in languages.super_concepts(repo).collect()}
    html = {r.language: r.text for r in sinks.language_info_as_html(repo).collect()}["garden"]
    assert "<li><a name='garden.structure.Plant'>Plant</a><a href='#core.structure.Named'>Named </a></li><ul><li>Properties:</li><ul><li>height</li></ul></ul>" in html
    assert {(r.language, r.aspects) for r in languages.languages_with_aspects(repo).collect()} >= {("garden", "structure"), ("core", None)}
    assert {r.concept: r.text for r in sinks.concept_details(repo).collect()}["garden.structure.Bed"] == "garden.structure.Bed\n  properties: \n  children: plants\n  references: "
    dump = [r.text for r in sinks.tree_dump(repo).where("model_id like '%001'").collect()]
    assert dump[0] == "\u2022 garden.structure.Bed  'north & \"west\"'  [1a]" and dump[1] == "  \u2022 garden.structure.Plant [plants]  'Fern'  [1b]\n      height = '40'\n      species -> r:00000000-0000-0000-0000-0000000000 (fern)"


def test_web_rows(repo):
    assert {json.loads(r.json)["name"] for r in sinks.solutions_as_json(repo).collect()} == {"one", "two"}
    assert [json.loads(r.json)["name"] for r in sinks.models_of_solution_as_json(repo, "m2").collect()] == ["garden.species"]
    roots = sinks.root_nodes_of_model_as_json(repo, "r:00000000-0000-0000-0000-000000000001")
    back = sinks.of_json(roots, "id string, concept string, properties map<string,string>, links array<struct<link string, kind string, target_node_id string>>").first()
    assert (back.id, back.concept, [x.target_node_id for x in back.links]) == ("1a", "garden.structure.Bed", ["1b", "1c", "1d"])


def test_questions(repo):
    model = "r:00000000-0000-0000-0000-000000000001"
    assert repo.module_by_name("one").first().module_id == "m1" and repo.module_by_name("none").first() is None and repo.module_by_name("garden", "solution").first() is None
    assert repo.models_by_name("garden.top").count() == 1 and repo.model_by_name("garden.top", "m2").first() is None
    assert repo.by_path("model", repo.models_by_name("garden.species").first().path).first().name == "garden.species" and repo.by_path("module", None).first() is None
    assert repo.language_by_name("garden").first().version == 7 and repo.concept_by_short_name("Bed").first().name == "garden.structure.Bed" and repo.concept_by_name("Bed").first() is None
    assert [r.name for r in repo.aspect_models_of("garden", "structure").collect()] == ["garden.structure"]
    bed = repo.node_by_id(model, "1a")
    assert [(r.node_id, r.place) for r in repo.children_of(bed, "plants").orderBy("place").collect()] == [("1b", 0), ("1c", 1), ("1d", 2)]
    assert repo.property_of(bed, "name").first().value == 'north & "west"' and repo.property_of(bed, "none", "").first().value == ""
    assert repo.parents_of(repo.node_by_id(model, "1c")).first().node_id == "1a"
    of = lambda node, name: [tuple(r)[2:] for r in repo.member(repo.node_by_id(model, node), name).collect()]
    assert of("1b", "height") == [("property", "40", None)] and of("1b", "species") == [("reference", None, ["2a"])] and of("1a", "plants") == [("children", None, ["1b", "1c", "1d"])] and of("1a", "no") == [(None, None, None)]
    with pytest.raises(Exception, match="several concepts are called Bed: garden.structure.Bed, other.Bed"):
        both = repo.nodes.unionByName(repo.nodes.selectExpr("* except (concept)", "'other.Bed' as concept"))
        type(repo).nodes_of_short_concept(type("R", (), {"nodes": both})(), "Bed").collect()
    assert {(r.imported_name, r.loaded) for r in repo.loaded_imports().collect()} == {("garden.species", True)}


def test_cone_of_changed_paths(spark, repo, top):
    def cone(*files):
        modules, models = repo.cone_of_influence(changed_files(spark, files=list(files)), str(top))
        return {(r.module_id, r.affected) for r in modules.collect()}, models and {(r.model_id[-3:], r.affected) for r in models.collect()}

    # The broken file lies beside species.mps and is no model: the cone of modules.
    assert {(r.path, r.id) for r in repo.modified(changed_files(spark, files=["two/models/species.mps"]), str(top)).collect()} == {("two/two.msd", "m2"), ("two/models/species.mps", "r:00000000-0000-0000-0000-000000000002"), ("two/models/broken.mps", None)}
    assert cone("two/models/species.mps") == ({("m2", True), ("m1", True)}, None)
    assert cone("one/models/garden.top/_north bed.mpsr") == ({("m1", True), ("m2", False)}, {("001", True), ("002", False)})
    assert cone("one/models/gone.mps") == ({("m1", True), ("m2", False)}, None)
    assert cone("one/gone.msd")[0] == {("m1", True), ("m2", True), (made.GARDEN, True), (LANG, True)}
