"""Checks of models: each one failed by itself."""

from sylvan.operators import checks


def test_every_check_and_the_verdict(spark):
    models = spark.createDataFrame([("r:1", "fine"), ("r:unknown", "a"), ("r:2", "unknown.model"), ("r:3", "c"), ("r:4", "d"), ("r:5", "e"), ("r:6", "f"), ("r:7", None), (None, "g"), ("r:8", "")], "model_id string, name string")
    nodes = spark.createDataFrame(
        [("r:1", "1", None, "C", {"a": "b"}), ("r:1", "2", "1", None, None), ("r:3", "1", None, "", {}), ("r:4", None, None, "C", {}), ("r:5", "1", None, "C", None), ("r:6", "1", None, "C", {})],
        "model_id string, node_id string, parent_id string, concept string, props map<string,string>",
    )
    refs = spark.createDataFrame([("r:6", "1", None), ("r:1", "1", "to"), ("r:1", "2", None)], "model_id string, node_id string, role string")
    verified = checks.verify(models, nodes, refs)
    got = {(r.model_id, r.name): r.bad for r in verified.collect()}
    assert got == {
        ("r:1", "fine"): [], ("r:unknown", "a"): ["uuid_set"], ("r:2", "unknown.model"): ["name_set"], ("r:3", "c"): ["concepts_set"], ("r:4", "d"): ["node_ids_set"], ("r:5", "e"): ["properties_set"],
        ("r:6", "f"): ["references_set"], ("r:7", None): ["name_set"], (None, "g"): ["uuid_set"], ("r:8", ""): ["name_set"],
    }
    assert tuple(checks.verdict(verified).first()) == (9, 10, "9 models failed verification")
    assert checks.verdict(verified.where("model_id = 'r:1'")).first().said == "All 1 models passed verification"
