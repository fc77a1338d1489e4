"""The rows that readers emit: a tag, the file they come from, and one struct per canonical table, of which one is set."""

from __future__ import annotations

TABLES = {
    "modules": "scan_ord long, module_id string, name string, kind string, version int, dir string, path string, jar string",
    "module_deps": "module_id string, dir string, dep_module_id string, dep_name string, ord int",
    "models": "scan_ord long, model_id string, name string, dir string, source string, path string, persistency string, is_do_not_generate boolean",
    "model_imports": "model_id string, source string, path string, import_index string, imported_model_id string, imported_name string, implicit boolean, ord int",
    "model_languages": "model_id string, source string, language_id string, language_name string, version int, ord int",
    "nodes": "model_id string, source string, path string, node_id string, parent_id string, root_id string, concept string, role string, ord int, depth int, pre long, last long, props map<string,string>",
    "node_refs": "model_id string, source string, path string, node_id string, pre long, role string, ord int, target_model_id string, target_node_id string, resolve_info string",
    "registry": "model_id string, source string, path string, language_id string, language_name string, concept_id string, concept_name string, flags string, concept_index string, kind string, member_id string, member_name string, member_index string, ord int",
    "errors": "path string, stage string, message string",
    "files": "path string, fingerprint string, fresh boolean, size long, top string, item string",
}

#: What a scan of modules alone, or of models without their nodes, has to read.
MODULE_TABLES = {"modules", "module_deps"}
#: What the file that speaks for a model has to be read for, and no other.
MODEL_TABLES = {*MODULE_TABLES, "models"}
NODE_TABLES = {"nodes", "node_refs"}
HEAD_TABLES = {*MODULE_TABLES, "models", "model_imports", "model_languages", "errors"}


def struct(ddl: str) -> str:
    fields = ddl.replace("<string,string>", "<>").split(", ")
    return "struct<" + ", ".join(f.replace(" ", ": ", 1) for f in fields).replace("<>", "<string,string>") + ">"


SCHEMA = "table string, file string, " + ", ".join(f"{name} {struct(ddl)}" for name, ddl in TABLES.items())


def split_ref(text: str | None) -> tuple[str | None, str | None]:
    """id and name of "id(name)"; without brackets, all is the id."""
    if text is None:
        return None, None
    head, bracket, tail = text.partition("(")
    return head, tail.removesuffix(")") if bracket else None
