"""Roots written back as XML files, reports of languages and models as rows of text, and rows as JSON and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import files, languages
from .repository import ROOT, Repository


def root_rows(repo: Repository, file: F.Column, only: F.Column | None = None) -> DataFrame:
    """Rows of the files that hold the repository's roots, or those for whose nodes ``only`` holds; both are made of model_id, path and root_id.

    A root's head brings the imports and the registry of the file that it was read from, so these take no rows of their own.
    """
    nodes = repo.nodes if only is None else repo.nodes.where(only)
    heads = nodes.where("parent_id is null").join(repo.models.select("model_id", "source", F.col("name").alias("model_name")), ["model_id", "source"])
    pack = lambda ddl: F.struct(*[part.split(":")[0] for part in ddl.removeprefix("struct<").replace("map<string,string>", "").removesuffix(">").split(", ")])
    listed = lambda df, ddl, name: df.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", pack(ddl).alias("row")))), lambda x: x["row"]).alias(name))
    heads = heads.join(listed(repo.model_imports, files.IMPORT, "imports"), "path", "left").join(listed(repo.registry, files.REGISTRY, "concepts"), "path", "left")
    refs = repo.node_refs.join(nodes.select("path", "node_id", "root_id"), ["path", "node_id"])
    return (
        files.rows(heads, 0, file=file, head=F.struct("model_id", "model_name", "path", "root_id"), imports=F.col("imports"), concepts=F.col("concepts"))
        .unionAll(files.rows(nodes, 3, file=file, root=F.col("root_id"), pre=F.col("pre"), node=pack(files.NODE)))
        .unionAll(files.rows(refs, 3, file=file, root=F.col("root_id"), pre=F.col("pre"), kind=F.lit(1), ord=F.col("ord"), ref=pack(files.REF)))
    )


def write_roots(repo: Repository, folder: str, mode: str = "append") -> None:
    """Every root as a file of its own, in a folder for each model (by its id) below the given one."""
    files.write(root_rows(repo, F.concat_ws("/", F.url_encode("model_id"), F.concat(F.url_encode("root_id"), F.lit(ROOT)))), folder, mode)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[str] = []
    for _, piece, head in files.printed(batches):
        if piece is not None:
            held.append(piece)
        else:
            yield pa.RecordBatch.from_pylist([{"model_id": head["model_id"], "path": head["path"], "root_id": head["root_id"], "text": "".join(held)}])
            held = []


def roots_as_xml(repo: Repository, only: F.Column | None = None) -> DataFrame:
    """model_id, path, root_id, text: every root (or those that ``only`` chooses, before any is printed) as the text of a file of its own.  A text is held whole; ``write_roots`` holds none."""
    ordered = files.in_order(root_rows(repo, F.concat_ws("\0", "path", "root_id"), only))
    return ordered.mapInArrow(_texts, "model_id string, path string, root_id string, text string")


def _members(repo: Repository) -> DataFrame:
    """language, concept and its members of each kind, sorted and joined; concepts without members too."""

    def named(kind: str) -> F.Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("member")))), ", ").alias(kind)

    members = repo.concept_members.select("concept_id", "kind", F.col("name").alias("member"))
    concepts = repo.concepts.withColumnRenamed("name", "concept").join(repo.languages.select("language_id", F.col("name").alias("language")), "language_id")
    return concepts.join(members, "concept_id", "left").groupBy("language", "concept").agg(named("property"), named("child"), named("reference"))


def languages_as_markdown(repo: Repository) -> DataFrame:
    """language, text: a section for every language with its concepts."""
    block = F.concat(F.lit("### "), F.substring_index("concept", ".", -1), F.lit("\n"), *[F.when(F.col(k) != "", F.concat(F.lit(f"- {k}: "), F.col(k), F.lit("\n"))).otherwise("") for k in ("property", "child", "reference")])
    blocks = _members(repo).groupBy("language").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return blocks.select("language", F.concat(F.lit("## "), "language", F.lit("\n\n"), F.array_join("blocks", "\n")).alias("text"))


def languages_as_html(repo: Repository) -> DataFrame:
    """language, text: a list of concepts, each with its members."""

    def safe(c: str) -> F.Column:
        return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    item = F.concat(F.lit("<li>"), safe("concept"), *[F.when(F.col(k) != "", F.concat(F.lit(f"<br>{k}: "), safe(k))).otherwise("") for k in ("property", "child", "reference")], F.lit("</li>"))
    items = _members(repo).groupBy("language").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return items.select("language", F.concat(F.lit("<h2>"), safe("language"), F.lit("</h2><ul>"), F.array_join("items", ""), F.lit("</ul>")).alias("text"))


def _lines(*parts: F.Column) -> F.Column:
    """Those of the parts that aren't null, a line each."""
    return F.array_join(F.array(*parts), "\n")


def declarations_as_markdown(repo: Repository) -> DataFrame:
    """language, text: a section for each language with a structure model, with a fenced block for each of its concepts in the order of their ids."""
    c = languages.concept_declarations(repo).where("name <> ''")
    head = F.concat(F.when(F.col("is_abstract"), "abstract ").otherwise(""), F.when(F.col("is_interface"), "interface concept ").otherwise("concept "), "name")
    supers = F.concat(F.when(F.col("extends") != "", F.array(F.concat(F.lit("extends "), ids.short_name(F.col("extends"))))).otherwise(F.array().cast("array<string>")), F.transform("implements", lambda x: F.concat(F.lit("implements "), ids.short_name(x))))
    first = F.when(F.size(supers) > 0, F.concat(head, F.lit(" - "), F.element_at(supers, 1))).otherwise(head)
    more = F.transform(F.slice(supers, 2, 1 << 20), lambda x: F.concat(F.repeat(F.lit(" "), F.length(head) + 3), x))
    typed = lambda x: F.concat(F.lit("  "), x["name"], F.when(x["type"] != "", F.concat(F.lit(" : "), ids.short_name(x["type"]))).otherwise(""))
    counted = lambda x: F.concat(typed(x), F.when(x["cardinality"] != "", F.concat(F.lit(" ["), x["cardinality"], F.lit("]"))).otherwise(""))

    def listed(title: str, column: str, line) -> F.Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(column, line), "\n")))

    told = F.when((F.col("alias") != "") | (F.col("description") != "") | F.col("is_root"), "")
    block = _lines(
        F.array_join(F.concat(F.array(first), more), "\n"), told, F.when(F.col("alias") != "", F.concat(F.lit("alias: "), "alias")), F.when(F.col("description") != "", F.concat(F.lit("description: "), "description")),
        F.when(F.col("is_root"), "instance can be root: yes"), listed("properties", "properties", typed), listed("children", "child_links", counted), listed("references", "reference_links", counted),
    )
    blocks = c.groupBy("language_id", "language").agg(F.array_sort(F.collect_list(F.struct("node_id", F.concat(F.lit("```\n"), block, F.lit("\n```\n")).alias("text")))).alias("blocks"))
    versions = repo.modules.where("kind = 'language'").select(F.col("module_id").alias("language_id"), "version")
    out = blocks.join(versions, "language_id", "left").join(languages.structure_models(repo).groupBy("language_id").agg(F.sum("roots").alias("roots")), "language_id")
    title = F.concat(F.lit("## "), "language", F.lit("\n\nuuid: "), "language_id", F.lit("  \nversion: "), F.coalesce(F.col("version").cast("string"), F.lit("")), F.lit("  \nconcepts: "), F.col("roots").cast("string"), F.lit("\n\n"))
    return out.select("language", F.concat(title, F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).alias("text")).orderBy("language")


def language_info_as_html(repo: Repository) -> DataFrame:
    """language, text: concepts as anchors with links to their super-concepts, and lists of their properties, children and references."""

    def safe(c: F.Column) -> F.Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    supers = languages.super_concepts(repo).groupBy("concept").agg(F.array_sort(F.collect_list("super")).alias("supers"))
    members = repo.concept_members.select("concept_id", "kind", F.col("name").alias("member"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("member")))).alias(kind)
    concepts = repo.concepts.withColumnRenamed("name", "concept").join(repo.languages.select("language_id", F.col("name").alias("language")), "language_id")
    rows = concepts.join(members, "concept_id", "left").groupBy("language", "concept").agg(of("property"), of("child"), of("reference")).join(supers, "concept", "left")
    links = F.array_join(F.transform(F.coalesce("supers", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<a href='#"), safe(x), F.lit("'>"), safe(ids.short_name(x)), F.lit(" </a>"))), "")
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"<ul><li>{title}:</li><ul>"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("<li>"), safe(x), F.lit("</li>"))), ""), F.lit("</ul></ul>"))).otherwise("")
    item = F.concat(F.lit("<li><a name='"), safe(F.col("concept")), F.lit("'>"), safe(ids.short_name(F.col("concept"))), F.lit("</a>"), links, F.lit("</li>"), listed("Properties", "property"), listed("Children", "child"), listed("References", "reference"))
    items = rows.groupBy("language").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return items.select("language", F.concat(F.lit("<p>"), safe(F.col("language")), F.lit("</p><ul>"), F.array_join("items", ""), F.lit("</ul>")).alias("text")).orderBy("language")


def concept_details(repo: Repository) -> DataFrame:
    """concept, text: name, properties, children and references of each concept of the registries, a line each."""
    return _members(repo).select("concept", _lines(F.col("concept"), F.concat(F.lit("  properties: "), "property"), F.concat(F.lit("  children: "), "child"), F.concat(F.lit("  references: "), "reference")).alias("text"))


def tree_dump(repo: Repository, most_roots: int = 3, deepest: int = 3) -> DataFrame:
    """model_id, root, pre, text of the first roots of each model, down to a depth: a headline, properties and references in the order of their names.

    References into Java classes show the class, others the first 36 characters of the model's id.
    """
    from pyspark.sql import Window

    first = Window.partitionBy("model_id").orderBy("path", "pre")
    roots = repo.nodes.where("parent_id is null").select("model_id", "source", "path", "root_id", F.row_number().over(first).alias("root"), "pre").drop("pre").where(F.col("root") <= most_roots)
    nodes = repo.nodes.where(F.col("depth") <= deepest).join(roots, ["model_id", "source", "path", "root_id"])
    hint = F.coalesce("resolve_info", F.lit(""))
    to = F.coalesce("target_model_id", F.lit(""))
    shown = F.when(to.startswith("java:"), F.concat(hint, F.lit(" (Java)"))).otherwise(F.concat(F.left(to, F.lit(36)), F.when(hint != "", F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise("")))
    refs = repo.node_refs.groupBy("model_id", "source", "path", "node_id").agg(F.array_sort(F.collect_list(F.concat("role", F.lit(" -> "), shown))).alias("refs"))
    pad = F.repeat(F.lit("  "), F.col("depth"))
    name = F.try_element_at("props", F.lit("name"))
    head = F.concat(pad, F.lit("\u2022 "), F.coalesce("concept", F.lit("null")), F.coalesce(F.concat(F.lit(" ["), "role", F.lit("]")), F.lit("")), F.when(name != "", F.concat(F.lit("  '"), name, F.lit("'"))).otherwise(""), F.lit("  ["), F.coalesce("node_id", F.lit("null")), F.lit("]"))
    props = F.transform(F.filter(F.array_sort(F.map_entries("props")), lambda e: e["key"] != "name"), lambda e: F.concat(pad, F.lit("    "), e["key"], F.lit(" = '"), e["value"], F.lit("'")))
    links = F.transform(F.coalesce("refs", F.array().cast("array<string>")), lambda x: F.concat(pad, F.lit("    "), x))
    text = F.array_join(F.concat(F.array(head), F.coalesce(props, F.array().cast("array<string>")), links), "\n")
    return nodes.join(refs, ["model_id", "source", "path", "node_id"], "left").select("model_id", "root", "pre", text.alias("text")).orderBy("model_id", "root", "pre")


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def of_json(df: DataFrame, schema: str) -> DataFrame:
    """Rows from JSON texts (column json) of the given columns; the way back from as_json."""
    return df.select(F.from_json("json", schema).alias("row")).select("row.*")


def solutions_as_json(repo: Repository) -> DataFrame:
    return as_json(repo.modules.where("kind = 'solution'").select(F.col("module_id").alias("id"), "name"))


def models_of_solution_as_json(repo: Repository, module_id: str) -> DataFrame:
    return as_json(repo.models.where(F.col("module_id") == module_id).select(F.col("model_id").alias("id"), "name"))


def root_nodes_of_model_as_json(repo: Repository, model_id: str) -> DataFrame:
    """Each root node with its properties and references; children are named by their ids, so that no row holds a tree."""
    roots = repo.roots_of(model_id=model_id)
    links = repo.linked(roots).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("link", "kind", "target_model_id", "target_node_id"))).alias("links"))
    return as_json(roots.join(links, "node_id", "left").select(F.col("node_id").alias("id"), "concept", F.col("props").alias("properties"), "links"))
