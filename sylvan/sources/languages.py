"""What a repository says of its languages: concepts as their structure models declare them, and super-concepts as nodes use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .repository import Repository

#: Names of properties, references and children in structure models.
ABSTRACT, ROOTABLE, ALIAS, DESCRIPTION = "abstract", "rootable", "alias", "shortDescription"
EXTENDS, IMPLEMENTS, INTERFACE = ("extends", "superConcept"), "implements", "intfc"
PROPERTY, TYPE, LINK, LINK_NAME, LINK_KIND, CARDINALITY, TARGET = "propertyDeclaration", "dataType", "linkDeclaration", "role", "metaClass", "sourceCardinality", "target"
STRUCTURE = "structure"

_FILE = ["source", "path"]


def _prop(name: str) -> F.Column:
    return F.trim(F.coalesce(F.try_element_at("props", F.lit(name)), F.lit("")))


def structure_models(repo: Repository) -> DataFrame:
    """The structure model of each language that has one, if it isn't empty: language_id, language, model_id, source, roots."""
    models = repo.aspect_models.where(F.col("name").endswith(STRUCTURE))
    roots = repo.nodes.where("parent_id is null").groupBy("source").agg(F.count("*").alias("roots"))
    return models.join(roots, "source").select(F.col("module_id").alias("language_id"), "language", "model_id", "source", "roots")


def concept_declarations(repo: Repository) -> DataFrame:
    """A row for each declared concept or interface.

    language_id, language, node_id, name, short_kind, is_interface, is_abstract, is_root, alias, description, extends, implements (names), and
    properties (name, type), child_links and reference_links (name, type, cardinality), all in the order of the declaration.
    Types and supers are the names that the references carry.
    """
    nodes = repo.nodes.join(structure_models(repo).select("source", "language_id", "language"), "source")
    roots = nodes.where("parent_id is null").where(F.lower(ids.short_name(F.col("concept"))).contains("concept"))
    refs = repo.node_refs.select(*_FILE, "node_id", "role", F.trim(F.coalesce("resolve_info", F.lit(""))).alias("info"))
    of_root = refs.where(F.col("role").isin(*EXTENDS)).groupBy(*_FILE, "node_id").agg(F.min_by("info", F.when(F.col("role") == EXTENDS[0], 0).otherwise(1)).alias("extends"))
    kind = F.coalesce(_prop(LINK_KIND), F.lit(""))
    kids = nodes.where("depth = 1").where(F.col("role").isin(IMPLEMENTS, PROPERTY, LINK))
    wanted = F.when(F.col("kid_role") == IMPLEMENTS, INTERFACE).when(F.col("kid_role") == PROPERTY, TYPE).otherwise(TARGET)
    kids = kids.select(*_FILE, "root_id", "node_id", F.col("role").alias("kid_role"), "ord", "pre", _prop("name").alias("own_name"), _prop(LINK_NAME).alias("link_name"), ids.enum_name(_prop(CARDINALITY)).alias("cardinality"), kind.alias("kind"))
    kids = kids.withColumn("role", wanted).join(refs, [*_FILE, "node_id", "role"], "left").withColumn("info", F.coalesce("info", F.lit("")))
    place = F.coalesce("pre", "ord")

    def gathered(condition: F.Column, *fields: F.Column) -> F.Column:
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct(place.alias("at"), F.struct(*fields).alias("x")))))
        return F.transform(rows, lambda r: r["x"])

    is_link = (F.col("kid_role") == LINK) & (F.col("link_name") != "")
    link = (F.col("link_name").alias("name"), F.col("info").alias("type"), F.col("cardinality"))
    by = kids.groupBy(*_FILE, F.col("root_id").alias("node_id")).agg(
        F.transform(gathered((F.col("kid_role") == IMPLEMENTS) & (F.col("info") != ""), F.col("info").alias("name")), lambda x: x["name"]).alias("implements"),
        gathered((F.col("kid_role") == PROPERTY) & (F.col("own_name") != ""), F.col("own_name").alias("name"), F.col("info").alias("type")).alias("properties"),
        gathered(is_link & F.contains("kind", F.lit("aggregation")), *link).alias("child_links"),
        gathered(is_link & F.contains("kind", F.lit("reference")) & ~F.contains("kind", F.lit("aggregation")), *link).alias("reference_links"),
    )
    short = ids.short_name(F.col("concept"))
    name = F.when(_prop("name") != "", _prop("name")).otherwise(short)
    out = roots.join(of_root, [*_FILE, "node_id"], "left").join(by, [*_FILE, "node_id"], "left")
    lists = [F.coalesce(c, F.array().cast(by.schema[c].dataType)).alias(c) for c in ("implements", "properties", "child_links", "reference_links")]
    return out.select("language_id", "language", "node_id", name.alias("name"), short.alias("short_kind"), short.contains("Interface").alias("is_interface"), (_prop(ABSTRACT) == "true").alias("is_abstract"), (_prop(ROOTABLE) == "true").alias("is_root"), _prop(ALIAS).alias("alias"), _prop(DESCRIPTION).alias("description"), F.coalesce("extends", F.lit("")).alias("extends"), *lists)


def super_concepts(repo: Repository) -> DataFrame:
    """concept, super: owners of the members that nodes of a concept use, apart from the concept itself.

    A child role's owner is compared with the parent's concept, a property's or reference's with the node's own.  Where a file's registry has a member's name
    under several concepts and one of these is the node's, that one is meant.
    """
    nodes = repo.nodes.select(*_FILE, "node_id", "parent_id", "concept", "role", "props")
    above = nodes.select(*_FILE, F.col("node_id").alias("parent_id"), F.col("concept").alias("user"))
    used = nodes.where("parent_id is not null and role is not null").join(above, [*_FILE, "parent_id"]).select("path", F.col("user").alias("concept"), F.lit("child").alias("kind"), F.col("role").alias("member_name"))
    used = used.unionByName(nodes.select("path", "concept", F.lit("property").alias("kind"), F.explode(F.map_keys("props")).alias("member_name")))
    refs = repo.node_refs.select(*_FILE, "node_id", F.col("role").alias("member_name")).join(nodes.select(*_FILE, "node_id", "concept"), [*_FILE, "node_id"])
    used = used.unionByName(refs.select("path", "concept", F.lit("reference").alias("kind"), "member_name")).distinct()
    owners = repo.registry.where("kind is not null and concept_name is not null").select("path", "kind", "member_name", F.col("concept_name").alias("super")).distinct()
    met = used.join(owners, ["path", "kind", "member_name"])
    by = met.groupBy("path", "concept", "kind", "member_name").agg(F.collect_set("super").alias("supers"))
    return by.where(~F.array_contains("supers", F.col("concept"))).select("concept", F.explode("supers").alias("super")).distinct()


def languages_with_aspects(repo: Repository) -> DataFrame:
    """language, version, concepts, aspects (last parts of the names of the language's own models, by path; null if none was found)."""
    models = repo.aspect_models.groupBy(F.col("module_id").alias("language_id")).agg(F.array_sort(F.collect_list(F.struct("path", ids.short_name(F.col("name")).alias("aspect")))).alias("m"))
    concepts = repo.concepts.groupBy("language_id").agg(F.count("*").alias("concepts"))
    aspects = F.array_join(F.transform("m", lambda x: x["aspect"]), ", ").alias("aspects")
    return repo.languages.join(concepts, "language_id", "left").join(models, "language_id", "left").select(F.col("name").alias("language"), "version", F.coalesce("concepts", F.lit(0)).alias("concepts"), aspects)
