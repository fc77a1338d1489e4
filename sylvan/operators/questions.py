"""Questions that take arguments, over the canonical tables of a repository of any kind.

A class that mixes this in has DataFrames ``modules`` (module_id, name, kind, path, scan_ord), ``models`` (model_id, name, module_id, path,
scan_ord), ``nodes`` (model_id, node_id, parent_id, root_id, concept, role, ord, depth, props) and ``node_refs`` (model_id, node_id, role,
ord, target_model_id, target_node_id), and may have ``languages``, ``concepts``, ``aspect_models``, ``module_deps`` and ``model_imports``.  Every question is a filter or a join
that reaches the scan; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

_NODE = ["model_id", "node_id"]


class Questions:
    # --- modules, models, languages ---

    def module_by_name(self, name: str, kind: str | None = None) -> DataFrame:
        """The first found of that name (of modules, or of one kind: solution, language); no row if there is none."""
        own = self.modules.where(F.col("name") == name)
        return (own if kind is None else own.where(F.col("kind") == kind)).orderBy("scan_ord", F.col("path").startswith("jar:"), "path").limit(1)

    def module_by_id(self, module_id: str) -> DataFrame:
        return self.modules.where(F.col("module_id") == module_id)

    def models_by_name(self, name: str, module_id: str | None = None) -> DataFrame:
        """All of that name, or those of one module."""
        own = self.models.where(F.col("name") == name)
        return own if module_id is None else own.where(F.col("module_id") == module_id)

    def model_by_name(self, name: str, module_id: str | None = None) -> DataFrame:
        return self.models_by_name(name, module_id).orderBy("scan_ord", F.col("path").startswith("jar:"), "path").limit(1)

    def model_by_id(self, model_id: str) -> DataFrame:
        return self.models.where(F.col("model_id") == model_id)

    def by_path(self, kind: str, path: str | None) -> DataFrame:
        """The ``module`` or ``model`` whose own file that is; no row for a null path."""
        return (self.modules if kind == "module" else self.models).where(F.col("path") == F.lit(path))

    def language_by_name(self, name: str) -> DataFrame:
        return self.languages.where(F.col("name") == name)

    def concept_by_name(self, name: str, language_id: str | None = None) -> DataFrame:
        own = self.concepts.where(F.col("name") == name)
        return own if language_id is None else own.where(F.col("language_id") == language_id)

    def concept_by_short_name(self, short: str) -> DataFrame:
        """The first, by name, whose last part that is."""
        return self.concepts.where(ids.short_name(F.col("name")) == short).orderBy("name").limit(1)

    def aspect_models_of(self, language: str, suffix: str) -> DataFrame:
        """Models of a language's own module whose names end so, in the order of their paths."""
        return self.aspect_models.where((F.col("language") == language) & F.col("name").endswith(suffix)).orderBy("path")

    def models_of(self, modules: DataFrame) -> DataFrame:
        return self.models.join(modules.select("module_id").distinct(), "module_id", "left_semi")

    def dependency_modules(self) -> DataFrame:
        """module_id, dep_module_id, target: each module reference with the module it means, null for an unknown one."""
        target = self.modules.select(F.col("module_id").alias("dep_module_id"), F.struct("name", "kind", "path").alias("target"))
        return self.module_deps.select("module_id", "dep_module_id").join(target, "dep_module_id", "left").select("module_id", "dep_module_id", "target")

    # --- nodes ---

    def node_by_id(self, model_id: str, node_id: str) -> DataFrame:
        return self.nodes.where((F.col("model_id") == model_id) & (F.col("node_id") == node_id))

    def nodes_of_concept(self, concept: str) -> DataFrame:
        """By full name."""
        return self.nodes.where(F.col("concept") == concept)

    def nodes_of_short_concept(self, short: str) -> DataFrame:
        """By the last part of the name; where concepts of several full names have it, running the plan is an error that names two of them."""
        own = self.nodes.where(ids.short_name(F.col("concept")) == short)
        several = F.concat(F.lit(f"several concepts are called {short}: "), F.min("concept"), F.lit(", "), F.max("concept"))
        guard = own.agg(F.when(F.min("concept") != F.max("concept"), F.raise_error(several).cast("boolean")).otherwise(F.lit(True))).scalar()
        return own.where(guard)

    def nodes_with_property(self, name: str, value: str | None = None) -> DataFrame:
        """Nodes that have the property, with any value or with this one."""
        own = F.try_element_at("props", F.lit(name))
        return self.nodes.where(own.isNotNull() if value is None else own == value)

    def roots_of(self, model_id: str | None = None, name: str | None = None, concept: str | None = None, most: int | None = None) -> DataFrame:
        """Root nodes, of one model, name or concept, and no more than so many if asked for."""
        out = self.nodes.where("parent_id is null")
        for column, value in ((F.col("model_id"), model_id), (F.try_element_at("props", F.lit("name")), name), (F.col("concept"), concept)):
            out = out if value is None else out.where(column == value)
        return out if most is None else out.orderBy("model_id", "ord", "node_id").limit(most)

    @staticmethod
    def property_of(nodes: DataFrame, name: str, default: str | None = None) -> DataFrame:
        """model_id, node_id, value, without blanks at its ends; null, or the default, for nodes without it."""
        value = F.trim(F.try_element_at("props", F.lit(name)))
        return nodes.select(*_NODE, (value if default is None else F.coalesce(value, F.lit(default))).alias("value"))

    def references_of(self, nodes: DataFrame, role: str | None = None) -> DataFrame:
        """References of the nodes, of one role or all."""
        own = self.node_refs.join(nodes.select(*_NODE), _NODE, "left_semi")
        return own if role is None else own.where(F.col("role") == role)

    def children_of(self, nodes: DataFrame, role: str | None = None) -> DataFrame:
        """Child nodes with ``place`` among their parent's of the same role, from 0, in document order."""
        from pyspark.sql import Window

        above = nodes.select("model_id", F.col("node_id").alias("parent_id"))
        own = self.nodes.where("parent_id is not null").join(above, ["model_id", "parent_id"], "left_semi")
        own = own if role is None else own.where(F.col("role") == role)
        return own.withColumn("place", F.row_number().over(Window.partitionBy("model_id", "parent_id", "role").orderBy("ord", "node_id")) - 1)

    def parents_of(self, nodes: DataFrame) -> DataFrame:
        above = nodes.where("parent_id is not null").select("model_id", F.col("parent_id").alias("node_id")).distinct()
        return self.nodes.join(above, _NODE, "left_semi")

    def linked(self, nodes: DataFrame, link: str | None = None) -> DataFrame:
        """model_id, node_id, link, kind (child or reference), target_model_id, target_node_id of one link name, or of all."""
        below = nodes.select("model_id", F.col("node_id").alias("parent_id"))
        kids = self.nodes.join(below, ["model_id", "parent_id"], "left_semi").select("model_id", F.col("parent_id").alias("node_id"), F.col("role").alias("link"), F.lit("child").alias("kind"), F.col("model_id").alias("target_model_id"), F.col("node_id").alias("target_node_id"))
        refs = self.references_of(nodes).select(*_NODE, F.col("role").alias("link"), F.lit("reference").alias("kind"), "target_model_id", "target_node_id")
        out = kids.unionByName(refs)
        return out if link is None else out.where(F.col("link") == link)

    def member(self, nodes: DataFrame, name: str) -> DataFrame:
        """model_id, node_id, kind, value, targets of whatever member has that name: a property, else children, else a reference.

        kind is property, child (a single one), children, reference, or null if the node has no such member.
        """
        own = nodes.select(*_NODE, F.try_element_at("props", F.lit(name)).alias("value"))
        links = self.linked(nodes, name).groupBy(*_NODE).agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "child", F.col("target_node_id")))).alias("kids"), F.array_sort(F.collect_list(F.when(F.col("kind") == "reference", F.col("target_node_id")))).alias("refs")
        )
        some = F.coalesce(F.size("kids"), F.lit(0))
        kind = F.when(F.col("value").isNotNull(), "property").when(some == 1, "child").when(some > 1, "children").when(F.size("refs") > 0, "reference")
        targets = F.when(kind.isin("child", "children"), F.col("kids")).when(kind == "reference", F.col("refs"))
        return own.join(links, _NODE, "left").select(*_NODE, kind.alias("kind"), "value", targets.alias("targets"))
