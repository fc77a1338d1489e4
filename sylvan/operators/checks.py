"""Checks of models, and their verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids and names that a reader gives to models without their own.
NO_ID, NO_NAME = ["", "r:unknown"], ["", "unknown.model"]
CHECKS = ["uuid_set", "name_set", "concepts_set", "node_ids_set", "properties_set", "references_set"]


def verify(models: DataFrame, nodes: DataFrame, node_refs: DataFrame) -> DataFrame:
    """model_id, name, six checks of the model and its root nodes, and ``bad``: the names of those that it fails.

    Models have an id and a name; roots have a concept, an id and properties (which may be none at all), and their references a role.
    Models without any node pass the checks of nodes.
    """
    roots = nodes.where("parent_id is null")
    per = roots.groupBy("model_id").agg(
        F.count_if(F.coalesce("concept", F.lit("")) == "").alias("_concepts"), F.count_if(F.col("node_id").isNull()).alias("_ids"), F.count_if(F.col("props").isNull()).alias("_props")
    )
    odd = node_refs.where("role is null").select("model_id", "node_id").join(roots.select("model_id", "node_id"), ["model_id", "node_id"], "left_semi")
    odd = odd.groupBy("model_id").agg(F.count("*").alias("_refs"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    out = models.select("model_id", "name").join(per, "model_id", "left").join(odd, "model_id", "left").select(
        "model_id", "name", (F.coalesce("model_id", F.lit("")).isin(NO_ID) == F.lit(False)).alias("uuid_set"), (F.coalesce("name", F.lit("")).isin(NO_NAME) == F.lit(False)).alias("name_set"),
        none("_concepts").alias("concepts_set"), none("_ids").alias("node_ids_set"), none("_props").alias("properties_set"), none("_refs").alias("references_set"),
    )
    return out.withColumn("bad", F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in CHECKS]), lambda c: c.isNotNull()))


def verdict(verified: DataFrame) -> DataFrame:
    """failed, total, and a line that says so."""
    counted = verified.agg(F.count_if(F.size("bad") > 0).alias("failed"), F.count("*").alias("total"))
    failed, total = F.col("failed").cast("string"), F.col("total").cast("string")
    return counted.withColumn("said", F.when(F.col("failed") == 0, F.concat(F.lit("All "), total, F.lit(" models passed verification"))).otherwise(F.concat(failed, F.lit(" models failed verification"))))
