"""Star-schema tables viewed as a model repository: modules, models, a containment forest of nodes, references, imports.

Regions are modules, nations models; customers, suppliers and parts are root nodes, orders children of customers, order lines
children of orders.  A line refers to its part and its supplier, which lie in other models.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.questions import Questions


class Forest(Questions):
    """The canonical tables, built lazily; every one reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def modules(self) -> DataFrame:
        return self.table("region").select(_id("M", "r_regionkey").alias("module_id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("scan_ord"), F.lit("solution").alias("kind"), F.concat(F.lit("src/"), _id("M", "r_regionkey"), F.lit("/"), _id("M", "r_regionkey"), F.lit(".msd")).alias("path"))

    @cached_property
    def models(self) -> DataFrame:
        return self.table("nation").select(_id("N", "n_nationkey").alias("model_id"), F.col("n_name").alias("name"), _id("M", "n_regionkey").alias("module_id"), F.col("n_nationkey").cast("long").alias("scan_ord"), F.concat(F.lit("src/"), _id("M", "n_regionkey"), F.lit("/models/"), _id("N", "n_nationkey"), F.lit(".mps")).alias("path"))

    @cached_property
    def lines(self) -> DataFrame:
        """One row a line: several rows of one (order, number) are one node."""
        return self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"), F.min("l_linestatus").alias("status"))

    def _roots(self, table: str, letter: str, key: str, model: F.Column, concept: str, name: str, **props: str) -> DataFrame:
        own = _id(letter, key)
        return self.table(table).select(model.alias("model_id"), own.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), own.alias("root_id"), F.lit(concept).alias("concept"), F.lit(None).cast("string").alias("role"), F.lit(0).alias("depth"), F.col(name).alias("name"), F.col(key).cast("long").alias("ord"), _props(name=name, **props))

    @cached_property
    def customers(self) -> DataFrame:
        return self._roots("customer", "C", "c_custkey", _id("N", "c_nationkey"), "Customer", "c_name", segment="c_mktsegment")

    @cached_property
    def roots(self) -> DataFrame:
        return (
            self.customers
            .unionAll(self._roots("supplier", "S", "s_suppkey", _id("N", "s_nationkey"), "Supplier", "s_name"))
            .unionAll(self._roots("part", "P", "p_partkey", F.concat(F.lit("N"), (F.col("p_partkey") % 25).cast("string")), "Part", "p_name", brand="p_brand", type="p_type"))
        )

    @cached_property
    def _order_rows(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def orders(self) -> DataFrame:
        return self._order_rows.select(_id("N", "c_nationkey").alias("model_id"), _id("O", "o_orderkey").alias("node_id"), _id("C", "o_custkey").alias("parent_id"), _id("C", "o_custkey").alias("root_id"), F.lit("Order").alias("concept"), F.lit("orders").alias("role"), F.lit(1).alias("depth"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").cast("long").alias("ord"), _props(name="o_orderstatus", priority="o_orderpriority"))

    @cached_property
    def _line_rows(self) -> DataFrame:
        return self.lines.join(self._order_rows, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("node_id", F.concat(_id("L", "l_orderkey"), F.lit("_"), F.col("l_linenumber").cast("string")))

    @cached_property
    def line_nodes(self) -> DataFrame:
        return self._line_rows.select(_id("N", "c_nationkey").alias("model_id"), "node_id", _id("O", "l_orderkey").alias("parent_id"), _id("C", "o_custkey").alias("root_id"), F.lit("Line").alias("concept"), F.lit("lines").alias("role"), F.lit(2).alias("depth"), F.col("status").alias("name"), F.col("l_linenumber").cast("long").alias("ord"), _props(name="status"))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.roots.unionAll(self.orders).unionAll(self.line_nodes)

    @cached_property
    def placed_refs(self) -> DataFrame:
        """References with the root and the numbers of order and line of their nodes, so that nobody has to look for these."""
        own = _id("N", "c_nationkey").alias("model_id"), "node_id", _id("C", "o_custkey").alias("root_id"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("long").alias("line")
        return self._line_rows.select(*own, F.explode(F.create_map(F.lit("part"), _id("P", "part"), F.lit("supplier"), _id("S", "supplier"))).alias("role", "target_node_id"))

    @cached_property
    def refs(self) -> DataFrame:
        """Line to part and supplier: model_id, node_id, role, target_node_id."""
        return self.placed_refs.select("model_id", "node_id", "role", "target_node_id")

    @cached_property
    def node_refs(self) -> DataFrame:
        """References with the model of their target, null for an unknown one."""
        target = self.roots.select(F.col("node_id").alias("target_node_id"), F.col("model_id").alias("target_model_id"))
        return self.refs.join(target, "target_node_id", "left").withColumn("ord", F.lit(0))

    @cached_property
    def imports(self) -> DataFrame:
        """Model to imported model, from the references of all lines, without self-imports; cyclic."""
        targets = self.roots.select(F.col("node_id").alias("target_node_id"), F.col("model_id").alias("imported_model_id"))
        return self.refs.select("model_id", "target_node_id").join(targets, "target_node_id").where("model_id <> imported_model_id").select("model_id", "imported_model_id").distinct()

    @cached_property
    def main_imports(self) -> DataFrame:
        """Of each model's imports the one that most of its references lead to (of equal ones that of the smallest id)."""
        used = self.refs.groupBy("model_id", "target_node_id").agg(F.count("*").alias("n"))
        targets = self.roots.select(F.col("node_id").alias("target_node_id"), F.col("model_id").alias("imported_model_id"))
        per = used.join(targets, "target_node_id").where("model_id <> imported_model_id").groupBy("model_id", "imported_model_id").agg(F.sum("n").alias("n"))
        first = per.groupBy("model_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "imported_model_id")).alias("m"))
        return first.select("model_id", F.col("m.imported_model_id").alias("imported_model_id"))

    @cached_property
    def model_imports(self) -> DataFrame:
        return self.imports

    @cached_property
    def module_deps(self) -> DataFrame:
        of = self.models.select("model_id", "module_id")
        to = of.select(F.col("model_id").alias("imported_model_id"), F.col("module_id").alias("dep_module_id"))
        return self.imports.join(of, "model_id").join(to, "imported_model_id").where("module_id <> dep_module_id").select("module_id", "dep_module_id").distinct()

    @cached_property
    def files(self) -> DataFrame:
        """path of every file that the modules and models would have."""
        return self.modules.select("path").unionAll(self.models.select("path"))


def _id(letter: str, key: str) -> F.Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _props(**columns: str) -> F.Column:
    pairs = F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("props")


#: The same tables as DuckDB SQL; order and properties of nodes are taken from the tables where a query needs them.
SQL = """
lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supplier, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2),
modules AS (SELECT 'M' || r_regionkey AS module_id, r_name AS name, CAST(r_regionkey AS BIGINT) AS scan_ord FROM region),
models AS (SELECT 'N' || n_nationkey AS model_id, n_name AS name, 'M' || n_regionkey AS module_id, CAST(n_nationkey AS BIGINT) AS scan_ord FROM nation),
nodes AS (
  SELECT 'N' || c_nationkey AS model_id, 'C' || c_custkey AS node_id, NULL AS parent_id, 'C' || c_custkey AS root_id, 'Customer' AS concept, NULL AS role, 0 AS depth, c_name AS name FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, NULL, 'S' || s_suppkey, 'Supplier', NULL, 0, s_name FROM supplier
  UNION ALL SELECT 'N' || (p_partkey % 25), 'P' || p_partkey, NULL, 'P' || p_partkey, 'Part', NULL, 0, p_name FROM part
  UNION ALL SELECT 'N' || c_nationkey, 'O' || o_orderkey, 'C' || o_custkey, 'C' || o_custkey, 'Order', 'orders', 1, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'N' || c_nationkey, 'L' || l_orderkey || '_' || l_linenumber, 'O' || l_orderkey, 'C' || o_custkey, 'Line', 'lines', 2, status FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
refs AS (SELECT 'N' || c_nationkey AS model_id, 'L' || l_orderkey || '_' || l_linenumber AS node_id, role, CASE role WHEN 'part' THEN 'P' || part ELSE 'S' || supplier END AS target_node_id
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey, (VALUES ('part'), ('supplier')) r(role)),
targets AS (SELECT 'P' || p_partkey AS node_id, 'N' || (p_partkey % 25) AS model_id FROM part UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
imports AS (SELECT DISTINCT r.model_id, t.model_id AS imported_model_id FROM refs r JOIN targets t ON r.target_node_id = t.node_id WHERE r.model_id <> t.model_id)
"""
