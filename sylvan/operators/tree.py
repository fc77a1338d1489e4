"""Navigation in the containment forest, without recursion at query time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Rounds

#: Nodes of a root that a node is held against on the average, and nodes of the largest root, up to which a root's nodes are simply joined; beyond, bins.
TRIED, ROOT = 256, 1 << 16


def children(nodes: DataFrame, role: str | None = None) -> DataFrame:
    """parent_id, node_id of child nodes, of one role or all."""
    own = nodes.where(F.col("parent_id").isNotNull())
    return (own if role is None else own.where(F.col("role") == role)).select("model_id", "parent_id", "role", "node_id")


def ancestors(nodes: DataFrame, levels: int) -> DataFrame:
    """node_id, ancestor_id, up of every node and each node above it; levels bounds the forest's depth."""
    up = nodes.where(F.col("parent_id").isNotNull()).select("node_id", F.col("parent_id").alias("ancestor_id"))
    step, out, at = up.select(F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("above")), None, up.withColumn("up", F.lit(1))
    for k in range(1, levels + 1):
        out = at if out is None else out.unionAll(at)
        if k < levels:
            at = at.join(step, "ancestor_id").select("node_id", F.col("above").alias("ancestor_id"), F.lit(k + 1).alias("up"))
    return out


def intervals(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes with pre and last, from a path that sorts in document order: descendants of a are those of its root with a.pre < pre <= a.last.

    A root's nodes are numbered by themselves, so no task holds more than a root.  From the end of the document, a node's subtree reaches
    back to the last node seen that is no deeper; ``levels`` bounds the depth.
    """
    back = Window.partitionBy("model_id", "root_id").orderBy(F.col("path").desc())
    seen = back.rowsBetween(Window.unboundedPreceding, -1)
    numbered = nodes.withColumn("_k", F.row_number().over(back).cast("long"))
    before = [F.max(F.when(F.col("depth") <= d, F.col("_k"))).over(seen) for d in range(levels + 1)]
    after = F.coalesce(*[F.when(F.col("depth") == d, b) for d, b in enumerate(before)], F.lit(0))
    whole = F.max("_k").over(Window.partitionBy("model_id", "root_id"))
    return numbered.withColumn("pre", whole - F.col("_k") + 1).withColumn("last", F.col("pre") + F.col("_k") - after - 1).drop("_k")


def within(nodes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """nodes (pre) joined with spans (low, high) of the same keys: low < pre <= high.

    Bins have 2**3, 2**5, 2**7 ... places, and a span takes the smallest of them that is half as long as it or longer, so it meets three at most.
    Nodes are dealt to the bin of each size that occurs (31 at most, two or three for small roots), and an equality of keys, size and bin is all
    that the join needs, so that a root of any number of nodes is spread over tasks; a span meets six times its length at most, or 24 rows.
    """
    sized = spans.where("high > low").withColumn("_size", F.greatest(F.lit(3), F.expr("cast(floor(log2(high - low)) as int) | 1")))
    sizes = sized.agg(F.coalesce(F.collect_set("_size"), F.array().cast("array<int>"))).scalar()  # 31 numbers at most
    sized = sized.withColumn("_bin", F.explode(F.expr("sequence(shiftright(low + 1, _size), shiftright(high, _size))")))
    dealt = nodes.withColumn("_size", F.explode(sizes)).withColumn("_bin", F.expr("shiftright(pre, _size)"))
    return dealt.join(sized, [*keys, "_size", "_bin"]).where("pre > low and pre <= high").drop("_size", "_bin")


def descendants(numbered: DataFrame) -> DataFrame:
    """ancestor_id, node_id by interval containment.  The numbers are written once, as both sides and the sizes of spans are taken from them."""
    numbered = Rounds(numbered.sparkSession, "tree").keep(numbered.select("model_id", "root_id", "node_id", "pre", "last"))
    long = numbered.select("model_id", "root_id", "node_id", F.col("pre").cast("long").alias("pre"), F.col("last").cast("long").alias("last"))
    roots = numbered.groupBy("model_id", "root_id").agg(F.count("*").alias("n"))
    tried, most = roots.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.max("n")).first()
    if (tried or 0) <= TRIED and (most or 0) <= ROOT:
        # Both sides have the same columns, so that one shuffle does for both; what lies in a node ends in it.
        a = long.withColumnsRenamed({"node_id": "ancestor_id", "pre": "low", "last": "high"})
        found = long.join(a, ["model_id", "root_id"]).where("pre > low and pre <= high and last <= high")
    else:
        a = long.select("model_id", "root_id", F.col("node_id").alias("ancestor_id"), F.col("pre").alias("low"), F.col("last").alias("high"))
        found = within(long.drop("last"), a, ["model_id", "root_id"])
    return found.select("model_id", "ancestor_id", "node_id")
