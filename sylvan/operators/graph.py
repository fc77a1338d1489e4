"""Reachability in dependency graphs: from seeds, in all pairs, and the cone of influence of changed entities.

Rounds are tables in the shared folder, which cuts lineage; a lost executor costs the tasks of the current round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

#: Rows of one id up to which a side of a join is broadcast, some 50 MB; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="sylvan-")
    return shared.rstrip("/")


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves none of its shuffles on disk; else these stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Rounds:
    """Tables of one run, written and read back."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def keep(self, df: DataFrame, gone: DataFrame | None = None, hits: str = "false", by: str | None = None) -> DataFrame:
        """The table as written, with ``rows`` and how many of them are ``hits``, counted on the way; another one that no later round reads is removed.
        Rows of one value of ``by``, of which there are few, are found without reading others."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        seen = Observation()
        with freed(self.spark):
            out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(hits)).alias("hits")).write
            (out.partitionBy(by) if by else out).parquet(path)
        if gone is not None:
            self.drop(gone)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at, out.rows, out.hits = path, seen.get["rows"], seen.get["hits"]
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.kept_at)
            path.getFileSystem(conf).delete(path, True)


def _edges(edges: DataFrame, low: str, high: str) -> DataFrame:
    return edges.select(F.col(low).cast("string").alias("x"), F.col(high).cast("string").alias("y")).where("x is not null and y is not null").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def reach(seeds: DataFrame, edges: DataFrame, rounds: Rounds, back: bool = False) -> tuple[DataFrame, list[int]]:
    """id of the seeds (their first column) and of all that they reach along edges (x, y), or against these; and how many each round found.

    A round joins only what the last one found with the edges, so its rows follow the cone, not the graph; there are as many rounds as the
    longest of the shortest paths from a seed.  What was found is broadcast to the edges behind a count.
    """
    near, far = ("y", "x") if back else ("x", "y")
    known = rounds.keep(seeds.select(F.col(seeds.columns[0]).cast("string").alias("id")).where("id is not null").distinct())
    tables, found = [known], [known.rows]
    fresh = known
    while found[-1]:
        onward = edges.join(_small(fresh, found[-1]), F.col(near) == F.col("id"), "left_semi").select(F.col(far).alias("id")).distinct()
        fresh = rounds.keep(onward.join(_small(known, sum(found)), "id", "left_anti"))
        found.append(fresh.rows)
        tables.append(fresh)
        known = rounds.spark.read.schema("id string").parquet(*[t.kept_at for t in tables])
    return known, found


def strong_components(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """node, component of all nodes that lie on a cycle with another one, by forward-backward colouring of edges (x, y).

    What has no edge in or none out is on no cycle and goes first.  Each node left takes the greatest id that reaches it as its colour; the nodes
    that reach that id within its colour are its component.  Edges between colours and those of components found go, and the rest begins anew.
    Rounds write a row for each node or edge that is left, whatever the size of a component.
    """
    left, last, out = edges.where("x <> y"), None, None
    while True:
        while True:
            before = None if last is None else last.rows
            ins, outs = left.select(F.col("y").alias("x")).distinct(), left.select(F.col("x").alias("y")).distinct()
            left = last = rounds.keep(left.join(ins, "x", "left_semi").join(outs, "y", "left_semi").select("x", "y"), last)
            if left.rows in (0, before):
                break
        if not left.rows:
            break
        colour, last = left.select(F.col("x").alias("id"), F.col("x").alias("colour")).distinct(), None  # all of them have an edge out
        while True:
            by = left.join(colour, F.col("x") == F.col("id")).groupBy(F.col("y").alias("id")).agg(F.max("colour").alias("reached"))
            moved = colour.join(by, "id", "left").select("id", F.greatest("colour", "reached").alias("colour"), F.coalesce(F.col("reached") > F.col("colour"), F.lit(False)).alias("moved"))
            colour = last = rounds.keep(moved, last, hits="moved")
            if not colour.hits:
                break
        of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
        within = rounds.keep(left.join(of("x"), "x").join(of("y"), "y").where("x_colour = y_colour").select("x", "y"), left)
        heads = colour.where("id = colour").select("id")
        members, _ = reach(heads, within, rounds, back=True)
        found = rounds.keep(colour.join(members, "id", "left_semi").select(F.col("id").alias("node"), F.col("colour").alias("component")))
        out = found if out is None else out.unionAll(found)
        gone = found.select("node")
        left = last = rounds.keep(within.join(gone.withColumnRenamed("node", "x"), "x", "left_anti").join(gone.withColumnRenamed("node", "y"), "y", "left_anti").select("x", "y"), within)
        if not left.rows:
            break
    if out is None:
        return rounds.spark.createDataFrame([], "node string, component string")
    several = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return out.join(several, "component", "left_semi").select("node", "component")


class Closure:
    """Which nodes reach which, through strong components: ``members`` (node, component) of every node of the edges, and ``between``
    (x, y): components that reach one another, a component itself only if it has a cycle.

    The components' graph has no cycles; its paths double in each round, so the rounds are as many as the bits of the longest path.
    """

    def __init__(self, edges: DataFrame, low: str, high: str):
        rounds = Rounds(edges.sparkSession, "closure")
        own = rounds.keep(_edges(edges, low, high))
        cyclic = strong_components(own, rounds)
        nodes = own.select(F.col("x").alias("node")).unionAll(own.select(F.col("y"))).distinct()
        self.members = rounds.keep(nodes.join(cyclic, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        of = lambda end: self.members.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        base = own.join(of("x"), "x").join(of("y"), "y").select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
        base = table = rounds.keep(base.withColumn("fresh", F.col("x") != F.col("y")), hits="fresh")
        loops, known = base.where("x = y").select("x", "y"), base.where("x <> y")
        while table.hits:
            step = known.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("fresh").alias("also"))
            onward = known.join(step, "y").where("fresh or also").select("x", F.col("z").alias("y"), F.lit(True).alias("fresh"))
            found = onward.unionAll(known.select("x", "y", F.lit(False)))
            table = known = rounds.keep(found.groupBy("x", "y").agg(F.min("fresh").alias("fresh")), None if table is base else table, hits="fresh")
        self.between = known.select("x", "y").unionAll(loops)

    def pairs(self) -> DataFrame:
        """All (x, y) of nodes with y reachable from x by one edge or more; (x, x) only on a cycle."""
        of = lambda end: self.members.select(F.col("component").alias(f"c{end}"), F.col("node").alias(end))
        return self.between.select(F.col("x").alias("cx"), F.col("y").alias("cy")).join(of("x"), "cx").join(of("y"), "cy").select("x", "y")


def closure(edges: DataFrame, low: str, high: str) -> DataFrame:
    """All (x, y) with y reachable from x by one edge or more; (x, x) only on a cycle."""
    return Closure(edges, low, high).pairs()


def downstream(reachable: DataFrame) -> DataFrame:
    """The inversion of a closure."""
    return reachable.select(F.col("y").alias("x"), F.col("x").alias("y"))


def cone(modified: DataFrame, edges: DataFrame, low: str, high: str) -> DataFrame:
    """id, affected: modified entities and all that depend on them, along edges (low depends on high); with affected false, what these need besides.

    Only what is reached is joined with the edges, round by round; no closure is built.
    """
    rounds = Rounds(edges.sparkSession, "cone")
    own = rounds.keep(_edges(edges, low, high))
    affected, _ = reach(modified, own, rounds, back=True)
    needed, _ = reach(affected, own, rounds)
    return needed.join(affected.withColumn("_hit", F.lit(True)), "id", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("affected"))


def touched_files(changed: DataFrame, listed: DataFrame) -> DataFrame:
    """path of every changed file, and of all listed files that lie directly in a directory above one (at any height, but for the top itself).

    A model's directory and its module's are above each of the model's files, so a change of any file below marks both.
    """
    dirs = changed.select(F.explode(ids.ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    beside = listed.select("path").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).where("dir <> ''").join(dirs, "dir", "left_semi")
    return changed.select("path").unionAll(beside.select("path")).distinct()


def modified_entities(changed: DataFrame, listed: DataFrame, modules: DataFrame, models: DataFrame) -> DataFrame:
    """path, kind, id: the module or model behind every touched descriptor (.msd) and model file (.mps, .model); id is null where there is none.

    ``modules`` and ``models`` have an id and the path of the entity's own file.  Other files stand for nothing by themselves.
    """
    kind = F.when(F.col("path").rlike(r"\.msd$"), "module").when(F.col("path").rlike(r"\.(mps|model)$"), "model")
    touched = touched_files(changed, listed).select("path", kind.alias("kind")).where("kind is not null")
    known = modules.select("path", F.lit("module").alias("kind"), F.col("module_id").alias("id")).unionAll(models.select("path", F.lit("model"), "model_id"))
    return touched.join(known, ["path", "kind"], "left")


def cone_of_influence(modules: DataFrame, models: DataFrame, module_edges: DataFrame, model_edges: DataFrame, modified: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Affected modules and models (with what these need besides: affected false) of modified entities (path, kind, id).

    A missing module affects all modules; a missing model means the cone of the modified modules alone; in both cases models are None.
    """
    missing = F.col("id").isNull()
    flags = modified.agg(F.coalesce(F.bool_or(missing & (F.col("kind") == "module")), F.lit(False)).alias("m"), F.coalesce(F.bool_or(missing & (F.col("kind") == "model")), F.lit(False)).alias("n")).first()
    if flags["m"]:
        return modules.select("module_id").distinct().withColumn("affected", F.lit(True)), None
    own = lambda kind: modified.where(F.col("kind") == kind).select("id")
    if flags["n"]:
        return cone(own("module"), module_edges, "module_id", "dep_module_id").withColumnRenamed("id", "module_id"), None
    hit = cone(own("model"), model_edges, "model_id", "imported_model_id").withColumnRenamed("id", "model_id")
    of = models.select("model_id", "module_id").join(hit, "model_id").groupBy("module_id").agg(F.max("affected").alias("affected"))
    return of, hit
