"""Repositories on disk: directories of descriptors, models and archives, as the canonical tables.

Names that begin with a dot or an underscore count here, so Spark's own listing won't do.  A scan lists on the driver and takes filters; a
snapshot or its refresh lists by tasks.  Both deal files to tasks by size and parse every file once.  The first found is the one of the first
path, files before entries of archives, in the order of their paths.  Anything that can't be read becomes a row of ``errors``; other files are not affected.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import accumulate, chain

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from ..operators import graph, tree
from ..operators.questions import Questions
from . import binary_models, xml_models
from .files import FilesWriter, Written
from .listing import ARCHIVE, BINARY, HEADER, ITEM, LANGUAGE, ROOT, SINGLE, SOLUTION, Item, classify, divided, entries, found_files, items, listing, opened
from .rows import HEAD_TABLES, MODEL_TABLES, MODULE_TABLES, SCHEMA, TABLES, struct

FORMAT, KEPT = "model_repository", "model_snapshot"
#: Bytes of a table's rows that a task holds before it writes them.
GROUP_BYTES = 16 << 20
BATCH_ROWS = 4096
OPEN_COST = 256 << 10
#: Bytes that a task parses, and that an archive's part has unpacked.
SHARE = 16 << 20
#: Bytes that one of an archive is taken to unpack to.
PACKED = 8
#: Bytes of an archive, or of its entry, that are read at once; a larger entry is unpacked as it is parsed.
HELD = 4 << 20


@dataclass
class Task(InputPartition):
    """Items below one path, and what is wrong with the path."""

    top: str
    items: list
    complaints: list


class RepositorySource(DataSource):
    """Options: ``paths`` (JSON list) and ``task_bytes``, the share of a task; archives larger than it are dealt by their entries.
    With ``table`` and its ``columns`` (JSON list) rows have these alone, not the columns of all tables.

    Filters of ``table`` and ``file`` (the path of a model file, descriptor or archive) reach the reader: equal to, in, and for files their
    beginnings and endings.  They decide which files become tasks and which parts of them are parsed.  As Spark has it, filters are pushed into
    Python data sources only if spark.sql.python.filterPushdown.enabled is set, which ``Repository`` does.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _ddl(self.options["table"], json.loads(self.options["columns"])) if "table" in self.options else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RepositoryReader(dict(self.options))


def _columns(table: str) -> list[str]:
    return [part.split(" ")[0] for part in TABLES[table].split(", ")]


def _ddl(table: str, columns: list[str]) -> str:
    kinds = dict(part.split(" ") for part in TABLES[table].split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def _parsed_bytes(item: Item) -> int:
    """An archive's part has its unpacked size already."""
    return item.size * PACKED if item.kind == ARCHIVE and item.last is None else item.size


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.own = (options["table"], json.loads(options["columns"])) if "table" in options else None
        self.wanted = {self.own[0]} if self.own else set(TABLES)
        self.heads: xml_models.Heads = {}
        self.task_bytes = int(options.get("task_bytes", SHARE))
        self.tests: list[tuple[str, tuple]] = []  # of files: a method of str, and values of which one has to hold
        if "beginnings" in options:
            self.tests.append(("startswith", tuple(json.loads(options["beginnings"]))))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if isinstance(f, EqualTo | In) and f.attribute == ("table",):
                self.wanted &= set(values)
            elif isinstance(f, EqualTo | In) and f.attribute == ("file",):
                self.tests.append(("__eq__", tuple(values)))
            elif isinstance(f, StringStartsWith | StringEndsWith) and f.attribute == ("file",):
                self.tests.append(("startswith" if isinstance(f, StringStartsWith) else "endswith", tuple(values)))
            else:
                yield f

    def _keeps(self, file: str) -> bool:
        return all(any(v is not None and getattr(file, how)(v) for v in values) for how, values in self.tests)

    def partitions(self) -> list[Task]:
        tasks = []
        for nth, path in enumerate(self.paths):
            files, wrong = listing(path)
            if wrong and "errors" in self.wanted and self._keeps(path):
                tasks.append(Task(path, [], [(path, "list", wrong)]))
            kept = [i for i in classify(files, nth) if self._keeps(i.path)]
            if self.wanted <= MODULE_TABLES:
                kept = [i for i in kept if i.kind in (SOLUTION, LANGUAGE, ARCHIVE)]
            kept = [i for i in kept if not self._mute(i)]
            if not self.wanted & (MODULE_TABLES | {"errors", "files"}):
                kept = [i for i in kept if i.kind not in (SOLUTION, LANGUAGE)]
            opens = not self.wanted <= {"files"}
            if opens:  # archives larger than a task's share are dealt by their entries
                kept = [run for i in kept for run in (divided(path, i, self.task_bytes) if i.kind == ARCHIVE and i.size > self.task_bytes else [i])]
            load, bin_ = 0, []
            for item in kept if self.wanted else ():
                cost = _parsed_bytes(item) + OPEN_COST if opens else OPEN_COST // 64
                if bin_ and load + cost > self.task_bytes:
                    tasks.append(Task(path, bin_, []))
                    load, bin_ = 0, []
                bin_.append(item)
                load += cost
            if bin_:
                tasks.append(Task(path, bin_, []))
        return tasks or [Task("", [], [])]

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        rows = ((file, table, row) for file, table, row in self._rows(task) if table in self.wanted)
        yield from _own_batches(rows, *self.own) if self.own else _batches(rows)

    def _mute(self, item: Item) -> bool:
        """Whether a file has nothing that is wanted: of a directory's roots only one speaks for the model."""
        return item.kind == ROOT and not item.lead and self.wanted <= MODEL_TABLES

    def _rows(self, task: Task) -> Iterator[tuple[str, str, dict]]:
        for path, stage, message in task.complaints:
            yield path, "errors", {"path": path, "stage": stage, "message": message}
        for item in task.items:
            if not item.first:
                yield item.path, "files", {"path": item.path, "fingerprint": item.fingerprint, "fresh": True, "size": item.size, "top": task.top, "item": json.dumps(item._asdict())}
        if not self.wanted <= {"files"}:
            yield from self.parsed(task)

    def parsed(self, task: Task) -> Iterator[tuple[str, str, dict]]:
        filesystem = opened(task.top)[0] if task.items else None
        for item in task.items:
            if self._mute(item):
                continue
            try:
                with filesystem.open_input_file(item.path) as f:
                    if item.kind == ARCHIVE:
                        for table, row in self._archive(f, item):
                            yield item.path, table, row
                    else:
                        for table, row in self._parse(f, item, item.path, None):
                            yield item.path, table, row
            except (OSError, ValueError, zipfile.BadZipFile) as e:  # Arrow reports a seek before the start as a ValueError
                yield item.path, "errors", {"path": item.path, "stage": "open", "message": str(e)}

    def _archive(self, f, jar: Item) -> Iterator[xml_models.Row]:
        """Entries of an archive, or of its part; one without descriptors is passed over after a look at its directory."""
        z, inside = entries(io.BytesIO(f.read()) if f.size() <= HELD else f, jar)
        with z:
            for item in inside[jar.first or 0 : jar.last]:
                if self.wanted <= MODULE_TABLES and item.kind not in (SOLUTION, LANGUAGE) or self._mute(item):
                    continue
                prefix = f"jar:file:{jar.path}!/"
                placed = item._replace(dir=prefix + (item.dir or ""), source=item.source and prefix + item.source)
                with z.open(item.path) as entry:
                    yield from self._parse(io.BytesIO(entry.read()) if item.size <= HELD else entry, placed, prefix + item.path, jar.path)

    def _parse(self, f, item: Item, path: str, jar: str | None) -> Iterator[xml_models.Row]:
        persistency = {SINGLE: "default", BINARY: "binary"}.get(item.kind, "file_per_root")
        place = {"scan_ord": item.scan_ord, "dir": item.dir, "source": item.source, "path": path, "jar": jar, "lead": item.lead, "persistency": persistency}
        try:
            if item.kind == BINARY:
                yield from binary_models.model(f.read(), place)
                return
            small = item.size <= xml_models.TREE and item.kind not in (SOLUTION, LANGUAGE)
            rows = xml_models.small_model(f.read(), place, self.wanted, self.heads) if small else None
            if rows is None:
                f.seek(0)
                xml_models.check(f)
            if rows is not None:
                yield from rows
            elif item.kind in (SOLUTION, LANGUAGE):
                yield from xml_models.descriptor(f, place)
            else:
                yield from xml_models.model(f, place, self.wanted)
            if item.kind == ROOT and item.lead:
                yield "errors", {"path": item.source, "stage": "header", "message": "directory of roots without a header"}
        except (xml_models.expat.ExpatError, ValueError) as e:
            yield "errors", {"path": path, "stage": "parse", "message": str(e)}


def _arrow_schema() -> pa.Schema:
    """SCHEMA in Arrow's terms."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    structs = [(name, pa.struct([(part.split(" ")[0], kinds[part.split(" ")[1]]) for part in ddl.split(", ")])) for name, ddl in TABLES.items()]
    return pa.schema([("table", pa.string()), ("file", pa.string()), *structs])


def _table_batches(rows: Iterator[tuple[str, str, dict | xml_models.Columns]]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of each table for itself: the file and the table's struct."""
    full, held = _arrow_schema(), defaultdict(list)
    schemas = {t: pa.schema([full.field("file"), full.field(t)]) for t in TABLES}
    for file, table, row in rows:
        if isinstance(row, xml_models.Columns):
            yield table, _column_batch(schemas[table], file, table, row)
            continue
        held[table].append({"file": file, table: row})
        if len(held[table]) >= BATCH_ROWS:
            yield table, pa.RecordBatch.from_pylist(held.pop(table), schemas[table])
    for table, some in held.items():
        yield table, pa.RecordBatch.from_pylist(some, schemas[table])


def _batches(rows: Iterator[tuple[str, str, dict | xml_models.Columns]]) -> Iterator[pa.RecordBatch]:
    schema, held, small, load = _arrow_schema(), [], [], 0
    for file, table, row in rows:
        if isinstance(row, xml_models.Columns):
            small.append(_column_batch(schema, file, table, row))
            load += small[-1].num_rows
            if load >= BATCH_ROWS:  # files of few nodes share a batch
                yield _joined(small)
                small, load = [], 0
            continue
        held.append({"table": table, "file": file, table: row})
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
    if small:
        yield _joined(small)


def _own_batches(rows: Iterator[tuple[str, str, dict | xml_models.Columns]], table: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one table with some of its columns; files of few nodes share a batch."""
    full = _arrow_schema().field(table).type
    schema = pa.schema([full.field(c) for c in columns])
    held, load = {c: [] for c in columns}, 0

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.MapArray.from_arrays(*_map_parts(held[f.name])) if pa.types.is_map(f.type) else pa.array(held[f.name], f.type) for f in schema], schema=schema)
        for values in held.values():
            values.clear()
        return batch

    for _, _, row in rows:
        if isinstance(row, xml_models.Columns):
            n = len(row.rows)
            lists = dict(zip(row.names, zip(*row.rows)))
            for c, values in held.items():
                if c == "props":
                    values.append((row.sizes, *row.entries))
                elif c in row.same:
                    values += [row.same[c]] * n
                else:
                    values += lists[c]
            load += n
        else:
            for c, values in held.items():
                value = row.get(c)
                if c == "props":
                    value = dict(value or ())
                    value = [len(value)], list(value), list(value.values())
                values.append(value)
            load += 1
        if load >= BATCH_ROWS:
            yield taken()
            load = 0
    if load:
        yield taken()


def _map_parts(parts: list[tuple[list, list, list]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Offsets, keys and values of a map column from its rows' numbers of entries, their keys and their values."""
    sizes, keys, values = [list(chain.from_iterable(p)) for p in zip(*parts)]
    return pa.array(list(accumulate(sizes, initial=0)), pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _column_batch(schema: pa.Schema, file: str, table: str, rows: xml_models.Columns) -> pa.RecordBatch:
    n, kind = len(rows.rows), schema.field(table).type
    lists, children = dict(zip(rows.names, zip(*rows.rows))), []
    for f in kind:
        if pa.types.is_map(f.type):
            children.append(pa.MapArray.from_arrays(pa.array(list(accumulate(rows.sizes, initial=0)), pa.int32()), pa.array(rows.entries[0], pa.string()), pa.array(rows.entries[1], pa.string())))
        else:
            children.append(pa.repeat(pa.scalar(rows.same[f.name], f.type), n) if f.name in rows.same else pa.array(lists[f.name], f.type))
    own = {"table": pa.repeat(table, n), "file": pa.repeat(file, n), table: pa.StructArray.from_arrays(children, fields=list(kind))}
    return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)


def _divide_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives (top, item, size) as runs of their entries."""
    schema = pa.schema([("top", pa.string()), ("item", pa.string()), ("size", pa.int64())])
    for batch in batches:
        for top, item in zip(batch.column("top").to_pylist(), batch.column("item").to_pylist()):
            runs = divided(top, Item(**json.loads(item)), SHARE)
            yield pa.RecordBatch.from_pylist([{"top": top, "item": json.dumps(run._asdict()), "size": run.size} for run in runs], schema)


class SnapshotSource(DataSource):
    """Takes listed files (top, item), parses them and keeps their tables as Parquet, a directory for each below the option ``path``; rows don't pass through Spark
    on their way, where each would have the columns of all tables.  Option ``tables`` (JSON list): those that are kept."""

    @classmethod
    def name(cls) -> str:
        return KEPT

    def schema(self) -> str:
        return "top string, item string"

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(self.options["path"], overwrite, json.loads(self.options["tables"]))


class SnapshotWriter(FilesWriter):
    """A task writes a file for each table, below the staging folder until the commit."""

    def __init__(self, path: str, overwrite: bool, tables: list[str]):
        super().__init__(path, overwrite)
        self.tables = tables

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, staging = arrow_fs.FileSystem.from_uri(self.staging)
        own = f"{staging}/{uuid.uuid4().hex[:12]}"
        filesystem.create_dir(own, recursive=True)
        reader, writers, held = RepositoryReader({"paths": "[]"}), {}, {}
        reader.wanted &= set(self.tables)

        def flush(table: str) -> None:
            rows = pa.Table.from_batches(held.pop(table)[0])
            if table not in writers:
                name = f"table={table}/part-{posixpath.basename(own)}.zstd.parquet"
                filesystem.create_dir(f"{own}/table={table}", recursive=True)
                out = filesystem.open_output_stream(f"{own}/{name}")
                writers[table] = name, out, parquet.ParquetWriter(out, rows.schema, compression="zstd")
            writers[table][2].write_table(rows)

        for batch in iterator:
            for top, item in zip(batch.column("top").to_pylist(), batch.column("item").to_pylist()):
                parsed = reader.parsed(Task(top, [Item(**json.loads(item))], []))
                for table, rows in _table_batches((file, table, row) for file, table, row in parsed if table in reader.wanted):
                    some = held.setdefault(table, ([], []))
                    some[0].append(rows)
                    some[1].append(rows.nbytes)
                    if sum(some[1]) >= GROUP_BYTES:
                        flush(table)
        for table in list(held):
            flush(table)
        with filesystem.open_output_stream(f"{own}.files") as listed:
            for name, out, writer in writers.values():
                writer.close()
                out.close()
                listed.write(f"{name}\n".encode())
        return Written(own)


def _keep(rows: DataFrame, folder: str) -> None:
    """A Parquet directory for each table.  A task has a writer open for each of the few tables, so that rows need no sort by table."""
    conf, key = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(len(TABLES)))
    try:
        rows.write.partitionBy("table").parquet(folder)
    finally:
        conf.set(key, before)


class Repository(Questions):
    """The canonical tables of one or many directories, or of a snapshot of them.

    Each table scans for itself and reads no more than it needs; for repeated use take a ``snapshot``.  Of modules with one name and of
    models with one id the first found stays, unless ``keep_all``.
    """

    def __init__(self, spark: SparkSession, *paths: str, keep_all: bool = False, raw: DataFrame | None = None, only: list[str] | None = None):
        self.spark, self.paths, self.keep_all, self._raw, self._only = spark, paths, keep_all, raw, only
        spark.dataSource.register(RepositorySource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def scan(self, **options: str) -> DataFrame:
        """All that is read, a row each; filters of table and file decide what is."""
        if self._only is not None:
            options["beginnings"] = json.dumps(self._only)
        return self.spark.read.format(FORMAT).options(paths=json.dumps(self.paths), **options).load()

    def of_model(self, model_id: str, heads: Repository | None = None) -> Repository:
        """The repository of the files and archives that have something of a model, and its module's descriptor; they may have other models too.

        Models are read up to their first nodes to find these, or ``heads`` has been kept.  What comes to the driver are paths of one model.
        """
        heads = heads or self
        own = heads.models.where(F.col("model_id") == model_id).select("module_id", "source", "persistency").distinct()
        packed = F.regexp_extract("source", "^jar:file:(.*?)!/", 1)
        plain = own.where(packed == "")
        homes = heads.modules.join(plain, "module_id", "left_semi").where("jar is null").select("path")
        begin = plain.select(F.when(F.col("persistency") == "file_per_root", F.concat("source", F.lit("/"))).otherwise(F.col("source")))
        files = [r[0] for r in own.where(packed != "").select(packed).unionAll(begin).unionAll(homes).distinct().collect()]
        return Repository(self.spark, *self.paths, keep_all=self.keep_all, only=files)

    def table(self, name: str, *columns: str) -> DataFrame:
        """A table as read, or some of its columns, before duplicates go."""
        columns = columns or _columns(name)
        if self._raw is None:
            return self.scan(table=name, columns=json.dumps(columns))
        return self._raw.where(F.col("table") == name).select(*[F.col(f"{name}.{c}") for c in columns])

    # --- snapshots ---

    def snapshot(self, folder: str, tables: set[str] = frozenset(TABLES)) -> Repository:
        """Parses everything once and keeps it as Parquet, a directory for each table, or for some ``tables``.  Tasks list, and what they find is dealt by size."""
        listed = self._list(f"{folder.rstrip('/')}-listed", None)
        _keep(listed, folder)
        self._parse(listed, folder, tables)
        return self.of_snapshot(self.spark, folder, *self.paths, keep_all=self.keep_all)

    @property
    def kept(self) -> bool:
        return self._raw is not None

    def heads(self, folder: str) -> Repository:
        """A snapshot of all but nodes, references and registries: files are parsed up to their first nodes, all at once for all tables."""
        return self if self.kept else self.snapshot(folder, HEAD_TABLES)

    @classmethod
    def of_snapshot(cls, spark: SparkSession, folder: str, *paths: str, keep_all: bool = False) -> Repository:
        return cls(spark, *paths, keep_all=keep_all, raw=spark.read.schema(SCHEMA).parquet(folder))

    def refresh(self, old: str, new: str) -> Repository:
        """A new snapshot for which only files are parsed that changed since the old one; rows of vanished files go.

        Fingerprints meet in a join, and what changed is dealt to tasks as rows, by size.  A file's fingerprint says nothing of the files
        beside it, but for what they make of it: its module, its source, and whether it speaks for its directory.
        """
        part = f"{new.rstrip('/')}-parsed"
        before = self.spark.read.schema(SCHEMA).parquet(old)
        listed = self._list(f"{part}-listed", before)
        _keep(listed, part)
        self._parse(listed, part)
        parsed = self.spark.read.schema(SCHEMA).parquet(part)
        same = listed.where("table = 'files' and not files.fresh").select("file")
        _keep(before.where("table <> 'files'").join(same, "file", "left_semi").unionByName(parsed), new)
        return self.of_snapshot(self.spark, new, *self.paths, keep_all=self.keep_all)

    def _list(self, folder: str, before: DataFrame | None) -> DataFrame:
        """The tables ``files`` and ``errors`` of what is there now, written to a folder; fresh is what has no equal fingerprint before."""
        rounds = graph.Rounds(self.spark, "listing")
        found = found_files(self.spark, self.paths, rounds)
        if self._only is not None:
            begins = F.exists(F.array(*map(F.lit, self._only)).cast("array<string>"), lambda b: F.col("path").startswith(b))
            found = found.where(begins | F.col("wrong").isNotNull())
        known = items(found, rounds).withColumn("item", F.to_json(F.struct(*[part.split(" ")[0] for part in ITEM.split(", ")])))
        if before is None:
            known = known.withColumn("fresh", F.lit(True))
        else:
            was = before.where("table = 'files'").select("files.path", "files.fingerprint", F.lit(True).alias("_same")).distinct()
            known = known.join(was, ["path", "fingerprint"], "left").withColumn("fresh", F.col("_same").isNull())
        fields = {name: [part.split(" ")[0] for part in TABLES[name].split(", ")] for name in ("files", "errors")}
        blank = lambda name, df: df.select(F.lit(name).alias("table"), F.col("path").alias("file"), *[(F.struct(*fields[n]) if n == name else F.lit(None).cast(struct(ddl))).alias(n) for n, ddl in TABLES.items()])
        wrong = found.where("wrong is not null").select("path", F.lit("list").alias("stage"), F.col("wrong").alias("message"))
        blank("files", known).unionByName(blank("errors", wrong)).write.partitionBy("table").parquet(folder)
        return self.spark.read.schema(SCHEMA).parquet(folder)

    def _parse(self, listed: DataFrame, folder: str, tables: set[str] = frozenset(TABLES)) -> None:
        """Keeps all tables but ``files`` of the fresh files; archives larger than a task's share are dealt by their entries."""
        fresh = listed.where("table = 'files' and files.fresh").select("files.top", "files.item", "files.size", "files.path")
        large = F.col("path").endswith(ARCHIVE) & (F.col("size") > SHARE)
        pieces = fresh.where(~large).drop("path").unionAll(fresh.where(large).drop("path").repartition("item").mapInArrow(_divide_listed, "top string, item string, size long"))
        pieces = graph.Rounds(self.spark, "pieces").keep(pieces)
        whole = (F.get_json_object("item", "$.kind") == ARCHIVE) & F.get_json_object("item", "$.last").isNull()
        bytes_ = pieces.agg(F.sum(F.when(whole, F.col("size") * PACKED).otherwise(F.col("size")) + OPEN_COST)).first()[0] or 0
        self.spark.dataSource.register(SnapshotSource)
        dealt = pieces.repartition(1 + int(bytes_ // SHARE), "item").select("top", "item")
        with graph.freed(self.spark):
            dealt.write.format(KEPT).options(path=folder, tables=json.dumps(sorted(set(tables) - {"files"}))).mode("append").save()

    # --- tables ---

    def _first(self, df: DataFrame, key: str) -> DataFrame:
        if self.keep_all:
            return df
        alone = F.when(F.col(key).isNull(), F.col("path"))  # those of no name aren't copies of each other
        order = Window.partitionBy(key, alone).orderBy("scan_ord", F.col("path").startswith("jar:"), "path")
        return df.withColumn("_at", F.row_number().over(order)).where(F.col(key).isNull() | (F.col("_at") == 1)).drop("_at")

    @cached_property
    def modules(self) -> DataFrame:
        return self._first(self.table("modules"), "name")

    @cached_property
    def module_deps(self) -> DataFrame:
        return self.table("module_deps").join(self.modules.select("dir", "module_id"), ["dir", "module_id"], "left_semi").drop("dir")

    @cached_property
    def models(self) -> DataFrame:
        """Models whose id is null all stay; models of a dropped module go with it."""
        held = self.table("models").join(self.modules.select("dir", "module_id"), "dir")
        return self._first(held, "model_id").drop("dir")

    def _of_models(self, name: str) -> DataFrame:
        return self.table(name).join(self.models.select("source"), "source", "left_semi")

    @cached_property
    def model_imports(self) -> DataFrame:
        return self._of_models("model_imports")

    @cached_property
    def model_languages(self) -> DataFrame:
        return self._of_models("model_languages")

    @cached_property
    def nodes(self) -> DataFrame:
        """pre and last number the nodes of one file; a root with all below it lies in one file."""
        return self._of_models("nodes")

    @cached_property
    def node_refs(self) -> DataFrame:
        return self._of_models("node_refs")

    @cached_property
    def registry(self) -> DataFrame:
        return self._of_models("registry")

    @cached_property
    def errors(self) -> DataFrame:
        return self.table("errors")

    @cached_property
    def languages(self) -> DataFrame:
        """Languages that any model's registry names, with the version of their own module where that was found."""
        used = self.registry.groupBy(F.coalesce("language_id", "language_name").alias("language_id")).agg(F.min("language_name").alias("name"))
        own = self.modules.where("kind = 'language'").select(F.col("module_id").alias("language_id"), "version", F.col("path").alias("module_path"))
        return used.join(own, "language_id", "left")

    @cached_property
    def concepts(self) -> DataFrame:
        return self.registry.groupBy(F.coalesce("language_id", "language_name").alias("language_id"), F.coalesce("concept_id", "concept_name").alias("concept_id")).agg(F.min("concept_name").alias("name"))

    @cached_property
    def concept_members(self) -> DataFrame:
        known = self.registry.where("kind is not null")
        return known.groupBy(F.coalesce("concept_id", "concept_name").alias("concept_id"), "kind", F.coalesce("member_id", "member_name").alias("member_id")).agg(F.min("member_name").alias("name"))

    @cached_property
    def aspect_models(self) -> DataFrame:
        """Models that belong to a language's own module, by name."""
        return self.models.join(self.modules.where("kind = 'language'").select("module_id", F.col("name").alias("language")), "module_id")

    # --- questions ---

    def model_edges(self) -> DataFrame:
        """Imports between models that were found."""
        known = self.models.select("model_id")
        edges = self.model_imports.select("model_id", "imported_model_id").distinct()
        return edges.join(known, "model_id", "left_semi").join(known.withColumnRenamed("model_id", "imported_model_id"), "imported_model_id", "left_semi").select("model_id", "imported_model_id")

    def module_edges(self) -> DataFrame:
        known = self.modules.select("module_id")
        edges = self.module_deps.select("module_id", "dep_module_id").distinct()
        return edges.join(known, "module_id", "left_semi").join(known.withColumnRenamed("module_id", "dep_module_id"), "dep_module_id", "left_semi").select("module_id", "dep_module_id")

    def module_reach(self) -> DataFrame:
        """All (x, y): module x needs module y, directly or not."""
        return graph.closure(self.module_edges(), "module_id", "dep_module_id")

    def model_reach(self) -> DataFrame:
        return graph.closure(self.model_edges(), "model_id", "imported_model_id")

    def loaded_imports(self) -> DataFrame:
        """Each import with the model it means; a model that was never found is a row with loaded false."""
        target = self.models.select(F.col("model_id").alias("imported_model_id"), F.col("name").alias("found"))
        out = self.model_imports.join(target, "imported_model_id", "left")
        return out.select("model_id", "imported_model_id", F.coalesce("found", "imported_name").alias("imported_name"), F.col("found").isNotNull().alias("loaded"))

    def listed(self) -> DataFrame:
        """path of every descriptor and model file below the repository's directories, whether it is read or not; tasks list."""
        found = found_files(self.spark, self.paths, graph.Rounds(self.spark, "listing"))
        return found.where(F.col("wrong").isNull() & F.col("path").rlike(r"\.(msd|mps|model)$")).select("path")

    def modified(self, changed: DataFrame, top: str) -> DataFrame:
        """path, kind, id of the modules and models that changed paths (relative to the directory ``top``) touch; id is null for a missing one."""
        top = (top if "://" in top else os.path.abspath(top)).rstrip("/")
        inner = lambda df: df.where(F.col("path").startswith(top + "/")).withColumn("path", F.substring("path", len(top) + 2, 1 << 20))
        return graph.modified_entities(changed, inner(self.listed()), inner(self.modules.select("module_id", "path")), inner(self.models.select("model_id", "path")))

    def cone_of_influence(self, changed: DataFrame, top: str) -> tuple[DataFrame, DataFrame | None]:
        """Affected modules and models of changed paths; see graph.cone_of_influence."""
        return graph.cone_of_influence(self.modules, self.models, self.module_edges(), self.model_edges(), self.modified(changed, top))

    def resolved(self) -> DataFrame:
        """References with their targets; target is null for an unknown model or node.  A reference keeps one row."""
        targets = self.nodes.select(F.col("model_id").alias("target_model_id"), F.col("node_id").alias("target_node_id"), F.struct("concept", "props", "root_id", "path").alias("target"))
        once = targets.groupBy("target_model_id", "target_node_id").agg(F.first("target").alias("target"))
        return self.node_refs.join(once, ["target_model_id", "target_node_id"], "left")

    def descendants(self, of: DataFrame) -> DataFrame:
        """Nodes below the given ones, which are rows of ``nodes``."""
        a = of.select("source", "path", F.col("node_id").alias("ancestor_id"), F.col("pre").alias("low"), F.col("last").alias("high"))
        return tree.within(self.nodes, a, ["source", "path"]).drop("low", "high")


def union(repositories: list[Repository], name: str) -> DataFrame:
    """One table of several repositories."""
    return reduce(DataFrame.unionByName, [getattr(r, name) for r in repositories])
