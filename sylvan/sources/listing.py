"""Which files of a repository's directories count, and as what: by the driver for a scan, or by tasks for a snapshot.

Both give the same items.  Where tasks list, directories are rows: a task lists some at once, and what it leaves is dealt anew, so the rounds
follow the number of directories, and nothing for a file or a directory comes to the driver.
"""

from __future__ import annotations

import os
import posixpath
import zipfile
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import BROADCAST_IDS, Rounds

#: The endings of the files.
SOLUTION, LANGUAGE, SINGLE, BINARY, HEADER, ROOT, ARCHIVE = ".msd", ".mpl", ".mps", ".mpb", ".model", ".mpsr", ".jar"
MODELS = (SINGLE, BINARY, HEADER, ROOT)
DESCRIPTORS = (SOLUTION, LANGUAGE)
#: Directories that a task lists for each one that it is given; those found beyond are dealt anew.
LISTED_AT_ONCE = 256
#: Directories in a partition of a round.
DIRECTORIES = 64
FOUND = "nth long, top string, path string, size long, modified long, folder boolean, wrong string"
ITEM = "kind string, path string, size long, scan_ord long, dir string, source string, lead boolean, fingerprint string"


class Listed(NamedTuple):
    path: str
    size: int
    modified: int


class Item(NamedTuple):
    """A file to read; of an archive, the entries from ``first`` up to ``last`` of those that count, or all of them."""

    kind: str
    path: str
    size: int
    scan_ord: int
    dir: str | None = None
    source: str | None = None
    lead: bool = True
    fingerprint: str = ""
    first: int | None = None
    last: int | None = None


def classify(files: list[Listed], nth: int = 0) -> list[Item]:
    """What each listed file of the nth path is, in the order of paths.  Models count below ``models/`` of the nearest directory above that has a descriptor."""
    homes = {posixpath.dirname(f.path) for f in files if f.path.endswith(DESCRIPTORS)}
    headers = {posixpath.dirname(f.path) for f in files if posixpath.basename(f.path) == HEADER}
    led, out = set(), []
    for f in sorted(files):
        folder, kind = posixpath.dirname(f.path), posixpath.splitext("x" + posixpath.basename(f.path))[1]
        home = source = None
        lead = True
        if kind in MODELS:
            home = folder
            while home and home not in homes and home != posixpath.dirname(home):
                home = posixpath.dirname(home)
            inner = f.path[len(home) :].lstrip("/")
            if home not in homes or not inner.startswith("models/"):
                continue
            source = folder if kind in (HEADER, ROOT) else f.path
            if kind == ROOT:  # the header speaks for a directory, or else its first root
                lead = folder not in headers and folder not in led
                led.add(folder)
        elif kind in DESCRIPTORS:
            home = folder
        elif kind != ARCHIVE:
            continue
        out.append(Item(kind, f.path, f.size, nth, home, source, lead, f"{f.modified}:{f.size}:{nth}:{home or ''}:{source or ''}:{lead}"))
    return out


def opened(path: str) -> tuple[object, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def listing(path: str) -> tuple[list[Listed], str | None]:
    """The files below a path, or what is wrong with the path."""
    filesystem, root = opened(path)
    if wrong := _wrong(filesystem, root):
        return [], wrong
    found = filesystem.get_file_info(arrow_fs.FileSelector(root, recursive=True))
    return [Listed(x.path, x.size, x.mtime_ns or 0) for x in found if x.type == arrow_fs.FileType.File], None


def _wrong(filesystem, root: str) -> str | None:
    kind = filesystem.get_file_info(root).type
    return None if kind == arrow_fs.FileType.Directory else "no such directory" if kind == arrow_fs.FileType.NotFound else "not a directory"


# --- archives ---


def entries(f, jar: Item) -> tuple[zipfile.ZipFile, list[Item]]:
    """An archive and those of its entries that count; none if it has no descriptor.  Only its directory is read."""
    z = zipfile.ZipFile(f)
    inside = [Listed(x.filename, x.file_size, 0) for x in z.infolist() if not x.is_dir()]
    if not any(e.path.endswith(DESCRIPTORS) for e in inside):
        return z, []
    return z, [i for i in classify(inside, jar.scan_ord) if i.kind != ARCHIVE]


def divided(top: str, jar: Item, size: int) -> list[Item]:
    """An archive as runs of its entries of some ``size`` bytes unpacked.  One run of nothing if no entry counts; the archive as it is if it can't be read."""
    try:
        with opened(top)[0].open_input_file(jar.path) as f:
            z, inside = entries(f, jar)
            z.close()
    except (OSError, ValueError, zipfile.BadZipFile):  # its reading tells
        return [jar]
    runs, begin, load = [], 0, 0
    for k, e in enumerate(inside):
        if k > begin and load + e.size > size:
            runs.append(jar._replace(first=begin, last=k, size=load))
            begin, load = k, 0
        load += e.size
    return [*runs, jar._replace(first=begin, last=len(inside), size=load)]


# --- listing by tasks ---


def _list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files below the given directories, and directories not listed yet."""
    kinds = [("nth", pa.int64()), ("top", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("folder", pa.bool_()), ("wrong", pa.string())]
    schema = pa.schema(kinds)
    for batch in batches:
        todo = deque((r["nth"], r["top"], r["path"]) for r in batch.to_pylist())
        budget = LISTED_AT_ONCE * len(todo)
        while todo and budget:
            nth, top, folder = todo.popleft()
            budget -= 1
            filesystem = opened(top)[0]
            try:
                found = filesystem.get_file_info(arrow_fs.FileSelector(folder))
            except OSError as e:
                yield pa.RecordBatch.from_pylist([{"nth": nth, "top": top, "path": folder, "folder": False, "wrong": str(e)}], schema)
                continue
            todo += [(nth, top, x.path) for x in found if x.type == arrow_fs.FileType.Directory]
            files = [{"nth": nth, "top": top, "path": x.path, "size": x.size, "modified": x.mtime_ns or 0, "folder": False} for x in found if x.type == arrow_fs.FileType.File]
            yield pa.RecordBatch.from_pylist(files, schema)
        yield pa.RecordBatch.from_pylist([{"nth": nth, "top": top, "path": folder, "folder": True} for nth, top, folder in todo], schema)


def found_files(spark: SparkSession, paths: tuple[str, ...], rounds: Rounds) -> DataFrame:
    """nth, top, path, size, modified, wrong of all files below the paths; a path or a directory that can't be listed is a row with what is wrong."""
    given = []
    for nth, top in enumerate(paths):
        filesystem, root = opened(top)
        wrong = _wrong(filesystem, root)
        given.append((nth, top, top if wrong else root, None, None, wrong is None, wrong))
    first = rounds.keep(spark.createDataFrame(given, FOUND), hits="folder")
    tables, last = [first], first
    while last.hits:
        ahead = last.where("folder").repartition(1 + last.hits // DIRECTORIES, "nth", "path")
        last = rounds.keep(ahead.select("nth", "top", "path").mapInArrow(_list_rows, FOUND), hits="folder")
        tables.append(last)
    return spark.read.schema(FOUND).parquet(*[t.kept_at for t in tables]).where("not folder").drop("folder")


def _small(df: DataFrame) -> DataFrame:
    """A kept table of folders, broadcast behind its count; beyond, the join shuffles and adaptive execution splits folders of very many files."""
    return F.broadcast(df) if df.rows <= BROADCAST_IDS else df


def items(found: DataFrame, rounds: Rounds) -> DataFrame:
    """top and ITEM's columns of the files that count, as ``classify`` has them, by joins on folders.

    Models meet their module through the distinct folders above them; only these are exploded, never the files.
    """
    name = F.substring_index("path", "/", -1)
    above = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    files = found.where("wrong is null").withColumn("name", name).withColumn("kind", F.regexp_extract("name", r"(\.[^.]*)$", 1))
    files = files.where(F.col("kind").isin(*MODELS, *DESCRIPTORS, ARCHIVE)).withColumn("folder", F.when((above == "") & F.col("path").startswith("/"), "/").otherwise(above))
    models, roots = files.where(F.col("kind").isin(*MODELS)), F.col("kind") == ROOT
    homes = rounds.keep(files.where(F.col("kind").isin(*DESCRIPTORS)).select("nth", F.col("folder").alias("home")).distinct())
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ups = models.select("nth", "folder").distinct().select("nth", "folder", F.explode(ups).alias("up")).withColumn("home", F.when((F.col("up") == "") & F.col("folder").startswith("/"), "/").otherwise(F.col("up")))
    nearest = rounds.keep(ups.join(_small(homes), ["nth", "home"]).groupBy("nth", "folder").agg(F.max_by("home", F.length("home")).alias("home")))
    leads = models.where(roots | (F.col("name") == HEADER)).groupBy("nth", "folder").agg(F.min(F.when(roots, F.col("path"))).alias("path"), F.bool_or(F.col("name") == HEADER).alias("headed"))
    leads = rounds.keep(leads.where("not headed and path is not null").select("nth", "path", F.lit(True).alias("leads")))
    held = files.join(_small(nearest), ["nth", "folder"], "left").join(_small(leads), ["nth", "path"], "left")
    model = F.col("kind").isin(*MODELS)
    below = F.col("path").startswith(F.concat(F.when(F.col("home") == "/", "").otherwise(F.col("home")), F.when(F.col("home") == "", "").otherwise("/"), F.lit("models/")))
    held = held.where(~model | F.coalesce(below, F.lit(False)))
    held = held.withColumn("dir", F.when(model, F.col("home")).when(F.col("kind") != ARCHIVE, F.col("folder")))
    held = held.withColumn("source", F.when(F.col("kind").isin(HEADER, ROOT), F.col("folder")).when(model, F.col("path")))
    held = held.withColumn("lead", F.when(roots, F.coalesce("leads", F.lit(False))).otherwise(True))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    print_ = F.concat_ws(":", "modified", "size", "nth", text("dir"), text("source"), F.when(F.col("lead"), "True").otherwise("False"))
    return held.select("top", "kind", "path", "size", F.col("nth").alias("scan_ord"), "dir", "source", "lead", print_.alias("fingerprint"))
