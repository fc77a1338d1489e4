"""Shared plumbing of the training-data operators: scratch tables in the cluster's shared folder, files beside them, null-safe inputs.

Nothing here depends on a driver-local folder.  The shared folder is the one named in ``spark.checkpoint.dir``; only where that is
unset (tests, notebooks) a private one is made and kept for the session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

if TYPE_CHECKING:  # workers that use Arrow alone do without it
    import pandas as pd

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sylvan-scratch-")
    return _own[app]


#: Bytes of an Arrow batch that goes to Python.  Spark's own limit, 64 MB, is held several times over by each side of each task.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for Arrow batches to ``BATCH_BYTES``, if it is higher."""
    set_to = spark.conf.get(_LIMIT, "2147483647b").lower().removesuffix("b")
    if not (set_to.isdigit() and 0 < int(set_to) <= BATCH_BYTES):
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


class Scratch:
    """Named tables and files of one run of one operator, in a folder of their own below the shared folder.

    A table is written once and read back, which cuts lineage: a lost executor costs at most the tasks of the current step.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def documents(df: DataFrame) -> DataFrame:
    """Only doc_id (long) and text, null read as empty; all other columns, whatever their names, are left behind."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As mapInPandas, but a null beside whole numbers leaves them whole (objects, with None), where pandas alone would round them."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in run(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield pa.RecordBatch.from_pandas(pdf, target, preserve_index=False)

    return df.mapInArrow(arrow, schema)


#: Bytes of the texts that a task works on at once, unless one alone has more: what it holds beside its batch grows with these alone.
PART = 1 << 20


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that share the batches' memory: ``most`` bytes of the column in each, unless one row alone has more."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def replaced(batch: pa.RecordBatch, **columns: list) -> pa.RecordBatch:
    """The batch with other values in some of its columns; all else stays as it is, of whatever type."""
    own = [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(i) for i, f in enumerate(batch.schema)]
    return pa.RecordBatch.from_arrays(own, schema=batch.schema)


#: Rows of one long up to which a side of a join is broadcast, some 50 MB; beyond, both sides are shuffled and merged.
BROADCAST_IDS = 2_000_000


def by_ids(df: DataFrame, ids: DataFrame, on: F.Column, how: str) -> DataFrame:
    """df joined (left_semi or left_anti) with a written table of ids.  Few ids are broadcast, so that no text is shuffled for them."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """At a task's end: what its caches held goes back to the system, as the worker may stay for other work."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


# --- files in the shared folder, from executors; any store that Arrow's file systems reach ---------------------------------------


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write the chunks to a new file; returns its size.  Names carry a random part, so attempts of one task never meet."""
    fs, path = _fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    n = 0
    with fs.open_output_stream(path, compression=None) as out:  # a name that ends in .gz is no wish
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    return n


class RangeReader:
    """Range reads of one file."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self._file = fs.open_input_file(path)

    def size(self) -> int:
        return self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(length)

    def close(self) -> None:
        self._file.close()
