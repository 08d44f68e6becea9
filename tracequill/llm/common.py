"""What the operators share: tables, the shared folder, written intermediate tables, shipping code."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tracequill.sources.stored import new_folder, shared_dir, written  # noqa: F401

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing will read again."""
    path = getattr(df, "_written_to", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_key(doc_id: Column, mark: Column) -> Column:
    """An id, which may be null, with a hash of its row's text: never null, so that joins and windows share a shuffle."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), mark.cast("string"))


def rows_of(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of docs with a kept key, all their columns. kept: _key (no key twice) and _once, whether one row of a key stays or all."""
    rows = docs.withColumn("_key", key).join(kept, "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return rows.withColumn("_nth", nth).where("_nth = 1 OR NOT _once").drop("_key", "_once", "_nth")


def positions(df: DataFrame, order: list[Column], group: str | None = None, name: str = "positions") -> DataFrame:
    """df, written, with _pos: each row's place from 0 in the given order, within its group where a column of groups (strings without nulls) is named.

    Rows are range-partitioned by group and order, so a large group spreads over partitions, and so do rows that the order leaves equal, by the partition that
    they came from. Each partition numbers its own rows. A group goes on from one partition to the next at most once a partition: these few offsets are broadcast.
    """
    ship(df.sparkSession)
    keys = [F.col("_group"), *order, F.col("_tie")]
    df = written(df, f"{name}-rows")  # sampling the ranges would compute it twice
    rows = df.withColumns({"_group": F.col(group) if group else F.lit(""), "_tie": F.spark_partition_id()})
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            g = b.column(b.num_columns - 1)
            new = np.ones(size, bool)
            new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
            new[0] = g[0].as_py() != last
            at = np.arange(size)
            begins = np.maximum.accumulate(np.where(new, at, -n))  # rows of a group that began in an earlier batch count on from n
            local = at - begins
            last, n = g[size - 1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(size, part, np.int32)), pa.array(local)], [*b.schema.names, "_part", "_local"])

    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_local", LongType())])
    rows = written(rows.mapInArrow(run, schema), name)
    so_far = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    went_on = runs.select("_group", "_part", F.sum("_n").over(so_far).alias("_before")).where("_before > 0")
    placed = rows.join(F.broadcast(went_on), ["_group", "_part"], "left")
    return placed.withColumn("_pos", F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_group", "_part", "_local", "_before")


def release() -> None:
    """Gives memory that this worker no longer uses back to the system: workers live on after their tasks, beside those of later stages."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # modules and the like, which later collections need not walk through again
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A task's function over batches that releases its worker's memory: what tasks before it left, and its own."""

    def task(batches):
        release()
        yield from run(batches)
        release()

    return task


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="tracequill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tracequill_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join(os.path.basename(PACKAGE), os.path.relpath(full, PACKAGE)))
    spark.sparkContext.addPyFile(path)


def open_fs(uri: str):
    """A pyarrow file system and the path in it, for files that tasks write and read themselves."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
