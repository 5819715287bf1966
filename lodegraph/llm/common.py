"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]+"
#: Text handled at once inside a Python worker; only memory depends on it.
SLICE_BYTES = 8 << 20


#: Whether Spark deletes an execution's shuffle files when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where none is set, a local one under a local master alone."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodegraph-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


@contextmanager
def shuffle_files_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, executions delete their shuffle files when they end."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path that Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, at = _hadoop(spark, path)
    system.deleteOnExit(at)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path that nothing reads any more."""
    system, at = _hadoop(spark, path)
    system.delete(at, True)


class Saved(NamedTuple):
    """Rows written to the shared folder: later steps survive lost executors and see the same rows."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        deleted(self.rows.sparkSession, self.path)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> Saved:
    """df as a Parquet table in the shared folder; shuffle files of its making go at once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffle_files_deleted(spark):
        df.write.option("compression", compression).parquet(path)
    return Saved(spark.read.schema(df.schema).parquet(path), path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with table on keys (not null), of which table holds each once, with the number of its rows in `count`.

    Keys of more than a quarter of a task's share of the rows, at most four a task, meet their rows by a broadcast of
    that bounded table, so a hot key isn't dealt to one task; the others by whatever join Spark chooses. Whether there are
    such keys is asked first, of the written table: without them the join names it once, not three times.
    """
    most = 4 * partitions(rows.sparkSession)
    total, largest = table.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    share = total / most
    if largest <= share:
        return rows.join(table, keys)
    hot, cold = table.filter(F.col(count) > share), table.filter(F.col(count) <= share)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes of text; a longer row stands alone."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """The words of a run of texts as codes into their distinct words.

    codes: int64 code of each word in order; offsets: where each text's words begin (one more entry than texts);
    distinct: the distinct words as Arrow text; vocab: as bytes. Built by Arrow kernels, so no Python object per word.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        keep = pc.greater(pc.binary_length(flat), 0)
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if not pc.all(keep).as_py() if len(flat) else False:
            before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))]).astype(np.int64)
            offsets, flat = before[offsets], flat.filter(keep)
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = offsets
        self.distinct = coded.dictionary

    @cached_property
    def vocab(self) -> list[bytes]:
        return self.distinct.cast(pa.large_binary()).to_pylist()

    def __len__(self) -> int:
        return len(self.offsets) - 1


def schema_without(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in names])
