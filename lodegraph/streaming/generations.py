"""Generation deltas as streams: membership kept in state, gaps found in arrival order, arrivals checked and landed.

Sources are folders of Parquet or pack files; results go to Parquet in the shared folder. Nothing depends on arrival
order: the last action on a member is the one of the highest generation, and late records only add facts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fixpoint import checkpoint_dir
from ..sources import objects


def source(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def run(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Works off what is there and returns the rows: all appended ones, or the last complete result.

    A micro-batch of appended rows writes a folder of its own named by its number, so a repeated batch replaces itself;
    a complete result replaces the one before, an empty one too.
    """
    spark = stream.sparkSession
    at = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{at}/rows/batch=-1")  # so that there is a result without any input

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={-1 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(land).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(f"{at}/rows").drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def membership(records: DataFrame) -> DataFrame:
    """Stream of members after all records(domain, idx, cid, gone) so far; removals of a generation follow its additions."""
    act = F.max(F.struct("idx", F.col("gone").cast("int").alias("gone"))).alias("last")
    return records.groupBy("domain", "cid").agg(act).filter("last.gone = 0").select("domain", "cid")


def sequence_gaps(records: DataFrame) -> DataFrame:
    """Stream of records(domain, idx) with the index expected and whether it is a gap; state: each domain's next index."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        indices = sorted({int(i) for f in frames for i in f["idx"]})
        expected = state.get[0] if state.exists else indices[0]
        rows = []
        for i in indices:
            rows.append((key[0], i, expected, i != expected))
            expected = max(expected, i + 1)
        state.update((expected,))
        yield pd.DataFrame(rows, columns=["domain", "idx", "expected", "gap"])

    return records.groupBy("domain").applyInPandasWithState(step, "domain bigint, idx bigint, expected bigint, gap boolean", "expected bigint", "append", GroupStateTimeout.NoTimeout)


def arrivals(files: DataFrame) -> DataFrame:
    """Stream of parsed objects from a stream of binary files; faulty ones carry their fault."""
    return objects.parsed(files.select("path", "content"))


def late_counts(events: DataFrame, time: str = "ts", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Stream of counts per window; what comes later than delay is dropped from state."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
