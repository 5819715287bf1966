"""The streaming operators, run over the events that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixpoint import checkpoint_dir
from ..streaming import generations
from . import sets
from .common import table


def _events(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events as files dropped in a landing folder, and a stream of them."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    events.repartitionByRange(4, "event_id").write.parquet(folder)
    return generations.source(spark, folder, events.schema, files_per_batch)


def stream_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, 1)  # any order of files gives the same members
    records = e.select(F.expr("user_id % 5").alias("domain"), F.expr("event_id div 1000").alias("idx"), F.col("user_id").cast("string").alias("cid"), (F.col("event_type") == "error").alias("gone"))
    return generations.run(generations.membership(records), "complete")


def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("value > 3")
    return generations.run(generations.sequence_gaps(e.select(F.expr("user_id % 10").alias("domain"), F.expr("event_id div 5").alias("idx"))))


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generations.run(generations.late_counts(_events(spark, sf_dir)), "complete")
    return found.select(F.to_date("start").cast("string").alias("day"), "n")


QUERIES = {f.__name__: f for f in (stream_membership, stream_gaps, stream_daily_counts)}
SQL = {
    "stream_membership": f"WITH {sets._GEN}, last AS (SELECT domain, cid, max(idx * 2 + CAST(gone AS INT)) % 2 AS gone FROM g GROUP BY 1, 2) SELECT domain, cid FROM last WHERE gone = 0",
    "stream_gaps": sets.SQL["generation_gaps"],
    "stream_daily_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1",
}
