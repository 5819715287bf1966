"""Global row numbers without a single task: a range sort, counts per partition, and their running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import held


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df plus its place, from 1, in the order given; equal rows get their places in any order."""
    rows = held(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()))
    counts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = counts.select("part_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_"))
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return rows.withColumn("own_", own).join(base, "part_").withColumn(name, (F.col("base_") + F.col("own_")).cast("bigint")).drop("part_", "own_", "base_")
