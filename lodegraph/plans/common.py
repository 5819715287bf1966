"""What the query modules share: reading a table, and the graphs derived from the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): part p rests on parts p div 2 and p div 3."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src")).filter("src > 0")
    return p.select("src", F.explode(F.array(F.expr("src div 2"), F.expr("src div 3"))).alias("dst")).distinct()


PART_EDGES_SQL = "part_edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0)"


def turn_edges(spark: SparkSession, sf_dir: str, same_role: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, supersedes): turn t of a conversation supersedes turn (t - 1) div 2; with same_role, only one of its role."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("node"), "conv_id", "turn", "role")
    up = c.filter("turn > 0").withColumn("dst", F.expr("conv_id * 100 + (turn - 1) div 2"))
    met = up.join(c.select(F.col("node").alias("dst"), F.col("role").alias("role_of")), "dst")
    kept = met.filter("role = role_of") if same_role else met
    return c.select("node"), kept.select(F.col("node").alias("src"), "dst")


def turn_edges_sql(same_role: bool = False) -> str:
    extra = " AND a.role = b.role" if same_role else ""
    return (
        "nodes AS (SELECT conv_id * 100 + turn AS node, conv_id, turn, role FROM conversations), "
        f"sup AS (SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.turn > 0 AND b.conv_id = a.conv_id AND b.turn = (a.turn - 1) // 2{extra})"
    )
