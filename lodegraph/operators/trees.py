"""Content trees: a branch hashes its header and its named children, a leaf its content; built up by depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import held
from .merkle import leaf_hash

#: Fixed value: what a branch's bytes begin with.
BRANCH = "02"


def size8(value: Column) -> Column:
    """The length of bytes as eight bytes, the lowest first, in hex."""
    digits = F.lpad(F.hex(F.octet_length(value).cast("bigint")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])


def hashes(nodes: DataFrame) -> DataFrame:
    """(path, hash) from nodes(path, parent, name, content, header): content is null for branches, parent for the root.

    Children enter in the order of their names' bytes.
    """
    base = held(nodes.select("path", "parent", "name", "content", F.coalesce("header", F.lit("").cast("binary")).alias("header"), F.size(F.split("path", "/")).alias("depth")))
    deepest = base.agg(F.max("depth")).first()[0] or 0
    done = None
    for depth in range(deepest, -1, -1):
        level = base.filter(F.col("depth") == depth)
        leaves = level.filter("content IS NOT NULL").select("path", "parent", "name", leaf_hash(F.col("content")).alias("hash"))
        branches = level.filter("content IS NULL")
        if done is not None:
            part = F.concat(size8(F.col("name").cast("binary")), F.hex(F.col("name").cast("binary")), F.upper("hash"))
            entries = done.select(F.col("parent").alias("path"), F.struct(F.col("name").cast("binary").alias("key"), part.alias("part")).alias("e")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["part"]), "").alias("parts"))
            branches = branches.join(entries, "path", "left")
        else:
            branches = branches.withColumn("parts", F.lit(""))
        bytes_ = F.unhex(F.concat(F.lit(BRANCH), size8(F.col("header")), F.hex("header"), F.coalesce("parts", F.lit(""))))
        now = leaves.union(branches.select("path", "parent", "name", leaf_hash(bytes_).alias("hash")))
        done = held(now if done is None else done.union(now))
    return done.select("path", "hash") if done is not None else base.select("path", F.lit("").alias("hash"))


def leaves(nodes: DataFrame) -> DataFrame:
    """(path, hash) of the leaves, by path."""
    return nodes.filter("content IS NOT NULL").select("path", leaf_hash(F.col("content")).alias("hash")).orderBy("path")


def find(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path") == path)
