"""Merkle trees over sorted members: roots, proofs of inclusion and consistency, and diffs; hashes as lower-case hex.

Levels are built by pairing positions; an odd last node moves up unchanged, which gives the tree that splits at the
largest power of two below its size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import held


def leaf_hash(value: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), value.cast("binary")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


#: The root over no leaves.
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def ordered(members: DataFrame, by: list[str] | None = None, member: str = "member") -> DataFrame:
    """(tree..., pos, leaf): distinct members in order, numbered from 0 in each tree.

    Positions come from a range sort with counts per partition, so no tree has to fit one task.
    """
    by = by or []
    rows = held(members.select(*by, F.col(member).cast("string").alias("member")).distinct().repartitionByRange(*by, "member").sortWithinPartitions(*by, "member").withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(*by, "part").orderBy("member"))
    return rows.withColumn("own", own).join(base, [*by, "part"]).select(*by, (F.col("base") + F.col("own") - 1).alias("pos"), "member", leaf_hash(F.col("member")).alias("leaf"))


def levels(leaves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(tree..., level, pos, hash) from leaves(tree..., pos, leaf); level 0 holds the leaves."""
    by = by or []
    now = held(leaves.select(*by, F.lit(0).alias("level"), F.col("pos").cast("bigint").alias("pos"), F.col("leaf").alias("hash")))
    every = now
    level = 0
    while not now.filter("pos > 0").isEmpty():
        level += 1
        up = F.expr("pos div 2")
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("hash")))
        pairs = now.groupBy(*by, up.alias("pos")).agg(side(0).alias("l"), side(1).alias("r"))
        now = held(pairs.select(*by, F.lit(level).alias("level"), "pos", F.when(F.col("r").isNull(), F.col("l")).otherwise(node_hash(F.col("l"), F.col("r"))).alias("hash")))
        every = every.union(now)
    return every


def tops(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(tree..., root, size) from levels."""
    by = by or []
    return found.groupBy(*by).agg(F.max_by("hash", "level").alias("root"), F.count_if(F.col("level") == 0).alias("size")).withColumn("root", F.coalesce("root", F.lit(EMPTY_ROOT)))


def inclusion(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(tree..., pos, path): for each leaf, its siblings from the leaf up, where there are any."""
    by = by or []
    top = held(found)
    height = top.agg(F.max("level")).first()[0] or 0
    leaf = top.filter("level = 0").select(*by, "pos")
    steps = leaf.select(*by, "pos", F.explode(F.sequence(F.lit(0), F.lit(max(0, height - 1)))).alias("level")).withColumn("at", F.expr("shiftright(pos, level) ^ 1"))
    met = steps.join(top.select(*by, "level", F.col("pos").alias("at"), "hash"), [*by, "level", "at"])
    paths = met.groupBy(*by, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "hash"))), lambda x: x["hash"]).alias("path"))
    return leaf.join(paths, [*by, "pos"], "left").select(*by, "pos", F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def verify_inclusion(leaf: Column, index: Column, size: Column, path: Column, root: Column) -> Column:
    """Folds a path: at each level a node is a right child, a left one with a sibling, or moves up alone."""
    start = F.struct(leaf.alias("h"), index.cast("bigint").alias("i"), (size.cast("bigint") - 1).alias("last"), F.lit(True).alias("ok"))

    def lifted(a: Column) -> Column:
        """a moved up past the levels where its node is the odd last one and has no sibling."""
        alone = lambda x: (x["i"] == x["last"]) & (x["i"] % 2 == 0) & (x["last"] > 0)
        up = lambda x: F.struct(F.shiftright(x["i"], 1).alias("i"), F.shiftright(x["last"], 1).alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a["i"].alias("i"), a["last"].alias("last")), lambda x, _: F.when(alone(x), up(x)).otherwise(x))

    def step(a: Column, sibling: Column) -> Column:
        at = lifted(a)
        h = F.when(at["i"] % 2 == 1, node_hash(sibling, a["h"])).otherwise(node_hash(a["h"], sibling))
        return F.struct(h.alias("h"), F.shiftright(at["i"], 1).alias("i"), F.shiftright(at["last"], 1).alias("last"), (a["ok"] & (at["last"] > 0)).alias("ok"))

    done = F.aggregate(path, start, step)
    return (index >= 0) & (index < size) & done["ok"] & (done["h"] == root) & (lifted(done)["last"] == 0)


def neighbours(members: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(member) plus present, before, after: the members on either side.

    Members and questions are range-sorted together; what a partition lacks at its edges comes from the nearest
    partition that has a member, so no task sees them all.
    """
    both = members.select("member", F.lit(True).alias("real")).distinct().union(asked.select("member", F.lit(False).alias("real")).distinct())
    line = both.groupBy("member").agg(F.max("real").alias("present"), F.max(~F.col("real")).alias("asked"))
    line = held(line.repartitionByRange("member").sortWithinPartitions("member").withColumn("part", F.spark_partition_id()))
    real = F.when(F.col("present"), F.col("member"))
    edges = line.groupBy("part").agg(F.min(real).alias("lo"), F.max(real).alias("hi"))  # a row per partition
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  a frame from here on would be gone through again for every row
    edges = edges.select("part", F.last("hi", True).over(up_to(Window.orderBy("part"))).alias("hi_before"), F.last("lo", True).over(up_to(Window.orderBy(F.desc("part")))).alias("lo_after"))
    within = Window.partitionBy("part")
    near = line.select("part", "member", "present", "asked", F.last(real, True).over(up_to(within.orderBy("member"))).alias("b"), F.last(real, True).over(up_to(within.orderBy(F.desc("member")))).alias("a")).filter("asked")
    return near.join(edges, "part").select("member", "present", F.coalesce("b", "hi_before").alias("before"), F.coalesce("a", "lo_after").alias("after"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(member, change): added or removed between two sets of member."""
    a, b = old.select("member").distinct(), new.select("member").distinct()
    return b.join(a, "member", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "member", "left_anti").withColumn("change", F.lit("removed")))


# Proofs that one log is a prefix of another are about single logs: plain functions over hashes.


def _root_of(hashes: list[bytes]) -> bytes:
    if not hashes:
        return hashlib.sha256(b"").digest()
    while len(hashes) > 1:
        paired = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(hashes[::2], hashes[1::2])]
        hashes = paired + hashes[len(hashes) - len(hashes) % 2 :]
    return hashes[0]


def consistency_proof(leaves: list[bytes], size: int) -> list[bytes]:
    """Hashes that show the first `size` leaves to be a prefix of all."""
    if not 0 < size < len(leaves):
        return []
    proof: list[bytes] = []
    low, high, whole = 0, len(leaves), True
    while low + size < high or not whole:
        n = high - low
        if size == n:
            proof.append(_root_of(leaves[low:high]))
            break
        half = 1 << (n - 1).bit_length() - 1
        if size <= half:
            proof.append(_root_of(leaves[low + half : high]))
            high = low + half
        else:
            proof.append(_root_of(leaves[low : low + half]))
            low, size, whole = low + half, size - half, False
    return proof[::-1]


def verify_consistency(old_size: int, new_size: int, old_root: bytes, new_root: bytes, proof: list[bytes]) -> bool:
    """Whether a proof joins the roots of a log at two sizes."""
    if not 0 <= old_size <= new_size:
        return False
    if old_size == new_size:
        return not proof and old_root == new_root
    if old_size == 0:
        return not proof
    node, last = old_size - 1, new_size - 1
    while node & 1:
        node, last = node >> 1, last >> 1
    rest = list(proof)
    if node:
        if not rest:
            return False
        old = new = rest.pop(0)
    else:
        old = new = old_root
    for h in rest:
        if not last:
            return False
        if node & 1 or node == last:
            old = hashlib.sha256(b"\x01" + h + old).digest()
            new = hashlib.sha256(b"\x01" + h + new).digest()
            while node and not node & 1:
                node, last = node >> 1, last >> 1
        else:
            new = hashlib.sha256(b"\x01" + new + h).digest()
        node, last = node >> 1, last >> 1
    return last == 0 and old == old_root and new == new_root
