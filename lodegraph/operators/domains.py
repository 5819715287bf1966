"""Domains: generations that add and remove members, their checks, checkpoints, witnesses and garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merkle
from .fixpoint import components, reached

#: Why a member may be removed.
CAUSES = ("split", "tombstone", "superseded-domain")


def applied(start: DataFrame, added: DataFrame, removed: DataFrame, upto: int | None = None) -> DataFrame:
    """Members after folding generations in order: within one, additions come before removals.

    start(domain, cid); added and removed(domain, idx, cid). The last action on a member decides.
    """
    limit = F.lit(True) if upto is None else F.col("idx") <= upto
    first = start.select("domain", "cid", F.lit(-1).cast("bigint").alias("idx"), F.lit(0).alias("gone"))
    plus = added.filter(limit).select("domain", "cid", F.col("idx").cast("bigint").alias("idx"), F.lit(0).alias("gone"))
    minus = removed.filter(limit).select("domain", "cid", F.col("idx").cast("bigint").alias("idx"), F.lit(1).alias("gone"))
    last = first.union(plus).union(minus).groupBy("domain", "cid").agg(F.max(F.struct("idx", "gone")).alias("last"))
    return last.filter("last.gone = 0").select("domain", "cid")


def snapshot_check(members: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(domain, root, size, matches): Merkle roots of members(domain, cid) against snapshots(domain, snapshot)."""
    found = merkle.tops(merkle.levels(merkle.ordered(members, ["domain"], "cid"), ["domain"]), ["domain"])
    joined = snapshots.join(found, "domain", "left")
    root = F.coalesce("root", F.lit(merkle.EMPTY_ROOT))
    return joined.select("domain", root.alias("root"), F.coalesce("size", F.lit(0)).alias("size"), (root == F.col("snapshot")).alias("matches"))


def gaps(generations: DataFrame) -> DataFrame:
    """generations(domain, idx, ...) plus `expected` and `gap`: whether the index isn't one more than the last."""
    order = Window.partitionBy("domain").orderBy("idx")
    before = F.lag("idx").over(order)
    return generations.withColumn("expected", F.coalesce(before + 1, F.col("idx"))).withColumn("gap", F.col("idx") != F.col("expected"))


def follows(generations: DataFrame) -> DataFrame:
    """(domain, idx, follows): whether a generation has the next index and names its predecessor as parent."""
    order = Window.partitionBy("domain").orderBy("idx")
    good = (F.col("idx") == F.lag("idx").over(order) + 1) & F.col("parent").isNotNull()
    first = F.row_number().over(order) == 1
    return generations.select("domain", "idx", F.when(first, F.col("parent").isNull()).otherwise(F.coalesce(good, F.lit(False))).alias("follows"))


def misdeclared(before: DataFrame, after: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(cid, fault): declared additions that didn't happen, and removals that weren't declared; all of one domain."""
    a, b = before.select("cid").distinct(), after.select("cid").distinct()
    fake = added.select("cid").distinct().join(b.join(a, "cid", "left_anti"), "cid", "left_anti").withColumn("fault", F.lit("declared added, not new"))
    hidden = a.join(b, "cid", "left_anti").join(removed.select("cid").distinct(), "cid", "left_anti").withColumn("fault", F.lit("removed, not declared"))
    return fake.union(hidden)


def removal_faults(removed: DataFrame) -> DataFrame:
    """removed(domain, idx, cid, cause, ref) rows without a known cause or a reference."""
    return removed.filter(~F.coalesce(F.col("cause").isin(*CAUSES), F.lit(False)) | F.col("ref").isNull())


def garbage(objects: DataFrame, declared: DataFrame, manifests: DataFrame) -> DataFrame:
    """Objects that are neither declared members nor manifests."""
    return objects.join(declared.select("cid").distinct(), "cid", "left_anti").join(manifests.select("cid").distinct(), "cid", "left_anti")


def removable(asked: DataFrame, declared: DataFrame, tombstones: DataFrame) -> DataFrame:
    """asked(cid) plus `removable`: not a declared member, or tombstoned."""
    d = declared.select("cid", F.lit(True).alias("d")).distinct()
    t = tombstones.select("cid", F.lit(True).alias("t")).distinct()
    return asked.join(d, "cid", "left").join(t, "cid", "left").select("cid", (F.col("d").isNull() | F.col("t").isNotNull()).alias("removable"))


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (lost, added): a corpus may grow but lose nothing."""
    a, b = before.select("cid").distinct(), after.select("cid").distinct()
    added = b.join(a, "cid", "left_anti").agg(F.count(F.lit(1))).scalar()
    return a.join(b, "cid", "left_anti").agg(F.count(F.lit(1)).alias("lost")).withColumn("added", added)


def missing_depends(members: DataFrame, depends: DataFrame) -> DataFrame:
    """(cid): what members(cid) rest on, directly or not, and don't include."""
    edges = depends.select(F.col("cid").alias("src"), F.col("dep").alias("dst"))
    return reached(members.select("cid"), edges).join(members.select("cid").distinct(), "cid", "left_anti")


def missing_equivalents(members: DataFrame, links: DataFrame) -> DataFrame:
    """(cid): what undirected links(src, dst) join to a member and isn't one."""
    ends = links.select(F.col("src").alias("node")).union(links.select(F.col("dst").alias("node")))
    found = components(ends, links)
    own = found.join(members.select(F.col("cid").alias("node")), "node", "left_semi").select("component").distinct()
    return found.join(own, "component", "left_semi").select(F.col("node").alias("cid")).join(members.select("cid"), "cid", "left_anti")


def checkpoints(head: Column) -> Column:
    """head - 1, head - 2, head - 4, ... down to 0, ascending."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: head.cast("bigint") - F.call_function("shiftleft", F.lit(1).cast("bigint"), k))
    return F.array_sort(F.filter(powers, lambda x: x >= 0))


def fetches(current: Column, head: Column) -> Column:
    """Fetches that catching up takes: bits set in the distance."""
    return F.bit_count(head.cast("bigint") - current.cast("bigint"))


def split_views(witnesses: DataFrame) -> DataFrame:
    """(domain, generation, roots): generations for which observers(observer, domain, generation, log_root) saw different roots."""
    return witnesses.groupBy("domain", "generation").agg(F.array_sort(F.collect_set("log_root")).alias("roots")).filter(F.size("roots") > 1)


def head_generation(generations: DataFrame) -> DataFrame:
    return generations.groupBy("domain").agg(F.max("idx").alias("head"))


def added_between(added: DataFrame, after: int, upto: int) -> DataFrame:
    """(domain, idx, cid) added in generations after .. upto."""
    return added.filter((F.col("idx") > after) & (F.col("idx") <= upto)).select("domain", "idx", "cid")


def untimestamped(objects: DataFrame, stamps: DataFrame, annotations: DataFrame) -> DataFrame:
    """Objects(cid) with neither a stamp nor a timestamp annotation(cid, target) on them, those annotations exempt."""
    bare = objects.join(stamps.select("cid").distinct(), "cid", "left_anti").join(annotations.select(F.col("target").alias("cid")).distinct(), "cid", "left_anti")
    return bare.join(annotations.select("cid").distinct(), "cid", "left_anti")


def personhood(proofs: DataFrame) -> DataFrame:
    """proofs(seq, subject, scheme, scope, nullifier) plus `accepted`: a nullifier serves the first subject of its scope alone."""
    first = proofs.groupBy("scope", "nullifier").agg(F.min_by("subject", "seq").alias("owner"))
    return proofs.join(first, ["scope", "nullifier"]).withColumn("accepted", F.col("subject") == F.col("owner")).drop("owner")


def scheme_minimum(proofs: DataFrame, least: int = 2) -> DataFrame:
    """(subject, schemes, enough)."""
    return proofs.groupBy("subject").agg(F.countDistinct("scheme").alias("schemes")).withColumn("enough", F.col("schemes") >= least)
