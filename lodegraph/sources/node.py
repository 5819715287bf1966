"""What a node answers about its tables: objects by name, offers, members of domains, records and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_cid
from ..operators import merkle
from ..operators.fixpoint import held
from . import ids


def looked_up(asked: DataFrame, store: DataFrame) -> DataFrame:
    """asked(cid) with `status` and `content` from store(cid, content): found, unknown, or ill-formed."""
    met = asked.select("cid").distinct().join(store.select("cid", "content", F.lit(True).alias("held")), "cid", "left")
    status = F.when(~F.coalesce(is_cid(F.col("cid")), F.lit(False)), "ill-formed").when(F.col("held"), "found").otherwise("unknown")
    return met.select("cid", status.alias("status"), F.when(status == "found", F.col("content")).alias("content"))


def offered(offers: DataFrame, store: DataFrame) -> DataFrame:
    """(cid, status): offers(content) named by their bytes, once each: held already, or accepted."""
    named = offers.select(ids.cid(F.col("content")).alias("cid")).distinct()
    return named.join(store.select("cid", F.lit("held").alias("status")).dropDuplicates(["cid"]), "cid", "left").select("cid", F.coalesce("status", F.lit("accepted")).alias("status"))


def frames(members: DataFrame, store: DataFrame) -> DataFrame:
    """(domain, cid, frame): what each domain's pack holds, in order of cid: a big-endian length and the bytes held."""
    held = members.select("domain", "cid").distinct().join(store.select("cid", "content").dropDuplicates(["cid"]), "cid")
    return held.select("domain", "cid", F.concat(F.unhex(F.lpad(F.hex(F.octet_length("content")), 8, "0")), F.col("content")).alias("frame"))


def record(generations: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(domain, idx) with the generation's columns; `held` says whether there is one."""
    return asked.select("domain", "idx").distinct().join(generations.withColumn("held", F.lit(True)), ["domain", "idx"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def tombstoned(asked: DataFrame, removed: DataFrame) -> DataFrame:
    """asked(cid) with whether a removal names it, and the cause of the first one."""
    first = removed.groupBy("cid").agg(F.min_by("cause", F.struct("domain", "idx")).alias("cause"), F.lit(True).alias("gone"))
    return asked.select("cid").distinct().join(first, "cid", "left").select("cid", F.coalesce("gone", F.lit(False)).alias("tombstoned"), "cause")


def membership_proofs(members: DataFrame, asked: DataFrame) -> DataFrame:
    """(member, finding, verified, root) for asked(member) against one set of members(member).

    Present: its own path leads to the root. Absent: the members on either side do and are neighbours, or the one at an
    end is the first or the last; in an empty set nothing has to be shown.
    """
    leaves = held(merkle.ordered(members))
    found = held(merkle.levels(leaves))
    top = held(merkle.tops(found))
    root, total = top.select("root").scalar(), top.select("size").scalar()
    shown = held(leaves.join(merkle.inclusion(found), "pos").withColumns({"root": root, "total": total}))
    shown = held(shown.select("member", "pos", merkle.verify_inclusion(F.col("leaf"), F.col("pos"), F.col("total"), F.col("path"), F.col("root")).alias("good")))
    of = lambda name: shown.select(F.col("member").alias(name), F.col("pos").alias(f"{name}_pos"), F.col("good").alias(f"{name}_good"))
    near = merkle.neighbours(members, asked)
    met = near.join(of("own"), F.col("member") == F.col("own"), "left").join(of("before"), "before", "left").join(of("after"), "after", "left")
    inner = F.col("before_good") & F.col("after_good") & (F.col("after_pos") == F.col("before_pos") + 1)
    first, last = F.col("after_good") & (F.col("after_pos") == 0), F.col("before_good") & (F.col("before_pos") == total - 1)
    absent = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), inner).when(F.col("after").isNotNull(), first).when(F.col("before").isNotNull(), last).otherwise(total == 0)
    return met.select("member", F.when(F.col("present"), "present").otherwise("absent").alias("finding"), F.coalesce(F.when(F.col("present"), F.col("own_good")).otherwise(absent), F.lit(False)).alias("verified"), root.alias("root"))
