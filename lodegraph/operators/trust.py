"""Trust: edges from annotations, seeds from policy roots, and integer personalized PageRank over exactly K rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .fixpoint import EVERY, held


def trust_edges(annotations: DataFrame) -> DataFrame:
    """(src, dst, weight, subjects, age_days) from trust annotations(cid, author, target, weight, subjects).

    The first annotation in id order of each (author, target) counts; weight defaults to one unit; age is 0.
    """
    first = Window.partitionBy("author", "target").orderBy("cid")
    kept = annotations.withColumn("n", F.row_number().over(first)).filter("n = 1")
    one = F.lit(fixed.SCALE).cast("bigint")
    return kept.select(F.col("author").alias("src"), F.col("target").alias("dst"), F.coalesce("weight", one).alias("weight"), F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), F.lit(0).cast("bigint").alias("age_days"))


def within(edges: DataFrame, subjects: list[str] | Column) -> DataFrame:
    """Edges confined to no subject, or to one of `subjects`."""
    wanted = subjects if isinstance(subjects, Column) else F.array(*[F.lit(s) for s in subjects]).cast("array<string>")
    return edges.filter((F.size("subjects") == 0) | F.arrays_overlap("subjects", wanted))


def decayed(edges: DataFrame, half_life: int | None) -> DataFrame:
    """Edges with their weight after age_days; no half-life leaves them."""
    if half_life is None:
        return edges
    return edges.withColumn("weight", fixed.halve(F.col("weight"), F.col("age_days"), F.lit(half_life).cast("bigint")))


def shares(edges: DataFrame) -> DataFrame:
    """(src, dst, share): parallel edges summed, then each source's weights as shares of their sum.

    Weights are BIGINT, or DECIMAL where they may be larger; sums are aggregated before they are dealt by source.
    """
    large = dict(edges.dtypes)["weight"].startswith("decimal")
    kind, part = ("decimal(30,0)", fixed.share) if large else ("bigint", fixed.ratio)
    summed = edges.groupBy("src", "dst").agg(F.sum("weight").cast(kind).alias("weight"))
    totals = edges.groupBy("src").agg(F.sum("weight").cast(kind).alias("total"))
    return summed.join(totals, "src").select("src", "dst", part(F.col("weight"), F.col("total")).alias("share"))


def seeds(roots: DataFrame) -> DataFrame:
    """(key, seed) from roots(key, weight): each row's share of all weights, summed by key."""
    total = roots.agg(F.sum("weight").cast("bigint")).scalar()
    each = roots.select("key", fixed.ratio(F.col("weight"), total).alias("seed"))
    return each.groupBy("key").agg(F.sum("seed").cast("bigint").alias("seed"))


def propagate(edges: DataFrame, roots: DataFrame, damping: int = 850_000, rounds: int = 20, half_life: int | None = None) -> DataFrame:
    """(key, weight) after exactly `rounds` rounds; keys at zero are dropped at the end only.

    A round gives each seed its truncated (1 - damping) part and sends each weight along its shares, truncated first by
    the share, then by damping. What flows into keys without edges is lost, not dealt out again.
    """
    flow = held(shares(decayed(edges, half_life)))
    seed = held(seeds(roots))
    base = seed.select("key", fixed.times(F.col("seed"), F.lit(fixed.SCALE - damping)).alias("part"))
    weights = seed.select("key", F.col("seed").alias("weight"))
    for n in range(1, rounds + 1):
        sent = weights.join(flow, F.col("key") == F.col("src")).select(F.col("dst").alias("key"), fixed.times(fixed.times(F.col("weight"), F.col("share")), F.lit(damping)).alias("part"))
        weights = base.union(sent).groupBy("key").agg(F.sum("part").cast("bigint").alias("weight"))
        if n % EVERY == 0:
            weights = held(weights)
    return weights.filter("weight <> 0")


def reachable_within(edges: DataFrame, starts: DataFrame, distance: int) -> DataFrame:
    """(start, node, depth): nodes at most `distance` undirected hops from each start, the start included."""
    from .fixpoint import reach

    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(starts, both, distance)
