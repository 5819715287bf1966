"""Connected components of a link table by alternating large and small stars, every round on a table in the shared folder.

Every stage and every scan of a job leaves some 4 MB of buffers on the driver's heap, so a few links are not worth rounds
of jobs: one task joins them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, saved, spread_join

#: Links up to which one task holds all of them: a few MB.
FEW_LINKS = 50_000


def _both(edges: DataFrame) -> DataFrame:
    """Each link in both directions."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ends).alias("e")).select("e.a", "e.b")


def _starred(rows: DataFrame, least: DataFrame, star: Callable[[DataFrame], DataFrame]) -> Saved:
    """The links that `star` makes of rows with the least neighbour m of their a; hubs, which later rounds make of labels,
    aren't dealt to one task. Such a join names its table several times, so that is written first: the driver's memory goes
    with the size of plans."""
    table = saved(least, "least")
    links = saved(star(spread_join(rows, table.rows, ["a"], "n")).filter("a <> b").distinct(), "links")
    table.drop()
    return links


def _large_star(edges: DataFrame) -> Saved:
    """Links each node's larger neighbours to the least of its neighbours and itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _starred(both.filter("b > a"), least, lambda x: x.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> Saved:
    """Links each node and its smaller neighbours to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return _starred(edges, least, lambda x: x.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")))


def _joined(edges: DataFrame) -> DataFrame:
    """(node, label) of at most FEW_LINKS edges(a, b), by union-find in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), arrow), pa.array([root(x) for x in above], arrow)], ["node", "label"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b), label being the least node it reaches.

    Null ends and self-links are dropped; repeated links do no harm; no links give an empty table. Rounds grow with the
    logarithm of the component size, and what a round moves is at most twice the links. Up to FEW_LINKS links, or once
    rounds have left no more, one task joins them: rounds keep every node and what it reaches.
    """
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(edges.rows)
    while seen["n"] > FEW_LINKS:
        star = _large_star(edges.rows)
        after = _small_star(star.rows)
        star.drop()
        edges.drop()
        edges, now = after, state(after.rows)
        if now == seen:
            break
        seen = now
    found = edges.rows
    if seen["n"] <= FEW_LINKS:
        return _joined(found)
    roots = found.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return found.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
