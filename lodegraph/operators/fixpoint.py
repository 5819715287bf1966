"""Loops over edge tables: every walk, closure and ordering of the engine goes through here.

Each takes DataFrames and returns one; edges are (src, dst) of one orderable type. Rounds work on frontiers with joins
and aggregations, never on collected rows; only counts reach the driver. Lineage is cut by reliable checkpoints in the
folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds between checkpoints of a loop with a fixed count.
EVERY = 4


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a local one under a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodegraph-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def held(df: DataFrame) -> DataFrame:
    """A checkpointed copy of df."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reach(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth) for all nodes that each start reaches, itself at depth 0. starts: (start).

    Breadth first: depth is the least number of edges. `most` limits it; cycles end by themselves.
    """
    steps = held(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seen = held(starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    front, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        met = front.join(steps, front["node"] == steps["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = held(met.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if depth % EVERY == 0:
            seen = held(seen)
    return seen


def reached(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(cid): own(cid) and all that they reach, as from one start: a frontier is a set of nodes, not of pairs."""
    steps = held(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seen = front = held(own.select("cid").filter("cid IS NOT NULL").distinct())
    rounds = 0
    while not front.isEmpty():
        met = front.join(steps, front["cid"] == steps["src"]).select(F.col("dst").alias("cid")).distinct()
        front = held(met.join(seen, "cid", "left_anti"))
        seen, rounds = seen.union(front), rounds + 1
        if rounds % EVERY == 0:
            seen = held(seen)
    return seen


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node, depth) without the starts themselves, plus `cyclic`: whether the start reaches itself again."""
    found = reach(starts, edges)
    back = found.join(edges.select("src", "dst").distinct(), (F.col("node") == F.col("src")) & (F.col("dst") == F.col("start"))).select("start").distinct().withColumn("cyclic", F.lit(True))
    return found.filter("depth > 0").join(back, "start", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def reaches(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(start, target) plus `reached`; a start reaches itself."""
    found = reach(pairs.select("start"), edges).select("start", F.col("node").alias("target"), F.lit(True).alias("reached"))
    return pairs.join(found, ["start", "target"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def roots(parents: DataFrame) -> DataFrame:
    """(node, root, steps) by pointer jumping over parents(node, parent), one parent a node at most.

    A node without a parent is its own root. On a cycle, every node's root is the cycle's least node.
    """
    base = parents.select("node", "parent")
    everyone = base.select("node").union(base.select(F.col("parent").alias("node"))).filter("node IS NOT NULL").distinct()
    now = held(everyone.join(base, "node", "left").select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.least("node", F.coalesce("parent", "node")).alias("low")))
    total = now.count()
    rounds = 1
    while True:
        above = now.select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("low").alias("low2"))
        after = held(now.join(above, now["up"] == above["n2"]).select("node", F.col("up2").alias("up"), (F.col("steps") + F.col("s2")).alias("steps"), F.least("low", "low2").alias("low")))
        moved = after.filter("steps > 0").join(now.filter("steps > 0").select(F.col("node").alias("n3"), F.col("steps").alias("s3")), F.col("node") == F.col("n3")).filter("steps <> s3").count()
        now, rounds = after, rounds * 2
        if moved == 0 or rounds > total:
            break
    cyclic = now.join(base.filter("parent IS NOT NULL").select(F.col("node").alias("n4")), now["up"] == F.col("n4"), "left")
    return cyclic.select("node", F.when(F.col("n4").isNull(), F.col("up")).otherwise(F.col("low")).alias("root"), F.when(F.col("n4").isNull(), F.col("steps")).alias("steps"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without outgoing edges, else one more than the highest level among those it points to.

    Nodes on or above a cycle get no level (null): the edges are acyclic exactly if none is null.
    """
    steps = held(edges.select("src", "dst").distinct())
    open_nodes = held(nodes.select("node").distinct())
    done, level = None, 0
    while True:
        waiting = steps.select(F.col("src").alias("node")).distinct()
        ready = held(open_nodes.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        if level % EVERY == EVERY - 1:
            done = held(done)
        open_nodes = held(open_nodes.join(ready, "node", "left_anti"))
        steps = held(steps.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
        level += 1
    left = open_nodes.withColumn("level", F.lit(None).cast("int"))
    return left if done is None else done.union(left)


def acyclic(edges: DataFrame) -> DataFrame:
    """One row: (edges, on_or_above_cycle, acyclic)."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    stuck = levels(nodes, edges).filter("level IS NULL").agg(F.count(F.lit(1))).scalar()
    return edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("on_or_above_cycle", stuck).withColumn("acyclic", F.col("on_or_above_cycle") == 0)


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, path): a cycle of edges(src, dst) for each set of nodes that can't be ordered, its least node first and last.

    Every node that `levels` leaves open points to another such node; following the least of them leads onto one cycle,
    and what nothing follows to is peeled off, so only the cycles' own nodes are walked. `path` is as long as its cycle.
    """
    stuck = held(levels(nodes, edges).filter("level IS NULL").select("node"))
    after = edges.select("src", "dst").join(stuck.select(F.col("node").alias("dst")), "dst").join(stuck.select(F.col("node").alias("src")), "src")
    follow = held(after.groupBy("src").agg(F.min("dst").alias("dst")))
    turned = follow.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    on = levels(follow.select(F.col("src").alias("node")), turned).filter("level IS NULL").select("node")
    ring = held(follow.join(on.select(F.col("node").alias("src")), "src"))
    first = roots(ring.select(F.col("src").alias("node"), F.col("dst").alias("parent"))).select(F.col("root").alias("start")).distinct()
    found = reach(first, ring).groupBy(F.col("start").alias("cycle")).agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("walk"))
    return found.select("cycle", F.concat(F.transform("walk", lambda w: w["node"]), F.array("cycle")).alias("path"))


def closes_cycle(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) plus `closes`: whether adding the edge would close a cycle (a self-edge, or dst reaches src)."""
    asked = pairs.select("src", "dst", F.col("dst").alias("start"), F.col("src").alias("target"))
    return reaches(asked, edges).select("src", "dst", F.col("reached").alias("closes"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node that undirected links (src, dst) reach, by alternating large and small stars."""
    edges = held(links.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = held(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
