"""Exact top-k by inner product: ball trees per shard, searched best first by an upper bound, sharing the k-th score.

Vectors are scaled to integers: floor(scale * x) per component. Each shard of candidates gets a ball tree once (bounded
rows per leaf). Queries come to the shards, in three waves: each to one shard, then to about the square root of their
number, then to all others. A task reads a shard's tree, then its queries batch by batch, so what it holds is a tree and
a batch; queries visit the nodes in the order of the bound q.c + |q| r, and leave a node out where their k-th result so
far can't be beaten there. Between waves the best results of all shards are merged, and the next wave starts from their
k-th score. A tree is shuffled once a wave; vectors that ask, once for each shard, which is the stated work.

Vectors that are null, or hold null or non-finite components, and rows with null id take no part. Vectors score only
against vectors of their own length. Ties go to the smaller id; a node is left out at an equal bound only if all its
ids are larger. Of rows that repeat an id, all are candidates and the greatest vector asks. Scores beyond 64 bits are
held at the largest or smallest long. Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

LEAF = 256
#: Rows of a shard, on average.
SHARD_ROWS = 8192
#: Queries that walk a tree together.
GROUP = 256
NONE = np.iinfo(np.int64).min
TOP_LONG = np.iinfo(np.int64).max


def scaled(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, dim, v): usable vectors as packed little-endian doubles that hold floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            spoilt = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            usable = (spoilt[ends] == spoilt[ends - sizes]) & pc.and_(pc.is_valid(lists), pc.is_valid(b.column(0))).to_numpy(zero_copy_only=False)
            raw = np.floor(scale * flat).astype("<f8").tobytes()
            rows = np.flatnonzero(usable)
            packed = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends[rows].tolist(), sizes[rows].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(sizes[rows], pa.int32()), pa.array(packed, pa.binary())], ["id", "dim", "v"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id long, dim int, v binary")


class Tree:
    """A ball tree over the rows of `points`; nodes are lists, leaves are runs of `order`."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.least, self.span, self.children = [], [], [], [], []
        todo = [(0, len(points), None)]
        while todo:
            a, b, parent = todo.pop()
            own = self.order[a:b]
            part = points[own]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            n = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(away.max()))
            self.least.append(int(ids[own].min()))
            self.span.append((a, b))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(n)
            if b - a > leaf and away.max() > 0:
                pole = part[int(away.argmax())]
                other = part[int(((part - pole) ** 2).sum(axis=1).argmax())]
                side = part @ (other - pole)
                self.order[a:b] = own[np.argsort(side, kind="stable")]
                middle = (a + b) // 2
                todo += [(a, middle, n), (middle, b, n)]
        self.centre = np.array(self.centre)
        self.radius = np.array(self.radius)


def packed(tree: Tree, points: np.ndarray, ids: np.ndarray) -> bytes:
    """A tree with its rows, in the order of its leaves."""
    sink = io.BytesIO()
    children = np.array([c or [-1, -1] for c in tree.children], np.int64)
    np.savez(sink, points=points[tree.order], ids=ids[tree.order], centre=tree.centre, radius=tree.radius, least=np.array(tree.least, np.int64), span=np.array(tree.span, np.int64), children=children)
    return sink.getvalue()


def unpacked(blob: bytes) -> tuple[Tree, np.ndarray, np.ndarray]:
    """(tree, points, ids) of `packed`."""
    with np.load(io.BytesIO(blob)) as held:
        tree = Tree.__new__(Tree)
        tree.centre, tree.radius, tree.least = held["centre"], held["radius"], held["least"].tolist()
        tree.span = [tuple(x) for x in held["span"].tolist()]
        tree.children = [c if c[0] >= 0 else [] for c in held["children"].tolist()]
        points, ids = held["points"], held["ids"]
    tree.order = np.arange(len(ids))
    return tree, points, ids


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<f8").reshape(len(vectors), dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of integral doubles, as int64."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return (q @ c.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in c]
    return np.array([[max(NONE + 1, min(TOP_LONG, sum(int(x) * y for x, y in zip(row, other)))) for other in exact] for row in q], dtype=np.int64)


def _merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id."""
    order = np.lexsort((ids, np.invert(scores)), axis=1)[:, :k]  # ~s falls as s rises, without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best k of the shard for each query, as (scores, ids), missing ones at NONE.

    floor_score and floor_id: a k-th result known from elsewhere (NONE if none); what can't beat it may be missing.
    """
    best = np.full((len(queries), k), NONE, np.int64)
    best_id = np.full((len(queries), k), TOP_LONG, np.int64)
    norms = np.sqrt((queries**2).sum(axis=1))
    slack = lambda q, n: 1e-6 + 1e-9 * norms[q] * (np.sqrt((tree.centre[n] ** 2).sum()) + tree.radius[n])
    bound = lambda q, n: queries[q] @ tree.centre[n] + norms[q] * tree.radius[n] + slack(q, n)

    def open_to(q: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
        own, own_id = best[q, -1], best_id[q, -1]
        known = (floor_score[q] > own) | ((floor_score[q] == own) & (floor_id[q] < own_id))
        kth, kth_id = np.where(known, floor_score[q], own), np.where(known, floor_id[q], own_id)
        level = np.floor(up)
        return (level > kth) | ((level >= kth) & (tree.least[n] < kth_id)) | (kth == NONE)

    for at in range(0, len(queries), GROUP):
        everyone = np.arange(at, min(at + GROUP, len(queries)))
        heap = [(-float(bound(everyone, 0).max()), 0, everyone)]
        while heap:
            _, n, asked = heapq.heappop(heap)
            up = bound(asked, n)
            asked = asked[open_to(asked, up, n)]
            if not len(asked):
                continue
            if tree.children[n]:
                for child in tree.children[n]:
                    heapq.heappush(heap, (-float(bound(asked, child).max()), child, asked))
                continue
            a, b = tree.span[n]
            own = tree.order[a:b]
            found = products(queries[asked], points[own])
            names = np.broadcast_to(ids[own], found.shape)
            found = np.where(names == query_ids[asked][:, None], NONE, found)
            names = np.where(found == NONE, TOP_LONG, names)
            better = found.max(axis=1) >= best[asked, -1]
            rows = asked[better]
            if len(rows):
                best[rows], best_id[rows] = _merge(np.hstack([best[rows], found[better]]), np.hstack([best_id[rows], names[better]]), k)
    return best, best_id


def _trees(points: DataFrame) -> DataFrame:
    """(dim, shard, tree) of points(id, dim, v, shard), each shard's rows in one task."""

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        c, ids = matrix(t["v"], t["dim"][0].as_py()), t["id"].to_numpy()
        return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], "tree": pa.array([packed(Tree(c, ids), c, ids)], pa.binary())})

    return points.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def _searched(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of a shard for each row of asked(id, dim, v, floor_score, floor_id, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for b in batches:
            dims, shards, queries = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(queries) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dims)]):
                place = (int(dims[a]), int(shards[a])) if a < z else None
                if a == z or not queries[a]:
                    held, at = (unpacked(b.column(3)[a].as_py()), place) if a < z else (held, at)
                    continue
                if at != place:
                    continue  # no vector of that length in the shard
                own = b.slice(a, z - a)
                ids = own.column(4).to_numpy(zero_copy_only=False)
                scores, found = search(*held, matrix(own.column(3), place[0]), ids, k, *(own.column(i).to_numpy(zero_copy_only=False) for i in (5, 6)))
                hit = scores != NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, hit.sum(axis=1))), pa.array(found[hit]), pa.array(scores[hit])], ["query_id", "vec_id", "score"])

    none = F.lit(0).cast("long")
    rows = trees.select("dim", "shard", F.lit(0).alias("query"), F.col("tree").alias("v"), none.alias("id"), none.alias("floor_score"), none.alias("floor_id"))
    every = rows.unionByName(asked.withColumn("query", F.lit(1)).select(*rows.columns))
    dealt = every.repartition(partitions(trees.sparkSession), "dim", "shard").sortWithinPartitions("dim", "shard", "query")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def waves(shards: int) -> list[tuple[int, int]]:
    """Ranges of steps from a query's own shard on, wave by wave."""
    second = 1 + math.isqrt(shards - 1)
    return [(a, b) for a, b in ((0, 1), (1, second), (second, shards)) if a < b]


def top_k(df: DataFrame, asks: str, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that fulfils the SQL condition `asks` on `id`."""
    points = saved(scaled(df, key, vector, scale), "vectors").rows
    shards = max(1, -(-points.count() // shard_rows))
    trees = saved(_trees(points.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))), "trees").rows
    asking = points.filter(asks).groupBy("id").agg(F.max(F.struct("dim", "v")).alias("m")).select("id", "m.dim", "m.v")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = None
    for first, stop in waves(shards):
        if best is None:
            known = asking.withColumns({"floor_score": F.lit(NONE), "floor_id": F.lit(TOP_LONG)})
        else:
            last = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
            known = asking.join(last, "id", "left").fillna({"floor_score": NONE, "floor_id": TOP_LONG})
        steps = F.explode(F.sequence(F.lit(first), F.lit(stop - 1)))
        asked = known.withColumn("step", steps).withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "id") + F.col("step"), F.lit(shards)).cast("int"))
        found = _searched(trees, asked.drop("step"), k)
        best = ranked(found if best is None else found.union(best.select("query_id", "vec_id", "score")))
        if stop < shards:
            best = saved(best, "best").rows
    return best.select("query_id", "rank", "vec_id", "score")
