"""Migration: objects rewritten in the order of their references, since a new identifier changes whoever names it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fixpoint
from . import cbor, ids

#: Fixed value: kinds whose identity rests on the root of a set, which aren't rewritten.
SKIPPED = ("domain", "generation")


def texts(value) -> Iterator[str]:
    """Every text in a value, map keys apart."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from texts(v)
    elif isinstance(value, dict):
        for v in value.values():
            yield from texts(v)


def renamed(value, names: dict[str, str]):
    """A value with every text that is one of `names` replaced."""
    if isinstance(value, str):
        return names.get(value, value)
    if isinstance(value, list):
        return [renamed(v, names) for v in value]
    return {k: renamed(v, names) for k, v in value.items()} if isinstance(value, dict) else value


def references(objects: DataFrame) -> DataFrame:
    """(cid, kind, refs): identifiers anywhere in each of objects(cid, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [cbor.decode(x.as_py()) for x in b.column(1)]
            refs = [sorted({t for t in texts(v) if t.startswith(ids.PREFIX)}) for v in values]
            kinds = [v.get("type") if isinstance(v, dict) else None for v in values]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(refs, pa.list_(pa.string()))], ["cid", "kind", "refs"])

    return objects.select("cid", "content").mapInArrow(run, "cid string, kind string, refs array<string>")


def migrate(objects: DataFrame, change: Callable[[dict], dict]) -> tuple[DataFrame, DataFrame]:
    """(migrated(old, new, content), stuck(cid)): each object changed and rewritten after those it names.

    Objects of SKIPPED kinds are left alone, and so are references to them; stuck ones name each other in a circle.
    """
    found = fixpoint.held(references(objects))
    able = found.filter(~F.coalesce(F.col("kind").isin(*SKIPPED), F.lit(False)))
    links = able.select(F.col("cid").alias("src"), F.explode("refs").alias("dst")).join(able.select(F.col("cid").alias("dst")), "dst", "left_semi")
    order = fixpoint.held(fixpoint.levels(able.select(F.col("cid").alias("node")), links.select("src", "dst")))
    rows = order.join(objects.select(F.col("cid").alias("node"), "content"), "node").join(able.select(F.col("cid").alias("node"), "refs"), "node")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [cbor.encode(change(renamed(cbor.decode(c.as_py()), dict(n.as_py() or [])))) for c, n in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ids.cid_of(r) for r in raw]), pa.array(raw, pa.binary())], ["old", "new", "content"])

    schema, done = "old string, new string, content binary", None
    top = order.agg(F.max("level")).first()[0]
    for level in range(0 if top is None else top + 1):
        now = rows.filter(F.col("level") == level)
        if done is None:
            named = now.select("node", "content", F.lit(None).cast("map<string,string>").alias("names"))
        else:
            pairs = now.select("node", F.explode("refs").alias("old")).join(done.select("old", "new"), "old")
            maps = pairs.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"))
            named = now.join(maps, "node", "left").select("node", "content", "names")
        made = fixpoint.held(named.mapInArrow(rewrite, schema))
        done = made if done is None else fixpoint.held(done.union(made))
    stuck = order.filter("level IS NULL").select(F.col("node").alias("cid"))
    return objects.sparkSession.createDataFrame([], schema) if done is None else done, stuck
