"""Canonical bytes, identifiers, objects and packs made from the harness tables and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cbor, ids, objects, packs
from .common import table


def _encoded(rows: DataFrame, names: list[str]) -> DataFrame:
    """(key, content): a map of the named columns in canonical bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = zip(*(b.column(i + 1).to_pylist() for i in range(len(names))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cbor.encode(dict(zip(names, v))) for v in values], pa.binary())], ["key", "content"])

    return rows.select("key", *names).mapInArrow(run, "key long, content binary")


def canonical_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a map: its bytes, their digest and size, and whether they decode to what was encoded."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), (-F.col("p_partkey")).cast("long").alias("minus"))
    made = _encoded(p, ["name", "size", "minus"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [cbor.decode(x) for x in b.column(1).to_pylist()]
            again = [cbor.encode(v) == x for v, x in zip(values, b.column(1).to_pylist())]
            arrays = [b.column(0), b.column(1), pa.array([v["name"] for v in values]), pa.array([v["size"] for v in values], pa.int64()), pa.array(again)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "content", "name", "size", "same"])

    read = made.mapInArrow(run, "key long, content binary, name string, size long, same boolean")
    return read.select("key", F.lower(F.hex("content")).alias("bytes"), F.sha2("content", 256).alias("digest"), "name", "size", "same")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, content): an object per nation; of every fifth the author is missing, of every seventh the version unknown."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for key, name, region in zip(*(b.column(i).to_pylist() for i in range(3))):
                value = {"pub": "1" if key % 7 else "0", "type": "claim.prose", "created": "2024-01-01T00:00:00Z", "author": f"region-{region}", "body": {"class": "definition", "content": name, "lang": "en", "depends": []}}
                if key % 5 == 4:
                    del value["author"]
                made.append(cbor.encode(value))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["key", "content"])

    return n.mapInArrow(run, "key long, content binary")


def objects_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects read from their bytes, faulty ones with their fault; each under the identifier of its bytes."""
    found = objects.parsed(_nations(spark, sf_dir))
    named = found.join(_nations(spark, sf_dir).select("key", ids.cid(F.col("content")).alias("named")), "key") if "key" in found.columns else found
    return named.select("key", "ok", "fault", "kind", "author", F.get_json_object("body", "$.content").alias("content"), (F.col("cid") == F.col("named")).alias("named"))


def claims_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims among the sound objects, counted by author, class and language."""
    good, _ = objects.split(objects.parsed(_nations(spark, sf_dir)))
    return objects.claims(good).groupBy("author", "class", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("content").alias("last"))


def packs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names packed by nation and unpacked again; the pack of every sixth nation lacks its last byte."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").cast("long").alias("key"), "s_name")

    def run(t: pa.Table) -> pa.Table:
        nation = t["nation"][0].as_py()
        raw = packs.pack([x.encode() for _, x in sorted(zip(t["key"].to_pylist(), t["s_name"].to_pylist()))])
        try:
            frames, fault = packs.unpack(raw[:-1] if nation % 6 == 0 else raw), None
        except ValueError as e:
            frames, fault = [], str(e)
        return pa.table({"nation": pa.array([nation], pa.int64()), "size": pa.array([len(raw)], pa.int64()), "frames": pa.array([len(frames)], pa.int64()), "last": pa.array([frames[-1].decode() if frames else None], pa.string()), "fault": pa.array([fault], pa.string())})

    return s.groupBy("nation").applyInArrow(run, "nation long, size long, frames long, last string, fault string")


QUERIES = {f.__name__: f for f in (canonical_bytes, objects_parsed, claims_read, packs_read)}


# The same in SQL: the bytes of a map written out by hand, shortest heads, keys in order of their own bytes.


def _head(major: int, n: str) -> str:
    """Hexadecimal head of a major type (0 to 3) and a number below 2^32."""
    at = major * 32
    return f"CASE WHEN {n} < 24 THEN lpad(to_hex({at} + {n}), 2, '0') WHEN {n} < 256 THEN to_hex({at + 24}) || lpad(to_hex({n}), 2, '0') WHEN {n} < 65536 THEN to_hex({at + 25}) || lpad(to_hex({n}), 4, '0') ELSE to_hex({at + 26}) || lpad(to_hex({n}), 8, '0') END"


_TEXT = f"({_head(3, 'strlen(p_name)')}) || hex(encode(p_name))"
_MINUS = f"CASE WHEN p_partkey = 0 THEN '00' ELSE {_head(1, '(p_partkey - 1)')} END"
_MAP = f"'a3' || '65' || hex(encode('minus')) || ({_MINUS}) || '64' || hex(encode('name')) || {_TEXT} || '64' || hex(encode('size')) || ({_head(0, 'p_size')})"
_KEYED = "(SELECT *, n_nationkey % 5 <> 4 AND n_nationkey % 7 <> 0 AS ok FROM nation)"
SQL = {
    "canonical_bytes": f"SELECT p_partkey AS key, lower({_MAP}) AS bytes, sha256(unhex({_MAP})) AS digest, p_name AS name, CAST(p_size AS BIGINT) AS size, TRUE AS same FROM part",
    "objects_parsed": f"""SELECT n_nationkey AS key, ok, CASE WHEN n_nationkey % 5 = 4 THEN 'missing field author' WHEN n_nationkey % 7 = 0 THEN 'unknown version' END AS fault, CASE WHEN ok THEN 'claim.prose' END AS kind,
CASE WHEN ok THEN 'region-' || n_regionkey END AS author, CASE WHEN ok THEN n_name END AS content, TRUE AS named FROM {_KEYED}""",
    "claims_read": f"SELECT 'region-' || n_regionkey AS author, 'definition' AS class, 'en' AS lang, count(*) AS n, max(n_name) AS last FROM {_KEYED} WHERE ok GROUP BY 1",
    "packs_read": """SELECT CAST(s_nationkey AS BIGINT) AS nation, CAST(sum(4 + strlen(s_name)) AS BIGINT) AS size, CASE WHEN s_nationkey % 6 = 0 THEN 0 ELSE count(*) END AS frames, CASE WHEN s_nationkey % 6 > 0 THEN arg_max(s_name, s_suppkey) END AS last,
CASE WHEN s_nationkey % 6 = 0 THEN 'truncated frame' END AS fault FROM supplier GROUP BY s_nationkey""",
}
