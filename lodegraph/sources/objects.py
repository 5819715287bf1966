"""Objects from files: scan, check, and spread into the tables of the model. Faulty bytes go to a table of their own."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cbor, ids

#: Header fields, and the version they must state.
REQUIRED = ("pub", "type", "created", "author", "body")
OPTIONAL = ("prev", "basis", "ext")
VERSION = "1"

PARSED = "ok boolean, fault string, cid string, kind string, created string, author string, prev string, basis string, body string, ext string"


def parse(data: bytes) -> dict:
    """A row of PARSED for one object's bytes."""
    row = dict.fromkeys(("ok", "fault", "cid", "kind", "created", "author", "prev", "basis", "body", "ext"))
    row["ok"], row["cid"] = False, ids.cid_of(data)
    try:
        value = cbor.decode(data)
    except cbor.Refused as e:
        return row | {"fault": e.rule}
    if not isinstance(value, dict):
        return row | {"fault": "an object is a map"}
    unknown = sorted(set(value) - set(REQUIRED) - set(OPTIONAL))
    missing = [k for k in REQUIRED if k not in value]
    if unknown or missing:
        return row | {"fault": f"unknown field {unknown[0]}" if unknown else f"missing field {missing[0]}"}
    if value["pub"] != VERSION:
        return row | {"fault": "unknown version"}
    if not all(isinstance(value[k], str) for k in ("type", "created", "author")) or not isinstance(value["body"], dict):
        return row | {"fault": "ill-typed header"}
    text = lambda v: None if v is None else json.dumps(cbor.projected(v), ensure_ascii=False, sort_keys=True) if not isinstance(v, str) else v
    return row | {"ok": True, "kind": value["type"], "created": value["created"], "author": value["author"], "prev": text(value.get("prev")), "basis": text(value.get("basis")), "body": json.dumps(cbor.projected(value["body"]), ensure_ascii=False, sort_keys=True), "ext": text(value.get("ext"))}


def parsed(files: DataFrame, content: str = "content") -> DataFrame:
    """files plus the columns of PARSED; decoded in Arrow batches."""
    names = [c.split()[0] for c in PARSED.split(", ")]
    kept = [c for c in files.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(x.as_py() or b"") for x in b.column(b.schema.get_field_index(content))]
            own = [pa.array([r[n] for r in rows], pa.bool_() if n == "ok" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *own], [*kept, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name in kept] + [PARSED])
    return files.select(*kept).mapInArrow(run, schema)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.cbor file under a folder, parsed: (path, content, ...)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cbor").option("recursiveFileLookup", "true").load(folder)
    return parsed(files.select("path", "content"))


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, quarantine) of a scan; repeated objects once."""
    good = found.filter("ok").select("cid", "kind", "created", "author", "prev", "basis", "body", "ext", F.col("content").alias("bytes"))
    return good.dropDuplicates(["cid"]), found.filter("NOT ok").select(*[c for c in ("path", "cid", "fault") if c in found.columns])


def verified(pairs: DataFrame) -> DataFrame:
    """pairs(cid, content) whose bytes have the digest named: a built-in hash, no Python."""
    return pairs.filter(ids.cid(F.col("content")) == F.col("cid"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """store(cid, content) and the new pairs that are sound and not held yet."""
    return store.unionByName(verified(new).dropDuplicates(["cid"]).join(store.select("cid"), "cid", "left_anti").select(*store.columns))


def field(path: str, body: str = "body") -> Column:
    return F.get_json_object(body, f"$.{path}")


def claims(objects: DataFrame) -> DataFrame:
    of = objects.filter("kind = 'claim.prose'")
    return of.select("cid", "author", field("class").alias("class"), field("lang").alias("lang"), field("content").alias("content"), field("reproducibility.class").alias("repro_class"), field("defines.name").alias("term"), field("defines.sort").alias("def_sort"))


def claim_depends(objects: DataFrame) -> DataFrame:
    of = objects.filter("kind = 'claim.prose'")
    return of.select("cid", F.posexplode(F.from_json(field("depends"), "array<string>")).alias("pos", "dep")).select("cid", "dep", "pos")


def claim_evidence(objects: DataFrame) -> DataFrame:
    kind = "array<struct<kind:string,role:string,ref:string,locator:string>>"
    of = objects.filter("kind = 'claim.prose'")
    return of.select("cid", F.posexplode(F.from_json(field("evidence"), kind)).alias("pos", "e")).select("cid", "pos", "e.*")


def relations(objects: DataFrame) -> DataFrame:
    of = objects.filter("kind = 'claim.relation'")
    return of.select("cid", "author", field("kind").alias("kind"), field("from").alias("src"), field("to").alias("dst"), field("aspect").alias("aspect"))


def annotations(objects: DataFrame) -> DataFrame:
    of = objects.filter("kind = 'claim.annotation'")
    return of.select("cid", "author", field("kind").alias("kind"), field("target").alias("target"), field("aspect").alias("aspect"), field("value").alias("value"))


def doc_items(objects: DataFrame) -> DataFrame:
    """Sections flattened to items in order; binding defaults to the object, role to assert."""
    item = "array<struct<items:array<struct<ref:string,bind:string,at:string,role:string>>>>"
    of = objects.filter("kind = 'doc'").select(F.col("cid").alias("doc"), F.from_json(field("sections"), item).alias("s"))
    flat = of.select("doc", F.posexplode(F.flatten(F.transform("s", lambda x: x["items"]))).alias("pos", "i"))
    return flat.select("doc", "pos", "i.ref", F.coalesce("i.bind", F.lit("object")).alias("bind"), "i.at", F.coalesce("i.role", F.lit("assert")).alias("role"))


def anchors(objects: DataFrame) -> DataFrame:
    of = objects.filter("kind = 'anchor'")
    stewards = F.filter(F.coalesce(F.from_json(field("stewards"), "array<string>"), F.array().cast("array<string>")), lambda s: s.rlike(r"^pub:sha2-256:[a-z2-7]{52}$"))
    return of.select("cid", field("lineage").alias("lineage"), field("current").alias("current"), stewards.alias("stewards"), F.coalesce(field("threshold").cast("bigint"), F.lit(1).cast("bigint")).alias("threshold"))


def violations(objects: DataFrame) -> DataFrame:
    """(cid, rule): claims and annotations that break a rule of their own."""
    from ..model import CLAIM_CLASSES
    from ..operators.evidence import verdict_fault

    c, d, e = claims(objects), claim_depends(objects), claim_evidence(objects)
    unknown = c.filter(~F.coalesce(F.col("class").isin(*CLAIM_CLASSES), F.lit(False))).select("cid", F.lit("unknown class").alias("rule"))
    bare = c.filter("content IS NULL OR lang IS NULL").select("cid", F.lit("missing field").alias("rule"))
    how = e.filter("kind IN ('method', 'derivation')").groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    repeat = c.filter("class = 'empirical'").join(how, "cid", "left").filter("coalesce(n, 0) <> 1").select("cid", F.lit("one method or derivation").alias("rule"))
    undeclared = e.filter("kind = 'claim' AND role = 'source'").join(d.select("cid", F.col("dep").alias("ref")), ["cid", "ref"], "left_anti").select("cid", F.lit("source not in depends").alias("rule")).distinct()
    verdicts = annotations(objects).filter("kind = 'verdict'").join(c.select(F.col("cid").alias("target"), "class"), "target")
    refused = verdicts.withColumn("rule", verdict_fault(F.col("class"), F.col("aspect"))).filter("rule IS NOT NULL").select("cid", "rule")
    return unknown.union(bare).union(repeat).union(undeclared).union(refused)
