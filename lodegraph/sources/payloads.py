"""Payload readers: policies, domain records and other bodies as rows, and sources written by hand as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_cid
from ..model import OUTCOMES
from ..operators.standing import MOST_ROUNDS, Policy, checked
from . import cbor
from .objects import field

#: Kinds of bounty, and the least review share in basis points.
BOUNTIES = ("review", "replication", "access", "equivalence", "mirror")
LEAST_REVIEW_SHARE = 6000


def policies(objects: DataFrame) -> DataFrame:
    """Scaled parameters of each policy, with `fault` where it can't be used."""
    of = objects.filter("kind = 'policy'")
    whole = lambda name: field(name).try_cast("bigint").alias(name)
    found = of.select("cid", *[whole(n) for n in ("damping", "iterations", "tau", "delta_max", "replication_floor", "independence_distance", "decay_half_life_days")], F.coalesce(field("equivalence") != "none", F.lit(True)).alias("use_equivalence"), F.from_json(field("roots"), "array<struct<key:string,weight:bigint>>").alias("roots"))
    needed = F.exists(F.array("damping", "iterations", "tau", "delta_max", "replication_floor", "independence_distance"), lambda x: x.isNull() | (x < 0))
    empty = F.coalesce(F.forall("roots", lambda r: F.coalesce(r["weight"], F.lit(0)) == 0), F.lit(True))
    fault = F.when(needed, "missing or ill-typed field").when(F.col("roots").isNull(), "missing roots").when(empty, "no root with weight").when(F.col("iterations") > MOST_ROUNDS, "too many iterations")
    return found.withColumn("fault", fault)


def policy_roots(found: DataFrame) -> DataFrame:
    """(policy, key, weight): scaled root weights of usable policies."""
    rows = found.filter("fault IS NULL").select(F.col("cid").alias("policy"), F.explode("roots").alias("r"))
    return rows.select("policy", "r.key", (F.col("r.weight") * 1_000_000).alias("weight"))


def as_policy(row) -> Policy:
    """A row of `policies` as parameters."""
    return Policy(row["damping"], row["iterations"], row["tau"], row["delta_max"], row["replication_floor"], row["independence_distance"], row["decay_half_life_days"])


def policy_body(policy: Policy, roots: dict[str, int], use_equivalence: bool = True) -> dict:
    """The body of a policy object, as `policies` reads it: whole weights by key, one of them above zero."""
    if not any(roots.values()) or min(roots.values()) < 0:
        raise ValueError("a policy needs a root with weight, and none below zero")
    checked(policy)
    body = {"damping": policy.damping, "iterations": policy.rounds, "tau": policy.tau, "delta_max": policy.delta_max, "replication_floor": policy.replication_floor, "independence_distance": policy.independence_distance}
    if policy.half_life is not None:
        body["decay_half_life_days"] = policy.half_life
    return body | {"equivalence": "trusted" if use_equivalence else "none", "roots": [{"key": k, "weight": w} for k, w in sorted(roots.items())]}


def generations(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(generations, added, removed) of generation records."""
    of = objects.filter("kind = 'generation'").select(field("domain").alias("domain"), field("index").cast("bigint").alias("idx"), field("parent").alias("parent"), field("snapshot").alias("snapshot"), field("added").alias("a"), field("removed").alias("r"))
    added = of.select("domain", "idx", F.explode(F.from_json("a", "array<string>")).alias("cid"))
    removed = of.select("domain", "idx", F.explode(F.from_json("r", "array<struct<cid:string,cause:string,ref:string>>")).alias("x")).select("domain", "idx", "x.*")
    return of.select("domain", "idx", "parent", "snapshot"), added, removed


def manifests(objects: DataFrame) -> DataFrame:
    """(cid, snapshot, bound, size, fault): a domain states its snapshot, its byte bound and a size within it."""
    of = objects.filter("kind = 'domain'").select("cid", field("snapshot").alias("snapshot"), field("bound").cast("bigint").alias("bound"), field("size").cast("bigint").alias("size"))
    return of.withColumn("fault", F.when(F.col("snapshot").isNull() | F.col("bound").isNull() | F.col("size").isNull(), "missing field").when(F.col("size") > F.col("bound"), "larger than its bound"))


def witnesses(annotations: DataFrame) -> DataFrame:
    """(observer, domain, generation, log_root, observed) of witness annotations that state all of them."""
    at = lambda path: F.get_json_object("value", f"$.{path}")
    rows = annotations.filter("kind = 'witnessed'")
    return rows.select(F.col("author").alias("observer"), F.col("target").alias("domain"), at("generation").cast("bigint").alias("generation"), at("log_root").alias("log_root"), at("observed").alias("observed")).na.drop(subset=["generation", "log_root"])


def disclosed(annotations: DataFrame, kind: str) -> DataFrame:
    """Attestations, assumptions and triage by kind, with their payload; without a disclosure they aren't read."""
    return annotations.filter(F.col("kind") == kind).withColumn("disclosure", F.get_json_object("value", "$.disclosure")).filter("disclosure IS NOT NULL")


def bounty_faults(objects: DataFrame) -> DataFrame:
    """(cid, rule) of bounties with an unknown kind (review if none is stated), no policy or target, or too small a share for review."""
    of = objects.filter("kind = 'bounty'").select("cid", F.coalesce(field("kind"), F.lit("review")).alias("k"), field("policy").alias("p"), field("target").alias("t"), field("base_share").try_cast("decimal(20,0)").alias("s"))
    absent = lambda c: ~F.coalesce(is_cid(F.col(c)), F.lit(False))
    share = F.when(F.col("s").isNull() | (F.col("s") < 0), F.lit("no review share")).when(F.col("s") < LEAST_REVIEW_SHARE, F.lit("review share too small"))
    rules = F.array_compact(F.array(F.when(~F.col("k").isin(*BOUNTIES), F.lit("unknown kind")), F.when(absent("p"), F.lit("no policy")), share, F.when(absent("t"), F.lit("no target"))))
    return of.select("cid", F.explode(rules).alias("rule"))


def named_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, body, path, fault): JSON sources under a folder, each named by its file; floats and bad names are faults."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder)

    @F.udf("struct<body:string,fault:string>", useArrow=True)
    def read(raw: bytes):
        try:
            return json.dumps(cbor.projected(cbor.from_json(json.loads(raw))), sort_keys=True, ensure_ascii=False), None
        except ValueError as e:
            return None, str(e)

    slug = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    rows = files.select("path", slug.alias("slug"), read("content").alias("x"))
    return rows.select("slug", "x.body", "path", F.coalesce("x.fault", F.when(~F.col("slug").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit("not a slug"))).alias("fault"))


def eval_vector(data: bytes) -> dict:
    """A self-contained evaluation: {policy, edges, class, evidence ...} from canonical bytes; the policy's bytes are decoded too."""
    value = cbor.decode(data)
    if not isinstance(value, dict) or not isinstance(value.get("policy"), bytes):
        raise ValueError("a vector is a map with a policy's bytes")
    body = cbor.decode(value["policy"])
    return value | {"policy": body.get("body", body)}


def evaluated(spark: SparkSession, data: bytes) -> dict:
    """The standing of an evaluation vector, weights as six-decimal text."""
    from ..functions import fixed
    from ..operators import standing, trust

    v = eval_vector(data)
    p = v["policy"]
    policy = Policy(p["damping"], p["iterations"], p["tau"], p["delta_max"], p["replication_floor"], p["independence_distance"], p.get("decay_half_life_days"))
    edges = spark.createDataFrame([(e["from"], e["to"], e["weight"] * 1_000_000, e.get("age_days", 0)) for e in v.get("edges", [])], "src string, dst string, weight long, age_days long")
    roots = spark.createDataFrame([(r["key"], r["weight"] * 1_000_000) for r in p["roots"]], "key string, weight long")
    weights = {r["key"]: r["weight"] for r in trust.propagate(edges, roots, policy.damping, policy.rounds, policy.half_life).collect()}  # one vector's keys
    total = lambda name: sum(weights.get(k, 0) for k in set(v.get(name, [])))
    repeat = v.get("reproductions", {})
    row = ("target", v["class"], total("affirm"), total("deny"), total("abstain"), total("argued_disputes"), v.get("retracted", False), v.get("proof_checked", False), v.get("reproducibility", "open"), repeat.get("independent_consistent", 0), repeat.get("independent_inconsistent", 0))
    schema = "target string, class string, affirm long, deny long, abstain long, argued long, retracted boolean, proof_checked boolean, repro_class string, independent_consistent int, independent_inconsistent int"
    found = standing.standings(spark.createDataFrame([row], schema), policy)
    shown = found.select("result", *[fixed.show(F.col(c)).alias(c) for c in ("affirm", "deny", "abstain", "argued", "delta")]).first().asDict()
    assert shown["result"] in OUTCOMES
    return shown
