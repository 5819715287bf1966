"""The data model: enumerations, and the typed tables that every operator works on.

A claim graph is a set of tables named as in SCHEMAS; identifiers are strings, or any orderable type in derived graphs.
Weights are BIGINT in units of 10^-6; no evaluation column is a float.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
CLAIM_CLASSES = ("formal", "empirical", "attributive", "definitional", "normative", "expressive", "archival", "procedural", "performative")
NOT_TRUTH_APT = ("definitional", "normative", "expressive", "performative")
ASSERTIONS = ("formal", "empirical", "definitional", "normative")
PROVENANCE_ONLY = ("attributive", "archival")
RELATION_CLASSES = {
    "supersedes": "performative",
    "translates": "empirical",
    "implements": "empirical",
    "depends": "definitional",
    "disputes": "performative",
    "supports": "performative",
    "equivalent": "definitional",
    "retracts": "performative",
    "derived-from": "attributive",
    "delegates": "performative",
}
ACYCLIC = ("supersedes", "implements", "depends", "derived-from")
ANNOTATION_CLASSES = {
    "settled": "empirical",
    "well-formed": "empirical",
    "attests": "empirical",
    "witnessed": "empirical",
    "assessment": "performative",
    "verdict": "performative",
    "critique": "performative",
    "triage": "performative",
    "resolution": "performative",
    "trusts": "performative",
    "assumes-accountability": "performative",
    "classifies": "definitional",
    "tagged": "definitional",
    "usage": "attributive",
    "affiliated": "attributive",
    "timestamped": "attributive",
    "personhood": "formal",
}
PRINCIPALS = ("human", "organization", "automated")
REPRODUCIBILITY = ("open", "restricted", "unique-event", "destructive")
OUTCOMES = ("accepted", "rejected", "contested", "undetermined", "unreplicated", "not-truth-apt")

#: Names of rules on money, fixed values, each with its ground.
PROHIBITIONS = {
    "gate-access": "money may hasten a replication but decides nobody's right to read",
    "standing-from-money": "what is believed must not follow from who can pay",
    "bounty-value-in-evaluation": "an evaluation judges a claim, not the sum offered on it",
    "settlement-as-truth": "a payout reports a funder's chosen view at one time, not a fact",
}
#: The methods and fidelities of a translation.
TRANSLATION_METHODS = ("human", "machine", "machine-post-edited")
FIDELITIES = ("literal", "idiomatic", "adapted")

#: Column lists of the tables.
SCHEMAS = {
    "objects": "cid string, kind string, created string, author string, prev string, basis string, body string, ext string, bytes binary",
    "claims": "cid string, author string, class string, lang string, content string, repro_class string, term string, def_sort string",
    "claim_depends": "cid string, dep string, pos int",
    "claim_evidence": "cid string, pos int, kind string, role string, ref string, locator string",
    "relations": "cid string, author string, kind string, src string, dst string, aspect string",
    "annotations": "cid string, author string, kind string, target string, aspect string, value string",
    "keys": "cid string, principal string, alg string, pubkey binary, rotates string",
    "sigs": "cid string, author string, target string, purpose string, value binary",
    "docs": "cid string, title string",
    "doc_items": "doc string, pos int, ref string, bind string, at string, role string",
    "anchors": "cid string, lineage string, current string, stewards array<string>, threshold bigint",
    "policy_roots": "policy string, key string, weight bigint",
    "generations": "domain string, idx bigint, parent string, snapshot string",
    "gen_added": "domain string, idx bigint, cid string",
    "gen_removed": "domain string, idx bigint, cid string, cause string, ref string",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def labelled(column: Column, labels: dict[str, str]) -> Column:
    """The label of a name; null for one that isn't listed."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), column)


def relation_class(kind: Column) -> Column:
    return labelled(kind, RELATION_CLASSES)


def annotation_class(kind: Column) -> Column:
    return labelled(kind, ANNOTATION_CLASSES)


def is_acyclic_kind(kind: Column) -> Column:
    return kind.isin(*ACYCLIC)


def content_is_assertion(kind: Column) -> Column:
    return kind.isin(*ASSERTIONS)


class ClaimGraph:
    """Tables of one graph by name; a table that isn't given is empty."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        self.spark = spark
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self._tables[name] if name in self._tables else empty(self.spark, name)
