"""From a claim graph to standings: evidence for every target, trust edges, and the policy's weights, all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..model import REPRODUCIBILITY, ClaimGraph
from . import evidence, lineage, standing, trust

#: The largest weight, in units.
MOST_UNITS = str(2**64 - 1)
TEXTS = "array<string>"


def _of(graph: ClaimGraph, kind: str, **fields: str) -> DataFrame:
    """Annotations of a kind with values taken from their JSON payload by path."""
    rows = graph.annotations.filter(F.col("kind") == kind)
    return rows.select("cid", "author", "target", *[F.get_json_object("value", f"$.{path}").alias(name) for name, path in fields.items()])


def verdicts(graph: ClaimGraph) -> DataFrame:
    return _of(graph, "verdict", finding="finding").filter(F.col("finding").isin("affirm", "deny", "abstain"))


def disputes(graph: ClaimGraph) -> DataFrame:
    """(target, dispute, author): disputes by prose claims that are held."""
    claims = graph.claims.select(F.col("cid").alias("dispute"), F.col("author").alias("by"))
    found = graph.relations.filter("kind = 'disputes'").select(F.col("dst").alias("target"), F.col("src").alias("dispute")).distinct()
    return found.join(claims, "dispute").select("target", "dispute", F.col("by").alias("author"))


def sustained(graph: ClaimGraph) -> DataFrame:
    """(target, dispute): grounds of sustained resolutions on each target."""
    rows = _of(graph, "resolution", outcome="outcome", grounds="grounds").filter("outcome = 'sustained'")
    return rows.select("target", F.explode(F.from_json("grounds", TEXTS)).alias("dispute")).distinct()


def argued(graph: ClaimGraph) -> DataFrame:
    """(target, author): disputes that no sustained resolution on the same target names."""
    return disputes(graph).join(sustained(graph), ["target", "dispute"], "left_anti").select("target", "author").distinct()


def reproductions(graph: ClaimGraph) -> DataFrame:
    """(id, target, author, outcome, funding, shared, human): settled annotations on claims that aren't formal."""
    rows = _of(graph, "settled", outcome="outcome", shared="independence.shared_materials", funding="independence.funding").filter("outcome IS NOT NULL")
    informal = rows.join(graph.claims.filter("class = 'formal'").select(F.col("cid").alias("target")), "target", "left_anti")
    human = graph.keys.select(F.col("cid").alias("author"), (F.col("principal") == "human").alias("human"))
    return informal.join(human, "author", "left").select(F.col("cid").alias("id"), "target", "author", "outcome", "funding", F.col("shared").isNotNull().alias("shared"), F.coalesce("human", F.lit(False)).alias("human"))


def affiliations(graph: ClaimGraph) -> DataFrame:
    rows = graph.annotations.filter("kind = 'affiliated'")
    at = lambda path: F.get_json_object("value", f"$.{path}")
    return rows.select(F.col("target").alias("author"), at("org").alias("org"), at("period.from").alias("from"), at("period.to").alias("to")).filter("org IS NOT NULL")


def same_person(graph: ClaimGraph) -> DataFrame:
    rows = _of(graph, "attests", claim="claim", about="about").filter("claim = 'same-person-as' AND about IS NOT NULL")
    return evidence.same_person_links(rows.select(F.col("target").alias("subject"), F.col("about").alias("same_as")))


def independent(graph: ClaimGraph, found: DataFrame) -> DataFrame:
    """(target, independent_consistent, independent_inconsistent) over human reproductions that share no materials."""
    able = found.filter("human AND NOT shared AND outcome IN ('consistent', 'inconsistent')")
    parties = able.select(F.concat_ws("|", "outcome", "target").alias("group"), "id", "author", "funding")
    counts = evidence.independent_counts(parties, affiliations(graph), same_person(graph))
    named = counts.select(F.substring_index("group", "|", 1).alias("outcome"), F.expr("substring(`group`, instr(`group`, '|') + 1)").alias("target"), "independent")
    of = lambda o: F.coalesce(F.max(F.when(F.col("outcome") == o, F.col("independent"))), F.lit(0)).alias(f"independent_{o}")
    return named.groupBy("target").agg(of("consistent"), of("inconsistent"))


def proofs(graph: ClaimGraph) -> DataFrame:
    """(target): formal claims with a verified proof."""
    rows = _of(graph, "settled", outcome="outcome").filter("outcome = 'verified'")
    return rows.join(graph.claims.filter("class = 'formal'").select(F.col("cid").alias("target")), "target", "left_semi").select("target").distinct()


def trust_edges(graph: ClaimGraph) -> DataFrame:
    """(src, dst, weight, subjects, age_days): weights are unsigned 64-bit units, scaled, as DECIMAL; anything else is one unit."""
    rows = _of(graph, "trusts", weight="weight", subjects="subjects")
    units = F.when(F.col("weight").rlike("^[0-9]{1,20}$"), F.col("weight").cast("decimal(20,0)"))
    whole = F.when(units <= F.lit(MOST_UNITS).cast("decimal(20,0)"), units * F.lit(fixed.SCALE).cast("decimal(7,0)")).cast("decimal(26,0)")
    return trust.trust_edges(rows.select("cid", "author", "target", whole.alias("weight"), F.from_json("subjects", TEXTS).alias("subjects")))


def evidence_for(graph: ClaimGraph, weights: DataFrame) -> DataFrame:
    """One row per claim in the form `standing.standings` takes, from weights(key, weight)."""
    found = reproductions(graph)
    pressing = argued(graph).join(weights.select(F.col("key").alias("author"), "weight"), "author").groupBy("target").agg(F.sum("weight").cast("bigint").alias("argued"))
    gone = lineage.retracted(graph.relations, graph.objects.select("cid", "author")).select(F.col("cid").alias("target"), F.lit(True).alias("retracted"))
    repro = F.when(F.col("repro_class").isin(*REPRODUCIBILITY), F.col("repro_class")).otherwise("open")
    base = graph.claims.select(F.col("cid").alias("target"), "class", repro.alias("repro_class"))
    joined = base.join(evidence.verdict_weights(verdicts(graph), weights), "target", "left").join(pressing, "target", "left").join(gone, "target", "left")
    joined = joined.join(proofs(graph).withColumn("proof_checked", F.lit(True)), "target", "left").join(evidence.tally(found), "target", "left").join(independent(graph, found), "target", "left")
    numbers = ["affirm", "deny", "abstain", "argued", "consistent", "inconsistent", "inconclusive", "independent_consistent", "independent_inconsistent"]
    return joined.fillna(0, numbers).fillna(False, ["retracted", "proof_checked"])


def weights_for(graph: ClaimGraph, roots: DataFrame, policy: standing.Policy, subjects: list[str] | None = None) -> DataFrame:
    """(key, weight) under a policy; with subjects, only edges open to one of them count."""
    edges = trust_edges(graph)
    return trust.propagate(edges if subjects is None else trust.within(edges, subjects), roots, policy.damping, policy.rounds, policy.half_life)


def ranking(graph: ClaimGraph, roots: DataFrame, policy: standing.Policy = standing.Policy(), claim_class: str | None = None) -> DataFrame:
    """Every claim's standing under a policy, ranked by affirming weight, then id."""
    found = standing.standings(evidence_for(graph, weights_for(graph, roots, policy)), policy)
    return standing.ranked(found if claim_class is None else found.filter(F.col("class") == claim_class))


def why(graph: ClaimGraph, target: str, roots: DataFrame, policy: standing.Policy = standing.Policy(), subjects: list[str] | None = None) -> DataFrame:
    """One claim's standing with every component, its weights confined to its own subjects."""
    found = evidence_for(graph, weights_for(graph, roots, policy, subjects or []))
    return standing.standings(found.filter(F.col("target") == target), policy)
