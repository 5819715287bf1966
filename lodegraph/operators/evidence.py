"""Evidence for and against claims: verdicts, disputes, reproductions, independence, usage; all targets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlaps
from ..model import NOT_TRUTH_APT, PROVENANCE_ONLY
from .fixpoint import components

def accepts_verdict(kind: Column) -> Column:
    return ~kind.isin(*NOT_TRUTH_APT)


def verdict_fault(kind: Column, aspect: Column) -> Column:
    """Why a verdict on a claim of that class is refused; null if it isn't."""
    return F.when(~accepts_verdict(kind), F.lit("class takes no verdict")).when(kind.isin(*PROVENANCE_ONLY) & ~F.coalesce(aspect == "provenance", F.lit(False)), F.lit("verdict must be on provenance"))


def verdict_sets(verdicts: DataFrame) -> DataFrame:
    """(target, affirm, deny, abstain): sorted sets of authors, from verdicts(target, author, finding). A key may be in several."""
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("finding") == f, F.col("author")))).alias(f)
    return verdicts.groupBy("target").agg(of("affirm"), of("deny"), of("abstain"))


def verdict_weights(verdicts: DataFrame, weights: DataFrame) -> DataFrame:
    """(target, affirm, deny, abstain): each key's weight once per finding; a key without a weight counts 0.

    Keys are made distinct and pre-summed by finding before they meet, so a target with many verdicts stays spread.
    """
    keys = verdicts.select("target", "finding", "author").distinct()
    weighed = keys.join(weights.select(F.col("key").alias("author"), "weight"), "author", "left")
    of = lambda f: F.coalesce(F.sum(F.when(F.col("finding") == f, F.col("weight"))), F.lit(0)).cast("bigint").alias(f)
    return weighed.groupBy("target").agg(of("affirm"), of("deny"), of("abstain"))


def argued_disputes(disputes: DataFrame, grounds: DataFrame) -> DataFrame:
    """Disputes(target, dispute, author) that no sustained resolution's grounds(dispute) name: (target, author), distinct."""
    return disputes.join(grounds.select("dispute").distinct(), "dispute", "left_anti").select("target", "author").distinct()


def tally(reproductions: DataFrame) -> DataFrame:
    """(target, consistent, inconsistent, inconclusive): an underspecified method counts as inconclusive."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names)).alias(names[0])
    return reproductions.groupBy("target").agg(n("consistent"), n("inconsistent"), n("inconclusive", "method-underspecified"))


def related_pairs(parties: DataFrame, affiliations: DataFrame | None = None, same_person: DataFrame | None = None) -> DataFrame:
    """(src, dst), src < dst, of parties(id, group, author, funding) of one group that aren't independent.

    Related: the same author, equal declared funding, one person by attestation (a, b), or an affiliation
    (author, org, from, to) that overlaps in time. Of each reason as many pairs come out as hold its parties together:
    stars on the least party, and of affiliations the links of a sweep by their beginnings, each period with the one
    before it that ends last. Only periods that end before they begin are compared with all of their group and org.
    """

    def star(by: str) -> DataFrame:
        own = parties.filter(F.col(by).isNotNull()).select("group", by, "id")
        hubs = own.groupBy("group", by).agg(F.min("id").alias("hub"))
        return own.join(hubs, ["group", by]).filter("id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst"))

    found = star("author").union(star("funding"))
    a = parties.select("group", F.col("id").alias("src"), F.col("author").alias("author_a"))
    b = parties.select(F.col("group").alias("group_b"), F.col("id").alias("dst"), F.col("author").alias("author_b"))
    if same_person is not None:
        links = same_person.select(F.col("a").alias("author_a"), F.col("b").alias("author_b"))
        links = links.union(links.select(F.col("author_b").alias("author_a"), F.col("author_a").alias("author_b"))).distinct()
        found = found.union(a.join(links, "author_a").join(b, "author_b").filter("group = group_b AND src < dst").select("src", "dst"))
    if affiliations is not None:
        own = parties.join(affiliations, "author").select("group", "id", "org", "from", "to").distinct()
        begin, end = F.coalesce("from", F.lit("")), F.coalesce("to", F.lit("~"))
        other = own.select(*[F.col(c).alias(f"{c}_b") for c in own.columns])
        meet = (F.col("group") == F.col("group_b")) & (F.col("org") == F.col("org_b")) & (F.col("id") != F.col("id_b"))
        odd = own.filter(begin > end).join(other, meet & overlaps(F.col("from"), F.col("to"), F.col("from_b"), F.col("to_b"))).select("id", F.col("id_b").alias("other"))
        before = Window.partitionBy("group", "org").orderBy(begin, end, "id").rowsBetween(Window.unboundedPreceding, -1)
        swept = own.filter(begin <= end).withColumn("last", F.max(F.struct(end.alias("end"), F.col("id").alias("id"))).over(before))
        linked = swept.filter((F.col("last.end") >= begin) & (F.col("last.id") != F.col("id"))).select("id", F.col("last.id").alias("other")).union(odd)
        found = found.union(linked.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")))
    return found.distinct()


def independent_counts(parties: DataFrame, affiliations: DataFrame | None = None, same_person: DataFrame | None = None) -> DataFrame:
    """(group, independent): number of components of related parties in each group."""
    found = components(parties.select(F.col("id").alias("node")), related_pairs(parties, affiliations, same_person))
    return parties.join(found, parties["id"] == found["node"]).groupBy("group").agg(F.countDistinct("component").alias("independent"))


def same_person_links(attestations: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct unordered pairs from attestations(subject, same_as)."""
    return attestations.filter("subject <> same_as").select(F.least("subject", "same_as").alias("a"), F.greatest("subject", "same_as").alias("b")).distinct()


def usage_sources(usages: DataFrame) -> DataFrame:
    """(target, sources): sorted distinct corpora that cite a definition, retracted or not."""
    return usages.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def assessments(annotations: DataFrame) -> DataFrame:
    """(target, list): sorted (author, verdict, grounds) of assessments that have both fields."""
    whole = annotations.filter("verdict IS NOT NULL AND grounds IS NOT NULL")
    return whole.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("author", "verdict", "grounds"))).alias("list"))
