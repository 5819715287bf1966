"""Objects by kind, class and author; relations and annotations by end; tags, usage, classification; citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Findings of an assessment, and those that leave a claim open.
ASSESSMENTS = ("sound", "sound-in-scope", "superseded", "unsupported", "refuted", "undetermined")
LEAVES_OPEN = ("unsupported", "refuted", "undetermined")


def listed(objects: DataFrame, kind: str | None = None, claim_class: str | None = None, author: str | None = None) -> DataFrame:
    """Objects that fulfil every condition given, by id."""
    for column, value in (("kind", kind), ("class", claim_class), ("author", author)):
        if value is not None:
            objects = objects.filter(F.col(column) == value)
    return objects.orderBy("cid")


def outgoing(relations: DataFrame, kind: str) -> DataFrame:
    """(cid, others): sorted ids that each object points to by relations of a kind."""
    return relations.filter(F.col("kind") == kind).groupBy(F.col("src").alias("cid")).agg(F.array_sort(F.collect_set("dst")).alias("others"))


def incoming(relations: DataFrame, kind: str) -> DataFrame:
    return relations.filter(F.col("kind") == kind).groupBy(F.col("dst").alias("cid")).agg(F.array_sort(F.collect_set("src")).alias("others"))


def live(annotations: DataFrame, retracted: DataFrame) -> DataFrame:
    """Annotations that aren't retracted(cid)."""
    return annotations.join(retracted.select("cid").distinct(), "cid", "left_anti")


def tags(annotations: DataFrame, retracted: DataFrame) -> DataFrame:
    """(target, tags): sorted distinct values of live annotations."""
    return live(annotations, retracted).groupBy("target").agg(F.array_sort(F.collect_set("value")).alias("tags"))


def usages(annotations: DataFrame, retracted: DataFrame) -> DataFrame:
    """(target, source, locator): distinct live usages; a missing locator is empty."""
    return live(annotations, retracted).select("target", "source", F.coalesce("locator", F.lit("")).alias("locator")).distinct()


def by_human(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Objects plus `human`: whether their author's key is a human's; no key means no."""
    own = keys.select(F.col("cid").alias("author"), (F.col("principal") == "human").alias("human"))
    return objects.join(own, "author", "left").withColumn("human", F.coalesce("human", F.lit(False)))


def cited(references: dict[str, DataFrame]) -> DataFrame:
    """(target, how, source), distinct, from tables (source, target) by how they refer."""
    every = [df.select("target", F.lit(how).alias("how"), "source") for how, df in sorted(references.items())]
    found = every[0]
    for one in every[1:]:
        found = found.union(one)
    return found.filter("target IS NOT NULL").distinct()


def citation_check(items: DataFrame, objects: DataFrame, heads: DataFrame) -> DataFrame:
    """items(doc, pos, ref, bind, at) plus `status`.

    missing: not held; not-a-claim; ok: bound to an object, or to a lineage at its one head; no-at: a lineage binding
    without a version; unreachable-at: the version isn't held; diverged: the lineage's heads(cid, head) aren't that version.
    """
    held = objects.select(F.col("cid").alias("ref"), (F.col("kind") == "claim").alias("claim"))
    at = objects.select(F.col("cid").alias("at"), F.lit(True).alias("at_held"))
    head = heads.groupBy(F.col("cid").alias("ref")).agg(F.count(F.lit(1)).alias("n_heads"), F.min("head").alias("head"))
    found = items.join(held, "ref", "left").join(at, "at", "left").join(head, "ref", "left")
    status = (
        F.when(F.col("claim").isNull(), "missing")
        .when(~F.col("claim"), "not-a-claim")
        .when(F.col("bind") == "object", "ok")
        .when(F.col("at").isNull(), "no-at")
        .when(F.col("at_held").isNull(), "unreachable-at")
        .when((F.col("n_heads") > 1) | (F.col("head") != F.col("at")), "diverged")
        .otherwise("ok")
    )
    return found.select(*items.columns, status.alias("status"))


def names(published: DataFrame, drafts: DataFrame, imported: DataFrame) -> DataFrame:
    """(slug, cid): drafts before published names; imports fill gaps alone. Each is (slug, cid)."""
    every = drafts.withColumn("p", F.lit(0)).union(published.withColumn("p", F.lit(1))).union(imported.withColumn("p", F.lit(2)))
    return every.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("p", "cid"))).filter("n = 1").select("slug", "cid")


def one_head(heads: DataFrame, named: DataFrame) -> DataFrame:
    """(genesis, head): the single head; of several, the least with a local name, else the least."""
    own = named.select(F.col("cid").alias("head"), F.lit(1).alias("named")).distinct()
    order = Window.partitionBy("genesis").orderBy(F.desc(F.coalesce("named", F.lit(0))), "head")
    return heads.join(own, "head", "left").withColumn("n", F.row_number().over(order)).filter("n = 1").select("genesis", "head")


def summary(mentioned: DataFrame, objects: DataFrame) -> DataFrame:
    """mentioned(cid) with label and class, `held` false where the object isn't there."""
    own = objects.select("cid", "label", "class", F.lit(True).alias("held"))
    return mentioned.select("cid").distinct().join(own, "cid", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def signers(sigs: DataFrame, objects: DataFrame) -> DataFrame:
    """(cid, signers): the author, then keys that signed, each once, in id order of the signatures."""
    own = objects.select("cid", F.lit("").alias("at"), "author")
    every = own.union(sigs.select(F.col("target").alias("cid"), F.col("cid").alias("at"), "author"))
    return every.groupBy("cid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "author"))), lambda x: x["author"])).alias("signers"))


def shared_names(terms: DataFrame) -> DataFrame:
    """(term, definitions): every definition that bears a name, sorted."""
    return terms.groupBy("term").agg(F.array_sort(F.collect_set("cid")).alias("definitions"))


def open_annotations(assessments: DataFrame, verdicts: DataFrame, disputes: DataFrame, resolved: DataFrame) -> DataFrame:
    """(target, open): negative live assessments and verdicts, and live disputes without a resolution(dispute)."""
    bad = assessments.filter(F.col("verdict").isin(*LEAVES_OPEN)).select("target").union(verdicts.filter("finding = 'deny'").select("target"))
    waiting = disputes.join(resolved.select("dispute").distinct(), "dispute", "left_anti").select("target")
    return bad.union(waiting).groupBy("target").agg(F.count(F.lit(1)).alias("open"))


def active_renderings(renderings: DataFrame) -> DataFrame:
    """The newest rendering(doc, created, cid, ...) of each document."""
    return renderings.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("created"), F.desc("cid")))).filter("n = 1").drop("n")


def map_nodes(named: DataFrame) -> DataFrame:
    """(cid, corpus): the most general corpus that names an id, from named(cid, corpus, generality)."""
    return named.groupBy("cid").agg(F.min_by("corpus", F.struct("generality", "corpus")).alias("corpus"))


def evidence_roles(roles: Column) -> Column:
    """Distinct roles in the order they come."""
    return F.array_distinct(roles)


def ledger_missing(required: Column, claimed: Column) -> Column:
    return F.array_sort(F.array_except(required, claimed))
