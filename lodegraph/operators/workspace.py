"""Working copies: names and pins, drafts against what is published, what a parent must provide, and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CID_ANYWHERE
from . import fixpoint


def references(objects: DataFrame) -> DataFrame:
    """(source, target): every identifier that an object's body text holds."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(CID_ANYWHERE), F.lit(0))))
    return objects.select(F.col("cid").alias("source"), found.alias("target"))


def needed(own: DataFrame, parent: DataFrame, refs: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """(cid): a parent's objects that own(cid) reach by refs(source, target) or by what is attached(target, cid) to what they reach."""
    steps = refs.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    if attached is not None:
        steps = steps.union(attached.select(F.col("target").alias("src"), F.col("cid").alias("dst")))
    return fixpoint.reached(own, steps).join(own.select("cid"), "cid", "left_anti").join(parent.select("cid").distinct(), "cid", "left_semi")


def resolved(asked: DataFrame, locks: DataFrame, pinned: DataFrame) -> DataFrame:
    """asked(alias, slug) with the cid that locks(alias, slug, cid) give and a `fault`: unknown, or newer than the pinned(alias, cid) members."""
    pins = pinned.select("alias", "cid", F.lit(True).alias("in_pin")).distinct()
    met = asked.join(locks, ["alias", "slug"], "left").join(pins, ["alias", "cid"], "left")
    return met.select("alias", "slug", "cid", F.when(F.col("cid").isNull(), "unknown").when(F.col("in_pin").isNull(), "newer than the pin").alias("fault"))


def draft_report(drafts: DataFrame, published: DataFrame) -> DataFrame:
    """(slug, change, draft, published): new, changed, unchanged or withdrawn, from two tables (slug, cid)."""
    d, p = drafts.select("slug", F.col("cid").alias("draft")), published.select("slug", F.col("cid").alias("published"))
    change = F.when(F.col("published").isNull(), "new").when(F.col("draft").isNull(), "withdrawn").when(F.col("draft") == F.col("published"), "unchanged").otherwise("changed")
    return d.join(p, "slug", "full_outer").select("slug", change.alias("change"), "draft", "published")


def competing(concepts: DataFrame, geneses: DataFrame) -> DataFrame:
    """(code, rivals): codes that concepts(cid, code) of more than one genesis(node, genesis) bear."""
    own = concepts.join(geneses.select(F.col("node").alias("cid"), "genesis"), "cid", "left").select("code", F.coalesce("genesis", "cid").alias("genesis"))
    return own.groupBy("code").agg(F.array_sort(F.collect_set("genesis")).alias("rivals")).filter(F.size("rivals") > 1)


def reference_shape(text: Column) -> Column:
    """What a reference in a source is by its looks: an identifier, an imported name, or a local slug."""
    return F.when(text.rlike(f"^{CID_ANYWHERE}$"), "cid").when(text.rlike("^[a-z0-9-]+:[a-z0-9-]+$"), "import").when(text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "slug").otherwise("unknown")


def renderings(settled: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc, cid, created, outputs): settled(cid, doc, created, depends_count) with exactly two depends and their outputs(cid, kind, name, value) as a map."""
    maps = outputs.groupBy("cid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("outputs"))
    return settled.filter("depends_count = 2").join(maps, "cid").select("doc", "cid", "created", "outputs")


def pin_status(pins: DataFrame, heads: DataFrame) -> DataFrame:
    """pins(alias, generation) with the parent's head(alias, head) and whether it is newer."""
    return pins.join(heads, "alias", "left").select("alias", "generation", "head", F.coalesce(F.col("head") > F.col("generation"), F.lit(False)).alias("newer"))


def blobs_for(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs(cid, ...) that some object's body names."""
    return blobs.join(references(objects).select(F.col("target").alias("cid")).distinct(), "cid", "left_semi")


def labels(objects: DataFrame, tags: DataFrame, geneses: DataFrame) -> DataFrame:
    """(cid, label): title, then tags of the genesis and its own, in brackets, from tags(target, tags)."""
    first = geneses.select(F.col("node").alias("cid"), "genesis")
    of = lambda key, name: tags.select(F.col("target").alias(key), F.col("tags").alias(name))
    met = objects.join(first, "cid", "left").join(of("genesis", "inherited"), "genesis", "left").join(of("cid", "own"), "cid", "left")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("inherited", none), F.coalesce("own", none)))
    return met.select("cid", F.concat(F.col("label"), F.when(F.size(every) > 0, F.concat(F.lit(" ["), F.array_join(every, ", "), F.lit("]"))).otherwise("")).alias("label"))


def sound_in_scope(assessments: DataFrame) -> DataFrame:
    """(target, sound): how many judged a claim sound in its scope."""
    return assessments.groupBy("target").agg(F.count_if(F.col("verdict") == "sound-in-scope").alias("sound"))


def newest(rows: DataFrame, by: str) -> DataFrame:
    """The newest row (created, cid) of each `by`."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created"), F.desc("cid")))).filter("n = 1").drop("n")
