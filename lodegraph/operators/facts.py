"""Facts by computed path: singulars in wholes, classes by code prefix, concepts by column; and a fact's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import h3
from .fixpoint import reach

#: Fixed value: most hops up a part-of chain.
MOST_HOPS = 64


def chains(singulars: DataFrame) -> DataFrame:
    """(cid, whole, depth): each of singulars(cid, part_of) with the wholes it is part of, itself at depth 0."""
    up = singulars.filter("part_of IS NOT NULL").select(F.col("cid").alias("src"), F.col("part_of").alias("dst"))
    return reach(singulars.select(F.col("cid").alias("start")), up, MOST_HOPS).select(F.col("start").alias("cid"), F.col("node").alias("whole"), "depth")


def chain_faults(singulars: DataFrame) -> DataFrame:
    """(cid, fault): chains that are too long, come back on themselves, or leave the singulars."""
    met = chains(singulars)
    outside = met.join(singulars.select(F.col("cid").alias("whole")), "whole", "left_anti").select("cid").distinct().withColumn("fault", F.lit("not a singular"))
    up = singulars.select(F.col("cid").alias("whole"), "part_of")
    back = met.join(up, "whole").filter("part_of = cid").select("cid").distinct().withColumn("fault", F.lit("cycle"))
    deep = met.filter(F.col("depth") >= MOST_HOPS).select("cid").distinct().withColumn("fault", F.lit("too long"))
    return outside.union(back).union(deep)


def prefixes(code: Column, shortest: int = 1) -> Column:
    """Every prefix of a code, shortest first: what turns a prefix join into an equi-join."""
    return F.when(F.length(code) >= shortest, F.transform(F.sequence(F.lit(shortest), F.length(code)), lambda n: F.substring(code, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def class_paths(coded: DataFrame, concepts: DataFrame) -> DataFrame:
    """(cid, path, fault): segments of the concepts(code, segment) at every prefix of each class code, broadest first.

    fault: `no-class` where no prefix has a concept, `contested` where a code has two names; path is null then.
    """
    met = coded.select("cid", F.explode(prefixes(F.col("code"))).alias("code")).join(concepts.select("code", "segment").distinct(), "code")
    per_code = met.groupBy("cid", "code").agg(F.countDistinct("segment").alias("n"), F.min("segment").alias("segment"))
    paths = per_code.groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(F.length("code").alias("len"), "segment"))), lambda x: x["segment"]).alias("path"))
    out = coded.select("cid").distinct().join(paths, "cid", "left")
    fault = F.when(F.col("n").isNull(), "no-class").when(F.col("n") > 1, "contested")
    return out.select("cid", F.when(fault.isNull(), F.col("path")).alias("path"), fault.alias("fault"))


def singular_paths(singulars: DataFrame, concepts: DataFrame) -> DataFrame:
    """(cid, path): the class path of the outermost whole, then names from it down to the singular(cid, part_of, code, segment)."""
    met = chains(singulars)
    own = singulars.select(F.col("cid").alias("whole"), "code", "segment")
    joined = met.join(own, "whole")
    names = joined.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "segment"))), lambda x: x["segment"]).alias("names"), F.max_by("code", "depth").alias("code"))
    found = class_paths(names.select("cid", "code"), concepts)
    return names.join(found, "cid").select("cid", F.concat("path", "names").alias("path"), "fault")


def about(cells: DataFrame, columns: DataFrame, concepts: DataFrame, depends: DataFrame) -> DataFrame:
    """(cid, row, singular, concept, segment, value): facts that claims' tables state of singulars.

    cells(cid, row, col, value), columns(cid, col, role, concept) with one `about` column; a concept(cid, segment)
    counts if the claim depends on it and its name is unique among those.
    """
    subject = cells.join(columns.filter("role = 'about'").select("cid", "col"), ["cid", "col"]).select("cid", "row", F.col("value").alias("singular"))
    allowed = depends.select("cid", F.col("dep").alias("concept")).join(concepts.select(F.col("cid").alias("concept"), "segment"), "concept")
    unique = F.count(F.lit(1)).over(Window.partitionBy("cid", "segment"))
    named = allowed.distinct().withColumn("n", unique).filter("n = 1").select("cid", "concept", "segment")
    values = cells.join(columns.filter("concept IS NOT NULL").select("cid", "col", "concept"), ["cid", "col"]).select("cid", "row", "concept", "value")
    return values.join(subject, ["cid", "row"]).join(named, ["cid", "concept"]).select("cid", "row", "singular", "concept", "segment", "value")


def current(facts: DataFrame, heads: DataFrame) -> DataFrame:
    """Facts whose claim is a head(cid)."""
    return facts.join(heads.select("cid").distinct(), "cid", "left_semi")


def lookup(facts: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """Facts for a dotted path: a singular's whole path, or one followed by a concept's segment."""
    dotted = paths.select(F.col("cid").alias("singular"), F.array_join("path", ".").alias("at"))
    head, _, last = path.rpartition(".")
    return facts.join(dotted, "singular").filter((F.col("at") == path) | ((F.col("at") == head) & (F.col("segment") == last)))


def located(singulars: DataFrame) -> DataFrame:
    """(cid, cell): the cell of the nearest whole that has one, itself included, of singulars(cid, part_of, cell)."""
    met = chains(singulars).join(singulars.filter("cell IS NOT NULL").select(F.col("cid").alias("whole"), "cell"), "whole")
    return met.groupBy("cid").agg(F.min_by("cell", "depth").alias("cell"))


def inside(places: DataFrame, areas: DataFrame) -> DataFrame:
    """(cid, area) for places(cid, cell) within areas(area, cell): an equi-join on the ancestor at each area's resolution."""
    wanted = areas.select("area", F.col("cell").alias("outer")).withColumn("r", h3.resolution(F.col("outer")))
    levels = F.explode(F.sequence(F.lit(0), h3.resolution(F.col("cell"))))
    up = places.select("cid", "cell", levels.alias("r")).select("cid", "r", h3.parent_at(F.col("cell"), F.col("r")).alias("outer"))
    return up.join(wanted, ["r", "outer"]).select("cid", "area")


def status(value: Column, describes: Column, grounded: Column, open_count: Column) -> Column:
    """What a fact is worth: no value or open annotations ask for a check; an exact grounded one is confirmed."""
    return (
        F.when(value.isNull(), "to-verify")
        .when(open_count > 0, "to-verify")
        .when((describes == "exact") & grounded, "confirmed")
        .when(describes == "exact", "to-verify")
        .otherwise("estimate")
    )
