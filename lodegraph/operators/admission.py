"""Checks before something is filed: translations, new edges, claims without sources, requirements, domains, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lint, versions
from ..model import FIDELITIES, PROHIBITIONS, TRANSLATION_METHODS, labelled
from .domains import missing_depends, missing_equivalents

#: The relations besides depends under which a domain may be closed.
CLOSURES = ("translates", "equivalent")


def translation_fault(method: Column, fidelity: Column) -> Column:
    """What a translation lacks: a known method, then a known fidelity; null if nothing."""
    known = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    return (
        F.when(method.isNull(), "method required")
        .when(~known(method, TRANSLATION_METHODS), "unknown method")
        .when(fidelity.isNull(), "fidelity required")
        .when(~known(fidelity, FIDELITIES), "unknown fidelity")
    )


def edge_note(kind: Column, src: Column, dst: Column) -> Column:
    """What a new edge of an acyclic kind means, in words; empty for other kinds."""
    return (
        F.when(kind == "supersedes", F.concat(src, F.lit(" now stands ahead of "), dst, F.lit(" in its lineage")))
        .when(kind == "depends", F.concat(src, F.lit(" can't be judged without "), dst))
        .when(kind == "derived-from", F.concat(src, F.lit(" copies or adapts "), dst))
        .when(kind == "implements", F.concat(src, F.lit(" implements "), dst))
        .otherwise(F.lit(""))
    )


def warnings(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(cid, test, detail): findings on claims(cid, content, has_data), and data of which no row of sources(cid) names an origin."""
    found = claims.select("cid", F.explode_outer(lint.findings(F.col("content"))).alias("f")).filter("f IS NOT NULL").select("cid", "f.test", "f.detail")
    bare = claims.filter("has_data").select("cid").join(sources.select("cid").distinct(), "cid", "left_anti")
    return found.union(bare.select("cid", F.lit("source"), F.lit("data without a source")))


def well_formed(requirement: Column) -> Column:
    """Dot-separated numbers, with a caret before or a plus behind."""
    return F.coalesce(requirement.rlike(r"^(\^[0-9]+(\.[0-9]+)*|[0-9]+(\.[0-9]+)*\+?)\z"), F.lit(False))


def _stated(text: Column) -> Column:
    """A line without its comment and outer blanks; null if nothing is left."""
    return F.nullif(F.trim(F.substring_index(text, "#", 1)), F.lit(""))


def requirements(asked: DataFrame, declared: DataFrame, version: str) -> DataFrame:
    """(dir, requirement, stated_in, status): the nearest requirement at or above each asked(dir), and whether version meets it.

    declared(dir, config, file): a folder's own settings go before its version file. Folders are slash-separated. Each
    folder asked for is joined with its ancestors, as many rows as it has levels. status: none, ill-formed, met, unmet.
    """
    parts = F.split("dir", "/")
    above = asked.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("at"))
    own = declared.select(F.col("dir").alias("at"), F.coalesce(_stated(F.col("config")), _stated(F.col("file"))).alias("requirement"), F.when(_stated(F.col("config")).isNotNull(), "config").otherwise("file").alias("kind")).filter("requirement IS NOT NULL")
    met = above.join(own, "at").groupBy("dir").agg(F.max_by(F.struct("requirement", "at", "kind"), F.length("at")).alias("r"))
    found = asked.select("dir").distinct().join(met, "dir", "left").select("dir", F.col("r.requirement").alias("requirement"), F.concat_ws("/", "r.at", "r.kind").alias("stated_in"))
    status = F.when(F.col("requirement").isNull(), "none").when(~well_formed(F.col("requirement")), "ill-formed").when(versions.satisfies(F.lit(version), F.col("requirement")), "met").otherwise("unmet")
    return found.select("dir", "requirement", F.nullif("stated_in", F.lit("")).alias("stated_in"), status.alias("status"))


def domain_faults(members: DataFrame, depends: DataFrame, relations: DataFrame, bound: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(rule, cid, amount): why members(cid, size) can't make a domain; no row if they can.

    What they rest on but lack; what the relations named by `also` join to them and they lack; and their bytes in
    `amount` (cid null) where these exceed the bound. depends(cid, dep), relations(kind, src, dst).
    """
    unknown = set(also) - set(CLOSURES)
    if unknown:
        raise ValueError(f"a domain can't be closed under {sorted(unknown)}")
    none = F.lit(None)
    found = missing_depends(members, depends).select(F.lit("depends").alias("rule"), "cid", none.cast("bigint").alias("amount"))
    for kind in also:
        lacking = missing_equivalents(members, relations.filter(F.col("kind") == kind))
        found = found.union(lacking.select(F.lit(kind), "cid", none.cast("bigint")))
    size = members.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("amount")).filter(F.col("amount") > bound)
    return found.union(size.select(F.lit("bound"), none.cast(members.schema["cid"].dataType), "amount"))


def filled(text: Column, values: dict[str, Column]) -> Column:
    """The text with each {name} replaced by its column; null where a brace pair is left, so no other name passes."""
    out = text
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.when(~(F.contains(out, F.lit("{")) & F.contains(out, F.lit("}"))), out)


def prohibition_reason(name: Column) -> Column:
    return labelled(name, PROHIBITIONS)
