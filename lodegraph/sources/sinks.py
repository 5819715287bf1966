"""Sinks: rows as JSON lines, bundles of one document per object, and maps of corpora in three notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as one JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)


def bundle(objects: DataFrame, depends: DataFrame, cited: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, document): a JSON document per object, with what it rests on, what names it, and its terms."""
    rests = depends.groupBy("cid").agg(F.array_sort(F.collect_set("dep")).alias("rests_on"))
    used = cited.groupBy(F.col("target").alias("cid")).agg(F.array_sort(F.collect_set(F.struct("how", "source"))).alias("used_by"))
    named = terms.groupBy("cid").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    whole = objects.join(rests, "cid", "left").join(used, "cid", "left").join(named, "cid", "left")
    return whole.select(file_name(F.col("cid")).alias("name"), F.to_json(F.struct(*[F.col(c) for c in whole.columns if c != "bytes"])).alias("document"))


def edge_lines(edges: DataFrame, notation: str) -> Column:
    """A line of a graph for each edge (src, dst) in mermaid or dot."""
    if notation == "mermaid":
        return F.concat(F.lit("  "), "src", F.lit(" --> "), "dst")
    if notation == "dot":
        return F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";'))
    raise ValueError(f"unknown notation {notation}")


def corpus_map(edges: DataFrame, notation: str) -> DataFrame:
    """(line_no, line) of a citation map in mermaid, dot or json, edges in order."""
    if notation == "json":
        return json_lines(edges.select("src", "dst").distinct().orderBy("src", "dst"))
    return edges.select("src", "dst").distinct().orderBy("src", "dst").select(edge_lines(edges, notation).alias("value"))


def member_name(cid: Column) -> Column:
    """The file name of an exported object."""
    return F.concat(F.replace(cid, F.lit(":"), F.lit("_")), F.lit(".cbor"))
