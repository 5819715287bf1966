"""Mixing sources to target weights by Poisson replication.

Each document is repeated a number of times drawn from a Poisson distribution whose mean is its source's target
repetition rate; the draw inverts the distribution at a hash of seed and document, so a run can be repeated exactly.
Copies then go out in the order of a second hash, dealt globally.

Null source: a source of its own. Null ids: one id. Rows with equal ids draw the same count, so repeated rows stay
together. A weight of 0 yields nothing of its source; an empty table yields nothing. Ties of the
shuffle key (one in 2^60) go by id and copy. Extra columns are carried; `copy` and `mix_key` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved

#: Hexadecimal digits that make a uniform number, exact in a double.
DIGITS = 13
#: Largest mean of one draw. A sum of independent Poisson draws is one of their means' sum, so larger rates take several.
MOST = 500.0
#: Copies of a row that are made at once.
COPIES = 1000
#: Most sources whose tables (some 300 bytes each, 6 KB at the largest rates) are broadcast.
BROADCAST_SOURCES = 2000

#: Target weights of the mixture, before scaling: the hot source counts twice, every other one, named here or not, once.
MIX_WEIGHTS = {"src0": 2.0}
OTHERS = 1.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(DIGITS)), 16, 10).cast("bigint").cast("double") / float(16**DIGITS)


def poisson_cdf(rate: Column) -> Column:
    """Distribution function at 0, 1, ... as an array, up to 12 deviations and 20 above the mean, where less is left than
    a uniform number of 52 bits can tell from 1; rates up to MOST."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda a, k: let(a["p"] * rate / k, lambda p: F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c")))
    return F.aggregate(F.sequence(F.lit(1), top), start, step)["c"]


def source_rates(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", epochs: float = 1.0, others: float = OTHERS) -> DataFrame:
    """A row per source: its documents and the mean repetition rate that gives it its share of epochs * rows.

    weights: target weight by source; others: that of a source without one. They are scaled to sum to 1 over the sources
    present.
    """
    counts = df.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_rows"))
    given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in sorted((weights or {}).items())], "mix_source string, w double")
    weighed = counts.join(given, "mix_source", "left").fillna(float(others), ["w"])
    sums = weighed.agg(F.struct(F.sum("w").alias("w"), F.sum("mix_rows").alias("rows"))).scalar()
    rate = F.when(sums["w"] > 0, F.col("w") / sums["w"] * sums["rows"] * F.lit(float(epochs)) / F.col("mix_rows")).otherwise(0.0)
    return weighed.select("mix_source", "mix_rows", rate.alias("mix_rate"))


def mix(df: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", seed: str = "0", epochs: float = 1.0, others: float = OTHERS) -> DataFrame:
    """df with each row repeated by its draw, plus `copy` (from 0) and `mix_key`, sorted globally by mix_key.

    A rate above MOST is the sum of as few equal draws as keep to it, each at a hash of its own.
    """
    rates = source_rates(df, weights, source, epochs, others)
    draws = F.greatest(F.ceil(F.col("mix_rate") / MOST), F.lit(1)).cast("int")
    rates = saved(rates.select("mix_source", draws.alias("mix_draws"), poisson_cdf(F.col("mix_rate") / draws).alias("mix_cdf")), "rates").rows
    if rates.count() <= BROADCAST_SOURCES:  # else the join deals documents by source, and Spark splits the hot ones
        rates = F.broadcast(rates)
    docs = df.drop("copy", "mix_key")
    kept = docs.columns
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    drawn = docs.join(rates, docs[source].eqNullSafe(rates["mix_source"]))
    draw = lambda u: let(u, lambda v: F.size(F.filter("mix_cdf", lambda c: c <= v)).cast("long"))
    further = lambda j: draw(uniform(seed, j.cast("string"), ident))
    count = F.when(F.col("mix_draws") == 1, draw(uniform(seed, ident))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("mix_draws")), F.lit(0).cast("long"), lambda a, j: a + further(j)))
    columns = [F.col(f"`{c}`") for c in kept]
    some = drawn.withColumn("mix_n", count).filter("mix_n > 0").select(*columns, "mix_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(mix_n - 1) div {COPIES}"))).alias("mix_k"))
    copies = some.select(*columns, F.explode(F.sequence((F.col("mix_k") * COPIES).cast("int"), (F.least("mix_n", (F.col("mix_k") + 1) * COPIES) - 1).cast("int"))).alias("copy"))
    keyed = copies.withColumn("mix_key", F.substr(F.md5(F.concat_ws(":", F.lit("shuffle"), F.lit(seed), ident, F.col("copy"))), F.lit(1), F.lit(15)))
    return keyed.orderBy("mix_key", key, "copy")
