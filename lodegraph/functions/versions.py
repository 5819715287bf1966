"""Version requirements: a caret, a minimum (`X+`), or a prefix that ends at a dot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = r"^[0-9]{1,18}(\.[0-9]{1,18})*$"


def parts(version: Column) -> Column:
    """The numbers of a version; null if a part isn't one."""
    return F.when(version.rlike(_NUMBERS), F.transform(F.split(version, r"\."), lambda p: p.cast("bigint")))


def at_least(have: Column, need: Column) -> Column:
    """Part by part; of two equal beginnings the longer is greater."""
    n = F.greatest(F.size(have), F.size(need))
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.coalesce(F.get(have, i), F.lit(-1)).alias("h"), F.coalesce(F.get(need, i), F.lit(-1)).alias("n")))
    first = F.get(F.filter(sides, lambda s: s["h"] != s["n"]), F.lit(0))
    return F.coalesce(first["h"] > first["n"], F.lit(True))


def satisfies(version: Column, requires: Column) -> Column:
    base = F.substr(requires, F.lit(2))
    have, need = parts(version), parts(base)
    fixed = F.coalesce(F.nullif(F.array_position(F.transform(need, lambda p: p != 0), True), F.lit(0)), F.size(need))
    same = F.forall(F.sequence(F.lit(0), (fixed - 1).cast("int")), lambda i: F.coalesce(F.get(have, i), F.lit(0)) == F.get(need, i))
    caret = F.coalesce(same & at_least(have, need), F.lit(False))
    minimum = F.coalesce(at_least(have, parts(F.regexp_replace(requires, r"\+$", ""))), F.lit(False))
    prefix = (requires == "") | (version == requires) | F.startswith(version, F.concat(requires, F.lit(".")))
    return F.when(F.startswith(requires, F.lit("^")), caret).when(F.endswith(requires, F.lit("+")), minimum).otherwise(prefix)
