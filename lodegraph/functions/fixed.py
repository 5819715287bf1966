"""Scaled integers: six decimals in a BIGINT, truncated toward zero, x / 0 = 0.

Products must stay below 2^63, which holds for weights up to 9 million units times a share; decimals take over where
sums may be larger (`wide`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000


def div(a: Column, b: Column) -> Column:
    """a / b truncated toward zero, 0 where b is 0."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0))))


def mul_div(a: Column, b: Column, c: Column) -> Column:
    """a * b / c truncated once."""
    return div(a.cast("bigint") * b.cast("bigint"), c.cast("bigint"))


def times(a: Column, b: Column) -> Column:
    """The product of two scaled numbers."""
    return mul_div(a, b, F.lit(SCALE))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a scaled number."""
    return mul_div(a, F.lit(SCALE), b)


def wide(a: Column, b: Column, c: Column) -> Column:
    """mul_div by decimals of 38 digits, for factors whose product may pass 2^63."""
    x, y = a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), c.cast("decimal(19,0)")
    return F.when(y == 0, F.lit(0)).otherwise((x - x % F.nullif(y, F.lit(0))) / F.nullif(y, F.lit(0))).cast("bigint")


def share(a: Column, total: Column) -> Column:
    """ratio by decimals, for whole numbers of up to 30 digits."""
    x, y = a.cast("decimal(30,0)") * F.lit(SCALE).cast("decimal(7,0)"), F.nullif(total.cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)"))
    return F.coalesce(((x - x % y) / y).cast("bigint"), F.lit(0).cast("bigint"))


def halve(value: Column, age: Column, half_life: Column) -> Column:
    """value after age days: whole halvings, then a straight line within the last; half-life 0 leaves it."""
    life = F.nullif(half_life.cast("bigint"), F.lit(0))
    whole = F.call_function("div", age.cast("bigint"), life)
    rest = age.cast("bigint") % life
    halved = F.when(whole >= 63, F.lit(0).cast("bigint")).otherwise(F.call_function("div", value, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(whole, F.lit(62)).cast("int"))))
    return F.when((half_life == 0) | (age == 0), value).otherwise(halved - F.call_function("div", halved * rest, 2 * life))


def show(value: Column) -> Column:
    """Six-decimal text of a scaled number."""
    size = F.abs(value)
    text = F.concat(F.call_function("div", size, F.lit(SCALE)).cast("string"), F.lit("."), F.lpad((size % SCALE).cast("string"), 6, "0"))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)
