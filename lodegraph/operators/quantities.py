"""Checks of tables and quantities: shapes, cells, units and derivations; each yields problems rather than raising."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_decimal

#: Base dimensions, and units of the common code for units of measure, with their dimension exponents.
DIMENSIONS = ("length", "mass", "time", "current", "temperature", "amount", "luminosity")
#: Units that take prefixes.
METRIC = {
    "m": "length:1",
    "g": "mass:1",
    "s": "time:1",
    "A": "current:1",
    "K": "temperature:1",
    "mol": "amount:1",
    "cd": "luminosity:1",
    "rad": "",
    "sr": "",
    "Hz": "time:-1",
    "N": "mass:1 length:1 time:-2",
    "Pa": "mass:1 length:-1 time:-2",
    "J": "mass:1 length:2 time:-2",
    "W": "mass:1 length:2 time:-3",
    "C": "current:1 time:1",
    "V": "mass:1 length:2 time:-3 current:-1",
    "F": "mass:-1 length:-2 time:4 current:2",
    "Ohm": "mass:1 length:2 time:-3 current:-2",
    "S": "mass:-1 length:-2 time:3 current:2",
    "Wb": "mass:1 length:2 time:-2 current:-1",
    "T": "mass:1 time:-2 current:-1",
    "H": "mass:1 length:2 time:-2 current:-2",
    "Cel": "temperature:1",
    "lm": "luminosity:1",
    "lx": "luminosity:1 length:-2",
    "Bq": "time:-1",
    "Gy": "length:2 time:-2",
    "Sv": "length:2 time:-2",
    "kat": "amount:1 time:-1",
    "L": "length:3",
    "l": "length:3",
    "ar": "length:2",
    "t": "mass:1",
    "u": "mass:1",
    "bar": "mass:1 length:-1 time:-2",
    "eV": "mass:1 length:2 time:-2",
    "cal": "mass:1 length:2 time:-2",
    "pc": "length:1",
    "bit": "",
    "By": "",
}
#: Units that don't.
PLAIN = {
    "min": "time:1",
    "h": "time:1",
    "d": "time:1",
    "wk": "time:1",
    "mo": "time:1",
    "a": "time:1",
    "deg": "",
    "AU": "length:1",
    "%": "",
    "10*": "",
    "10^": "",
    "[ppth]": "",
    "[ppm]": "",
    "[ppb]": "",
    "[in_i]": "length:1",
    "[ft_i]": "length:1",
    "[yd_i]": "length:1",
    "[mi_i]": "length:1",
    "[nmi_i]": "length:1",
    "[acr_us]": "length:2",
    "[gal_us]": "length:3",
    "[pt_us]": "length:3",
    "[lb_av]": "mass:1",
    "[oz_av]": "mass:1",
    "[degF]": "temperature:1",
    "atm": "mass:1 length:-1 time:-2",
}
PREFIXES = ("Y", "Z", "E", "P", "T", "G", "M", "k", "h", "da", "d", "c", "m", "u", "n", "p", "f", "a", "z", "y", "Ki", "Mi", "Gi", "Ti")

#: A piece of a unit: a bracket or operator, an annotation, or a symbol or factor with its exponent.
_PIECE = re.compile(r"([().\/])|\{([^{}]*)\}|((?:10[*^])|(?:\[[^\[\]{}]+\])|%|[A-Za-z]+|[0-9]+(?![0-9*^]))([+-]?[0-9]+)?")


def _exponents(symbol: str) -> dict[str, int] | None:
    """Dimension exponents of a symbol, with a prefix where it takes one; null if it isn't known."""
    known = PLAIN.get(symbol, METRIC.get(symbol))
    if known is None and symbol.isdigit():
        known = ""
    if known is None:
        known = next((METRIC[symbol[len(p) :]] for p in PREFIXES if symbol.startswith(p) and symbol[len(p) :] in METRIC), None)
    return None if known is None else {k: int(n) for k, n in (x.split(":") for x in known.split())}


def dimension(unit: str | None) -> str | None:
    """Exponents of base dimensions of a unit such as kg.m/s2 or {tray}/(m2.a), as text in order; null if it isn't understood.

    A slash turns the next part alone; annotations in braces are numbers, whatever they follow.
    """
    if not unit:
        return None
    powers = dict.fromkeys(DIMENSIONS, 0)
    signs, sign, open_part, at = [1], 1, True, 0
    while at < len(unit):
        m = _PIECE.match(unit, at)
        if not m:
            return None
        mark, note, symbol, power = m[1], m[2], m[3], m[4]
        if mark == "(" and open_part:
            signs.append(signs[-1] * sign)
            sign = 1
        elif mark == ")" and not open_part and len(signs) > 1:
            signs.pop()
        elif mark == "/" or (mark == "." and not open_part):
            if open_part and at:
                return None
            sign, open_part = (-1 if mark == "/" else 1), True
        elif note is not None:
            open_part = False
        elif symbol and open_part:
            found = _exponents(symbol)
            if found is None:
                return None
            for name, n in found.items():
                powers[name] += signs[-1] * sign * n * int(power or 1)
            open_part = False
        else:
            return None
        at = m.end()
    if open_part or len(signs) > 1:
        return None
    return " ".join(f"{k}:{v}" for k, v in powers.items() if v)


def table_faults(claims: DataFrame) -> DataFrame:
    """(cid, rule) from claims(cid, columns array<string>, rows array<array<string>>)."""
    faults = F.array_compact(
        F.array(
            F.when(F.size("columns") < 1, F.lit("no column")),
            F.when(F.exists("columns", lambda c: c.isNull() | (c == "")), F.lit("column without a name")),
            F.when(F.size(F.array_distinct("columns")) < F.size("columns"), F.lit("column named twice")),
            F.when(F.exists("rows", lambda r: F.size(r) != F.size("columns")), F.lit("row of another width")),
        )
    )
    return claims.select("cid", F.explode(faults).alias("rule"))


def cell_faults(cells: DataFrame) -> DataFrame:
    """(cid, row, col, rule) from cells(cid, row, col, quantity map<string, string>, parameters array<string>): names must be the measure's, values decimals."""
    wrong = F.array_sort(F.map_keys("quantity")) != F.array_sort("parameters")
    text = F.exists(F.map_values("quantity"), lambda v: v.isNull() | ~is_decimal(v))
    rules = F.array_compact(F.array(F.when(wrong, F.lit("parameters differ")), F.when(text, F.lit("not a decimal"))))
    return cells.select("cid", "row", "col", F.explode(rules).alias("rule"))


def unit_faults(columns: DataFrame, kinds: DataFrame) -> DataFrame:
    """(cid, col, rule) from columns(cid, col, unit, kind) and kinds(kind, dimension): the unit must measure the kind.

    Units of another system are unchecked, which is advice and not a refusal.
    """
    measured = F.udf(dimension, "string", useArrow=True)
    distinct = columns.select("unit").filter("unit IS NOT NULL").distinct().withColumn("dim", measured("unit"))  # each unit once
    met = columns.join(distinct, "unit").join(kinds, "kind", "left")
    rule = F.when(F.col("dim").isNull(), "unit unchecked").when(F.col("dimension").isNull(), "kind not held").when(F.col("dim") != F.col("dimension"), "unit doesn't measure kind")
    return met.select("cid", "col", rule.alias("rule"), (rule == "unit doesn't measure kind").alias("rejects")).filter("rule IS NOT NULL")


def derivation_faults(claims: DataFrame, outputs: DataFrame) -> DataFrame:
    """(cid, col): output columns(cid, col, calculation, kind) whose kind isn't that of the calculation's outputs(calculation, kind)."""
    return claims.join(outputs.select("calculation", F.col("kind").alias("made")), "calculation").filter("kind <> made").select("cid", "col")


def concept_faults(columns: DataFrame, depends: DataFrame, concepts: DataFrame) -> DataFrame:
    """(cid, code): codes that columns(cid, code) name without a concept(cid, code) among the claim's depends."""
    held = depends.select("cid", F.col("dep").alias("d")).join(concepts.select(F.col("cid").alias("d"), "code"), "d").select("cid", "code")
    return columns.select("cid", "code").filter("code IS NOT NULL").distinct().join(held, ["cid", "code"], "left_anti")


def fraction_at_most_one(numerator: Column, denominator: Column) -> Column:
    """Exact comparison of a fraction of decimals with 1."""
    return (denominator > 0) & (numerator <= denominator)
