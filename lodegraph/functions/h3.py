"""Hexagonal cell identifiers by bit arithmetic on BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cell format.
FINEST = 15
BASE_CELLS = 122
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
CELL_MODE = 1
UNUSED = 7


def _bits(cell: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(cell, shift).bitwiseAND(F.lit(mask).cast("bigint"))


def resolution(cell: Column) -> Column:
    return _bits(cell, 52, 0xF).cast("int")


def base_cell(cell: Column) -> Column:
    return _bits(cell, 45, 0x7F).cast("int")


def digit(cell: Column, level: int) -> Column:
    return _bits(cell, (FINEST - level) * 3, 0x7).cast("int")


def digits(cell: Column) -> Column:
    """The fifteen digits, coarsest first."""
    return F.array(*[digit(cell, r) for r in range(1, FINEST + 1)])


def is_valid(cell: Column) -> Column:
    """Whether the bits name a cell: mode, reserved bits, base cell, digits used up to the resolution, no deleted direction."""
    return F.element_at(F.transform(F.array(cell), _is_valid), 1)  # the lambda holds the bits, however they were made


def _is_valid(cell: Column) -> Column:
    used = F.lit(True)
    for r in range(1, FINEST + 1):
        used = used & ((resolution(cell) >= r) != (digit(cell, r) == UNUSED))
    leading = F.get(F.filter(F.slice(digits(cell), F.lit(1), resolution(cell)), lambda d: d != 0), F.lit(0))
    deleted = base_cell(cell).isin(*PENTAGONS) & F.coalesce(leading == 1, F.lit(False))
    return (cell >= 0) & (_bits(cell, 59, 0xF) == CELL_MODE) & (_bits(cell, 56, 0x7) == 0) & (base_cell(cell) < BASE_CELLS) & used & ~deleted


def is_pentagon(cell: Column) -> Column:
    return base_cell(cell).isin(*PENTAGONS) & F.forall(F.slice(digits(cell), F.lit(1), resolution(cell)), lambda d: d == 0)


def parent_at(cell: Column, level: Column) -> Column:
    """The ancestor at a resolution: digits beyond it blank; null where that is finer than the cell."""
    level = level.cast("bigint")
    kept = cell.bitwiseAND(F.lit(~(0xF << 52)).cast("bigint")).bitwiseOR(level * (1 << 52))
    blank = F.call_function("shiftleft", F.lit(1).cast("bigint"), ((FINEST - level) * 3).cast("int")) - 1
    return F.when(resolution(cell) >= level, kept.bitwiseOR(blank))


def parent(cell: Column, level: int) -> Column:
    return parent_at(cell, F.lit(level))


def contains(outer: Column, inner: Column) -> Column:
    return F.coalesce(parent_at(inner, resolution(outer)) == outer, F.lit(False))


def parse(text: Column) -> Column:
    """The bits of a canonical spelling (lower case, no leading zero, up to 16 digits); null for any other."""
    canonical = text.rlike("^[1-9a-f][0-9a-f]{0,15}$")
    high = F.conv(F.substr(F.lpad(text, 16, "0"), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    low = F.conv(F.substr(F.lpad(text, 16, "0"), F.lit(9), F.lit(8)), 16, 10).cast("bigint")
    return F.when(canonical, F.shiftleft(high, 32).bitwiseOR(low))


def show(cell: Column) -> Column:
    return F.lower(F.hex(cell))
