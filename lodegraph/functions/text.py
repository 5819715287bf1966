"""Names, labels, identifiers and grammar checks on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CID = r"^pub:sha2-256:[a-z2-7]{51}[aq]$"
CID_ANYWHERE = r"pub:sha2-256:[a-z2-7]{52}"


def segment(name: Column) -> Column:
    """A path segment: lower case, what isn't letter or digit as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def term(content: Column, own: Column | None = None, ext: Column | None = None) -> Column:
    """The defined term: the definition's own, else the annotated one, else the text before a colon and a bracket."""
    cut = F.trim(F.lower(F.substring_index(F.substring_index(content, ":", 1), "(", 1)))
    given = [F.lower(F.trim(c)) for c in (own, ext) if c is not None]
    return F.coalesce(*given, cut)


def shorten(text: Column, limit: int = 110) -> Column:
    """A label: blanks folded, cut at a word with an ellipsis if it is longer than limit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.regexp_replace(F.substring(flat, 1, limit), r"\s+\S*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(head, F.lit("…")))


def is_cid(text: Column) -> Column:
    """Prefix, algorithm, lower-case base32 and zero padding bits."""
    return text.rlike(CID)


def cids_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CID_ANYWHERE), F.lit(0))))


def is_decimal(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]+(\.[0-9]+)?$")


def is_tag(text: Column) -> Column:
    """<3-6 letters>-<6 letters>-MM-YYYY."""
    return text.rlike(r"^[a-z]{3,6}-[a-z]{6}-(0[1-9]|1[0-2])-[0-9]{4}$")


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")


def file_name(name: Column) -> Column:
    """A bundle file name: slashes as underscores, the rest percent-encoded."""
    return F.replace(F.url_encode(F.replace(name, F.lit("/"), F.lit("_"))), F.lit("+"), F.lit("%20"))


def cell_text(kind: Column, text: Column, number: Column, quantity: Column) -> Column:
    """A table cell as text; a quantity as "name value, ..."."""
    entries = F.transform(F.array_sort(F.map_entries(quantity)), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.when(kind == "text", text).when(kind == "int", number.cast("string")).when(kind == "quantity", F.array_join(entries, ", ")).otherwise(F.lit(""))


def epoch_of(instant: Column) -> Column:
    """Unix seconds of an RFC 3339 instant in UTC; null if it isn't one."""
    good = instant.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return F.when(good, F.unix_timestamp(F.try_to_timestamp(instant, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Whether two periods of text bounds meet, both ends included; an open bound is "" below and "~" above."""
    low = lambda c: F.coalesce(c, F.lit(""))
    high = lambda c: F.coalesce(c, F.lit("~"))
    return (low(from_a) <= high(to_b)) & (low(from_b) <= high(to_a))


def signing_message(domain: str, purpose: Column, body: Column) -> Column:
    """domain, NUL, purpose, NUL, bytes; null where the purpose holds a NUL."""
    nul = F.unhex(F.lit("00"))
    return F.when(~F.contains(purpose, F.lit("\0")), F.concat(F.lit(domain).cast("binary"), nul, purpose.cast("binary"), nul, body))
