"""Checks of a claim's text: one assertion, one quantity, no reference outside itself, no contested word undeclared.

Patterns use no look-around, so the same ones run in other engines; letters and digits are ASCII where the rule says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that join clauses, openings and phrases that point elsewhere, and the size limit in bytes.
COORDINATORS = (" and ", " but ", " whereas ", " while ")
OPENERS = ("it ", "this ", "that ", "these ", "those ", "they ", "he ", "she ")
BACKREFERENCES = ("the former", "the latter", "the above", "as mentioned")
CEILING = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joining(text: Column) -> Column:
    """The first coordinator that may join two clauses, null if none; `while ...ing` doesn't count."""
    return _let(F.lower(text), _joining)


def _joining(low: Column) -> Column:
    tests = F.lit(None).cast("string")
    for c in reversed(COORDINATORS):
        found = F.contains(low, F.lit(c))
        if c == " while ":
            after = F.slice(F.split(low, c), 2, 1 << 30)
            found = found & F.exists(after, lambda p: ~F.coalesce(F.regexp_extract(p, r"^\s*(\S*)", 1).rlike(r"ing[^\p{L}\p{N}]*$"), F.lit(False)))
        tests = F.when(found, F.lit(c.strip())).otherwise(tests)
    return tests


def sentences(text: Column) -> Column:
    """Runs that end at . ? or ! (a point between digits doesn't end one), a last run without an end included."""
    whole = F.regexp_replace(F.regexp_replace(text, r"([0-9])\.([0-9])", "$1_$2"), r"([0-9])\.([0-9])", "$1_$2")
    return F.size(F.filter(F.split(whole, r"[.?!]"), lambda s: s.rlike(r"\S"))).cast("int")


def quantities(text: Column) -> Column:
    """Digit runs, points and commas joined, in tokens where no letter touches a digit."""
    touching, number = "[A-Za-z][0-9]|[0-9][A-Za-z]", F.lit("[0-9][0-9.,]*")
    tokens = F.filter(F.split(text, r"\s+"), lambda t: ~t.rlike(touching))
    return F.when(text.rlike(touching), F.regexp_count(F.array_join(tokens, " "), number)).otherwise(F.regexp_count(text, number))


def opening(text: Column) -> Column:
    """The opener that the text begins with, null if none."""
    longest = max(map(len, OPENERS))
    start = F.lower(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, longest))
    return _let(start, lambda s: F.coalesce(*[F.when(F.startswith(s, F.lit(o)), F.lit(o.strip())) for o in OPENERS]))


def backreference(text: Column) -> Column:
    return _let(F.lower(text), _backreference)


def _backreference(low: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(low, F.lit(b)), F.lit(b)) for b in BACKREFERENCES])


def mentions(text: Column, word: Column) -> Column:
    """Whether a word stands in the lower-case text with no letter or digit at either side."""
    outside = r"[^\p{L}\p{N}]"
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    hit = lambda low: F.contains(low, word) & F.rlike(low, F.concat(F.lit(f"(^|{outside})"), quoted, F.lit(f"($|{outside})")))
    return F.when(word == "", F.lit(False)).otherwise(_let(F.lower(text), hit))


def findings(text: Column, atomic: Column | None = None, undeclared: Column | None = None) -> Column:
    """Array of (test, detail). undeclared: array of contested words that the claim doesn't depend on."""
    atomic = F.lit(True) if atomic is None else atomic
    one = lambda test, detail, when: F.when(when, F.struct(F.lit(test).alias("test"), detail.alias("detail")))
    facts = _let(F.lower(text), lambda low: F.struct(_joining(low).alias("joins"), sentences(text).alias("n"), quantities(text).alias("q"), opening(text).alias("opens"), _backreference(low).alias("back"), F.octet_length(text).alias("size")))

    def listed(x: Column) -> Column:
        return F.array_compact(
            F.array(
                one("size", F.concat(x["size"].cast("string"), F.lit(" bytes")), x["size"] > CEILING),
                one("single-assertion", x["joins"], atomic & x["joins"].isNotNull()),
                one("single-assertion", F.concat(x["n"].cast("string"), F.lit(" sentences")), atomic & (x["n"] > 1)),
                one("single-quantity", F.concat(x["q"].cast("string"), F.lit(" quantities")), atomic & (x["q"] > 1)),
                one("dangling-anaphora", x["opens"], x["opens"].isNotNull()),
                one("dangling-anaphora", x["back"], x["back"].isNotNull()),
            )
        )

    found = F.element_at(F.transform(F.array(facts), listed), 1)  # the lambda holds each fact, so it is made once
    if undeclared is not None:
        words = F.filter(undeclared, lambda w: mentions(text, w))
        found = F.concat(found, F.transform(words, lambda w: F.struct(F.lit("undeclared-term").alias("test"), w.alias("detail"))))
    empty = F.array(F.struct(F.lit("non-empty").alias("test"), F.lit("content is empty").alias("detail")))
    return F.when(text.rlike(r"\S"), found).otherwise(empty)
