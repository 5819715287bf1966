"""Personal data in whole texts, by DataFrame functions alone.

Regular expressions propose spans, checksums (Luhn, mod 97) and range rules confirm them, and nearby context words
raise or lower each span's score. Positions come from the pieces between matches: both are found by one left-to-right scan, so
match k starts after the first k + 1 pieces and k matches.

Null text counts as empty and has no spans. Other columns, repeated rows and empty tables pass through; each row is
handled on its own. Patterns are possessive and start only where a run starts, and
context is read from pieces of the text, so time stays linear in long texts. Of IBANs, one that starts inside one of the
eight valid ones before it goes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


class Kind(NamedTuple):
    """Proposal pattern, confirming test (on the matched text), score, and the words that raise or lower it nearby."""

    name: str
    pattern: str
    score: float
    context: str
    against: str = ""


#: Kinds in the order that breaks ties, the contract's four first. A pattern may start inside a run of
#: its first characters only where the last match ended (\G): there, and at the run's start, it matches what the
#: plain pattern would, without trying each later start of a run that leads nowhere. Of an IBAN the pattern takes the
#: head alone and looks at what may follow: `iban_length` says where it ends.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|correo|courriel", r"example|dummy"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"ip|address|host|server|adresse", r"version|release|section|chapter"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"card|visa|credit|payment|tarjeta|carte|karte|kreditkarte", r"tracking|isbn|serial|order|part"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"phone|telephone|tel|call|mobile|fax|telefon", r"order|serial|isbn"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", 0.8, r"iban|account|bank|konto|cuenta|compte", r"dummy|placeholder"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social security", r"lot|part|serial"),
)
BASE = ("email", "ip", "card", "phone")
#: Characters of an IBAN by its country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
}
#: Context: characters looked at on either side for whole words, and what words for and against add to a score.
REACH, BONUS, MALUS = 40, 0.35, 0.35
#: Code points of the pieces that a text is cut into, so that a place in it is found without a scan from its start.
PIECE = 1000
#: A span that isn't one of the base kinds needs this score.
MIN_SCORE = 0.5
#: Longest run of prefix sums in one fold, which copies what it has so far.
CHUNK = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: F.conv(F.when(c == "", "0").otherwise(c), 10, 10).cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN (blanks allowed) has remainder 1 modulo 97, letters counting from 10."""
    packed = F.translate(text, " ", "")
    turned = F.concat(F.substr(packed, F.lit(5)), F.substr(packed, F.lit(1), F.lit(4)))
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(letters, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.length(packed).between(15, 34) & (rest == 1)


def iban_length(text: Column) -> Column:
    """Characters of the IBAN that starts a text, 0 if none does: it ends at a token border, at its country's length
    where a valid one does, otherwise at the last border up to which it is valid."""
    head = lambda p: F.substr(text, F.lit(1), p)
    at = lambda p: F.substr(text, p, F.lit(1))
    valid = F.filter(F.sequence(F.lit(15), F.greatest(F.length(text), F.lit(15))), lambda p: at(p).rlike("[A-Z0-9]") & ~at(p + 1).rlike("[A-Za-z0-9]") & mod97(head(p)))
    country = F.substr(text, F.lit(1), F.lit(2))
    usual = F.coalesce(*[F.when(country.isin(*names.split()), n) for n, names in IBAN_LENGTHS.items()], F.lit(0))
    return let(valid, lambda v: F.coalesce(F.get(F.filter(v, lambda p: F.length(F.translate(head(p), " ", "")) == usual), F.lit(0)), F.array_max(v), F.lit(0)))


def confirmed(kind: str, match: Column) -> Column:
    """The checking rule of a kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(count.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _placed(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind: array of (start, rank, end, score), code points, end exclusive."""

    def spans(pieces: Column, matches: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("m")))

        def chunked(s: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda k: F.slice(s, k * CHUNK + 1, CHUNK))

            def summed(ps: Column) -> Column:
                totals = F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
                start = lambda t, k: F.aggregate(F.slice(t, 1, k), F.lit(0), lambda a, x: a + x)
                ends = lambda p, base: F.aggregate(
                    p,
                    F.struct(base.alias("at"), F.array().cast("array<int>").alias("ends")),
                    lambda a, x: let(a["at"] + x["gap"] + x["len"], lambda e: F.struct(e.alias("at"), F.concat(a["ends"], F.array(e)).alias("ends"))),
                )["ends"]
                return let(totals, lambda t: F.flatten(F.transform(ps, lambda p, k: F.zip_with(p, ends(p, start(t, k)), lambda x, e: F.struct((e - x["len"]).alias("start"), e.alias("end"), x["m"].alias("m"))))))

            return let(parts, summed)

        return let(steps, chunked)

    def ended(s: Column) -> Column:
        """Heads of IBANs made spans of whole ones, of which none starts inside another."""
        tails = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))
        whole = lambda x, w: let(iban_length(w), lambda n: F.struct(x["start"].alias("start"), (x["start"] + n).alias("end"), F.substr(w, F.lit(1), n).alias("m")))
        valid = F.filter(F.zip_with(s, tails, lambda x, t: let(F.concat(x["m"], t), lambda w: whole(x, w))), lambda x: x["end"] > x["start"])
        inside = lambda v, x, i: F.exists(F.slice(v, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8))), lambda y: y["end"] > x["start"])
        return let(valid, lambda v: F.filter(v, lambda x, i: ~inside(v, x, i)))  # one that holds the start is among the 8 before

    def scored(good: Column, cut: Column) -> Column:
        at = lambda p: F.floor(p / PIECE).cast("int")
        part = lambda p, n: F.substr(F.concat(F.coalesce(F.get(cut, at(p)), F.lit("")), F.coalesce(F.get(cut, at(p) + 1), F.lit(""))), p - at(p) * PIECE + 1, n)
        near = lambda x: F.concat_ws("\n", part(F.greatest(x["start"] - REACH, F.lit(0)), F.least(x["start"], F.lit(REACH))), part(x["end"], F.lit(REACH)))
        moved = lambda t, words, by: F.when(t.rlike(rf"(?i)\b(?:{words})\b"), by).otherwise(0.0) if words else F.lit(0.0)
        score = lambda t: F.least(F.lit(1.0), F.lit(kind.score) + moved(t, kind.context, BONUS) - moved(t, kind.against, MALUS))
        return F.transform(good, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], let(near(x), score).alias("score")))

    def kept(s: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        good = F.filter(s, lambda x: confirmed(kind.name, x["m"]))
        scored_ = let(good, lambda g: F.when(F.size(g) == 0, empty).otherwise(let(pieces, lambda c: scored(g, c))))
        return scored_ if kind.name in BASE else F.filter(scored_, lambda x: x["score"] >= MIN_SCORE)

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,score:double>>")
    placed = lambda ms: (ended if kind.name == "iban" else lambda s: s)(spans(F.split(text, kind.pattern, -1), ms))
    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda ms: F.when(F.size(ms) == 0, empty).otherwise(let(placed(ms), kept)))
    return F.coalesce(found, empty)


def pii_spans(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """df plus `pii`: array of (kind, start, end, score) by start, then kind in the order of the table.

    A column `pii` that df has already is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    marks = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
    out = df.drop("pii")
    every = []
    for rank, k in enumerate(kinds):
        spans = _placed(t, k, rank)
        if k.name in marks:  # a text without the character that every match has needs no scan
            spans = F.when(F.instr(t, marks[k.name]) > 0, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,score:double>>"))
        every.append(spans)
    names = F.array(*[F.lit(k.name) for k in kinds])
    ordered = F.array_sort(F.concat(*every))
    return out.withColumn("pii", F.transform(ordered, lambda x: F.struct(names[x["rank"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
