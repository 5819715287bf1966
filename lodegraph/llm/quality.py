"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null text counts as empty. Nulls in other columns, extra columns, repeated rows and empty tables pass through
unchanged; every row is judged on its own, so ties cannot arise. Very long texts are handled in linear space.

Stop words are listed for English, French, German and Spanish alone. Where df has a column `lang`, their share is judged
only in rows whose language is one of those (en-US counts as en; null as none); without it, in every row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words_of

#: Words in a repeat window.
WINDOW = 8
#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "it", "on", "by", "this", "was", "are", "as"),
    "fr": ("le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "pour", "par", "sur", "dans", "est", "au"),
    "de": ("der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "des", "im", "ein", "eine", "für", "auf", "nicht", "als", "sich"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se", "al", "es", "lo"),
}


class Rule(NamedTuple):
    """A document fails where measure is below least or above most; it applies from min_words words on."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0


#: What `measured` makes.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_upper", "n_bullet", "n_ellipsis")
RATIOS = ("mean_word_chars", "symbol_ratio", "stop_ratio", "upper_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")
#: The production table. Measures are fields of what `measured` makes.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", "symbol_ratio", most=0.3),
    Rule("stop_word_share", "stop_ratio", least=0.01, min_words=50),
    Rule("duplicate_line_share", "dup_line_ratio", most=0.5),
    Rule("upper_case_share", "upper_ratio", most=0.5),
    Rule("bullet_line_share", "bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_share", "ellipsis_line_ratio", most=0.5),
)


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of `width` at the sorted `starts` (not empty)."""
    following = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.element_at(starts, -1) + width))
    return F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(width))), F.lit(0), lambda x, y: x + y)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur at least twice in the array, first occurrences included.

    Words are compared by 64-bit hash; windows by a 64-bit hash of those to see whether any repeats, and by
    96 bits to say which.
    """

    def window(codes: Column, i: Column, hashed: Callable[..., Column]) -> Column:
        return hashed(*[F.get(codes, i + k) for k in range(width)])

    def firsts(codes: Column) -> Column:
        return F.sequence(F.lit(0), F.size(codes) - width)

    def starts(codes: Column) -> Column:
        keyed = F.array_sort(F.transform(firsts(codes), lambda i: F.struct(window(codes, i, F.xxhash64).alias("x"), window(codes, i, F.hash).alias("y"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda j: (s[j - 1]["x"] == s[j]["x"]) & (s[j - 1]["y"] == s[j]["y"])
            n = F.size(s)
            hit = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.when(j > 0, same(j)).otherwise(False) | F.when(j + 1 < n, same(j + 1)).otherwise(False))
            return F.array_sort(F.transform(hit, lambda j: s[j]["i"]))

        return let(keyed, repeated)

    def counted(codes: Column) -> Column:
        hashes = F.transform(firsts(codes), lambda i: window(codes, i, F.xxhash64))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(let(starts(codes), lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(_covered(s, width))))

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), counted)).cast("long")


def measured(text: Column) -> Column:
    """Struct of the raw counts and the ratios of a text that rules refer to; words and lines are made once."""
    t = F.coalesce(text, F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    with_word = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)

    def counted(words: Column, lines: Column) -> Column:
        raw = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(words),
            "n_stop": F.size(F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*stop))),
            "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
            "n_bullet": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
            "n_ellipsis": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09]*$"))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in raw.items()])

    def rated(c: Column) -> Column:
        ratios = {
            "mean_word_chars": share(c["word_chars"], c["n_words"]),
            "symbol_ratio": share(c["n_symbols"], c["n_words"]),
            "stop_ratio": share(c["n_stop"], c["n_words"]),
            "upper_ratio": share(c["n_upper"], c["word_chars"]),
            "dup_line_ratio": share(c["n_dup_lines"], c["n_lines"]),
            "bullet_line_ratio": share(c["n_bullet"], c["n_lines"]),
            "ellipsis_line_ratio": share(c["n_ellipsis"], c["n_lines"]),
        }
        return F.struct(*[c[k].alias(k) for k in COUNTS], *[v.alias(k) for k, v in ratios.items()])

    return let(let(words_of(text), lambda w: let(with_word, lambda x: counted(w, x))), rated)


def listed(df: DataFrame, lang: str = "lang") -> Column:
    """Whether a row's language has stop words; true if df doesn't say."""
    if lang not in df.columns:
        return F.lit(True)
    return F.coalesce(F.lower(F.regexp_extract(F.col(lang), "^[A-Za-z]+", 0)).isin(*STOP_WORDS), F.lit(False))


def compiled(rules: tuple[Rule, ...], m: Column, has_list: Column | None = None) -> Column:
    """Array of the names of the rules that a struct of measures fails; those on stop words hold where has_list does."""
    tests = []
    for r in rules:
        bad = F.lit(False)
        bad = bad | (m[r.measure] < r.least) if r.least is not None else bad
        bad = bad | (m[r.measure] > r.most) if r.most is not None else bad
        if has_list is not None and r.measure in ("stop_ratio", "n_stop"):
            bad = bad & has_list
        tests.append(F.when(bad & (m["n_words"] >= r.min_words), F.lit(r.name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def base_failed(m: Column, min_words: int = 20, repeat_percent: int = 30) -> Column:
    """Fewer than min_words words, or more than repeat_percent % of them in repeated windows."""
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_percent * m["n_words"])


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """df plus its measures, q_base_failed, q_failed (names of failed rules) and q_kept; columns q_... of df are replaced."""
    out = df.drop(*[c for c in df.columns if c.startswith("q_")]).withColumn("q_", measured(F.col(text)))
    m = F.col("q_")
    out = out.withColumn("q_base_failed", base_failed(m, min_words, repeat_percent)).withColumn("q_failed", compiled(rules, m, listed(df)))
    fields = [m[k].alias(f"q_{k}") for k in (*COUNTS, *RATIOS)]
    return out.select(*[c for c in out.columns if c != "q_"], *fields, (~F.col("q_base_failed") & (F.size("q_failed") == 0)).alias("q_kept"))


def kept_documents(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """The rows that pass, with the columns of df; one filter, whose measures a lambda holds so that none is made twice."""
    return df.filter(let(measured(F.col(text)), lambda m: ~base_failed(m, min_words, repeat_percent) & (F.size(compiled(rules, m, listed(df))) == 0)))
