"""Line dedup: repeated runs of lines, by distributed prefix doubling over line ids; later copies are deleted.

A document is a sequence of line ids (96-bit hashes of its lines that have a word), and every line begins a suffix. A
round of doubling names the block of 2w lines at a suffix by the pair of ranks of its two halves of w lines; names are
sorted by range over the cluster, and running sums of their counts give each its rank: the place in the suffix array,
sorted to that depth, where the suffixes of that name begin. Those `n` places from `rank` on are a longest-common-prefix
interval of at least 2w lines. A name met once is left out with its suffix, so rounds shrink; they end when no block
repeats, after about log2 of the longest repeat. Line ids are ordered by their hashes, which is as good as any order.

Of an interval the suffix at the smallest place (id, hash of the text, line) is the first, all others are later copies.
The deepest interval in which a suffix is later says how much of what begins there is copied, and from where; together
these blocks make up the maximal repeated runs, and they go. A run counts from `min_lines` lines on: if that isn't a
power of two, intervals of just that depth are added, named by two overlapping blocks.

Null text is one document without lines. Blank lines take no part; those inside a repeated run go with it. Of rows with
equal id and text the first keeps what a single one would; each other one is a later copy as a whole, so its lines from
the first to the last with a word go if there are min_lines of them. Null ids sort first. Extra columns pass through;
names starting with ld_ are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Saved, let, partitions, saved, spread_join

#: Lines from which on a repeated run counts: every single one.
MIN_LINES = 1
#: Names that one task puts in order, and that are broadcast (some 100 bytes each) rather than shuffled to their suffixes.
PART_ROWS, BROADCAST_ROWS = 1 << 14, 1 << 15
#: A suffix: its document (id and hash of the text) and the number of its first line among those with a word.
SUFFIX = ("ld_key", "ld_text", "line")


def _worded(text: Column) -> Column:
    """Array of (at, text) of the lines with a word; at counts all lines."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("text")))
    return F.filter(every, lambda x: x["text"].rlike(r"[^\x20\x09-\x0D]"))


def line_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ld_key, ld_text, line, a, b): the id of each line with a word, in two columns."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = df.select(F.col(key).alias("ld_key"), F.xxhash64(text).alias("ld_text"), F.posexplode(lines).alias("line", "ld_line"))
    return rows.select(*SUFFIX, F.xxhash64("ld_line").alias("a"), F.hash("ld_line").cast("bigint").alias("b"))


def ranked(names: DataFrame, rows: int) -> DataFrame:
    """names(a, b, n, ...) plus `rank`: the sum of n over all smaller names (a, b), of which none repeats.

    A range sort, sums per part and their running sums over a row per part; no task sees more than a part, and up to
    PART_ROWS names are one.
    """
    if rows <= PART_ROWS:
        smaller = Window.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
        return names.withColumn("rank", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    parts = names.repartitionByRange(partitions(names.sparkSession), "a", "b").withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    placed = saved(parts.withColumn("inside", F.coalesce(F.sum("n").over(own), F.lit(0))), "line-ranks").rows
    order = Window.orderBy("part")  # a row per part
    base = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    bases = placed.groupBy("part").agg(F.sum("n").alias("total")).select("part", base, (F.col("part") - F.coalesce(F.lag("part").over(order), F.lit(-1))).alias("width"))
    by_part = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "base", "width"))), lambda x: F.array_repeat(x["base"], x["width"])))  # empty parts too
    return placed.withColumn("rank", F.get(bases.agg(by_part).scalar(), F.col("part")) + F.col("inside")).drop("part", "inside")


def intervals(blocks: DataFrame, name: str) -> Saved | None:
    """(ld_key, ld_text, line, rank, n, first) of the suffixes whose block name (a, b) repeats; None if none does.

    rank, n: their interval of the suffix array; first: the least suffix of it.
    """
    repeated = saved(blocks.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*SUFFIX)).alias("first")).filter("n > 1"), f"{name}-names")
    rows = repeated.rows.count()
    if not rows:
        repeated.drop()
        return None
    ranks = ranked(repeated.rows, rows)
    found = blocks.join(F.broadcast(ranks), ["a", "b"]) if rows <= BROADCAST_ROWS else spread_join(blocks, ranks, ["a", "b"], "n")
    level = saved(found.select(*SUFFIX, "rank", "n", "first"), name)
    repeated.drop()
    return level


def _ahead(level: DataFrame, lines: int) -> DataFrame:
    """(ld_key, ld_text, line, a, b): the rank of each suffix and that of the one `lines` further on, where both have one."""
    at = Window.partitionBy("ld_key", "ld_text").orderBy("line").rangeBetween(lines, lines)
    return level.select(*SUFFIX, F.col("rank").alias("a"), F.max("rank").over(at).alias("b")).filter("b IS NOT NULL")


def suffix_array(lines: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, Saved]]:
    """(depth, intervals) of the suffix array of line_ids, depth by depth: 1, 2, 4, ... and min_lines, while blocks repeat."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    levels: list[tuple[int, Saved]] = []
    level, depth = intervals(lines, "line-1"), 1
    while level is not None:
        levels.append((depth, level))
        if depth < min_lines < 2 * depth:
            exact = intervals(_ahead(level.rows, min_lines - depth), f"line-{min_lines}")
            if exact is not None:
                levels.append((min_lines, exact))
        level, depth = intervals(_ahead(level.rows, depth), f"line-{2 * depth}"), 2 * depth
    return levels


def copied(levels: list[tuple[int, Saved]], min_lines: int = MIN_LINES) -> DataFrame | None:
    """(ld_key, ld_text, line, lines, first): per suffix that is a later copy, the depth of its deepest interval in which
    it is one, and that interval's first suffix; None if no block of min_lines lines repeats."""
    later = [x.rows.filter(F.col("first") < F.struct(*SUFFIX)).select(*SUFFIX, F.struct(F.lit(d).alias("lines"), "first").alias("deepest")) for d, x in levels if d >= min_lines]
    if not later:
        return None
    every = later[0]
    for x in later[1:]:
        every = every.union(x)
    return every.groupBy(*SUFFIX).agg(F.max_by("deepest", "deepest.lines").alias("deepest")).select(*SUFFIX, "deepest.lines", "deepest.first")


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame | None:
    """Per document of line_ids with copied lines: ld_key, ld_text, ld_runs (array of (a, b), lines among those with a word, both
    included, in order), ld_lines_copied (lines of its deepest block) and ld_source (id of that block's first document).

    Runs overlap in a line exactly where a block holds both its neighbours. None if no line run repeats.
    """
    levels = suffix_array(lines, min_lines)
    found = copied(levels, min_lines)
    if found is None:
        return None
    document = Window.partitionBy("ld_key", "ld_text").orderBy("line")
    reach = F.max(F.col("line") + F.col("lines")).over(document.rowsBetween(Window.unboundedPreceding, -1))
    wider = found.withColumn("reach", F.coalesce(reach, F.lit(0))).filter("line + lines > reach")  # a block inside another one adds nothing
    run = F.struct(F.when(F.col("line") < F.col("reach"), F.col("reach") - 1).otherwise(F.col("line")).alias("a"), (F.col("line") + F.col("lines") - 1).alias("b"))
    deepest = F.max_by(F.col("first.ld_key"), F.struct("lines", (-F.col("line")).alias("minus")))
    cuts = wider.groupBy("ld_key", "ld_text").agg(F.array_sort(F.collect_list(run)).alias("ld_runs"), F.max("lines").alias("ld_lines_copied"), deepest.alias("ld_source"))
    done = saved(cuts, "line-cuts").rows
    for _, level in levels:
        level.drop()
    return done


def _cut(text: Column, runs: Column) -> Column:
    """Sorted array of the line numbers that go: of each run, from its first to its last line."""
    at = lambda w, i: F.get(w, i)["at"]
    return let(_worded(text), lambda w: F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(at(w, r["a"]), at(w, r["b"])))))))


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """df with later copies of repeated line runs deleted from its text, plus ld_lines (lines before), ld_cut (sorted
    numbers of the deleted ones), ld_lines_copied (lines of its deepest copied block, 0 if none) and ld_source (id of the
    document that has that block first, as text)."""
    base = df.drop(*[c for c in df.columns if c.startswith("ld_")])
    columns = [F.col(f"`{c}`") for c in base.columns]
    start = saved(line_ids(base, key, text), "line-ids")
    again = saved(start.rows.filter("line = 0").groupBy("ld_key", "ld_text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ld_key", F.col("ld_text").alias("ld_hash")), "line-again").rows
    repeats = not again.isEmpty()  # rows with equal id and text: their lines count once
    runs = later_copies(start.rows.dropDuplicates(list(SUFFIX)) if repeats else start.rows, min_lines)
    start.drop()
    none = {"ld_runs": F.array().cast("array<struct<a:int,b:int>>"), "ld_lines_copied": F.lit(0), "ld_source": F.lit(None).cast("string")}
    if runs is None:
        joined = base.withColumns(none)
    else:
        at = base[key].eqNullSafe(runs["ld_key"]) & (F.xxhash64(base[text]) == runs["ld_text"])
        joined = base.join(runs.withColumn("ld_source", F.col("ld_source").cast("string")), at, "left").select(*columns, *none)
    named = joined.withColumn("ld_text", F.xxhash64(text))
    copy = F.lit(False)
    if repeats:  # all but one of them go as a whole
        same = named[key].eqNullSafe(again["ld_key"]) & (named["ld_text"] == again["ld_hash"])
        order = Window.partitionBy(key, "ld_text").orderBy(F.xxhash64(*columns))
        repeated = named.join(again, same, "left_semi").withColumn("ld_nth", F.row_number().over(order))
        named = named.join(again, same, "left_anti").withColumn("ld_nth", F.lit(1)).unionByName(repeated)
        copy = F.col("ld_nth") > 1
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.size(_worded(F.col(text))) - 1).alias("b")))
    chosen = F.when(copy, F.when(F.size(_worded(F.col(text))) >= min_lines, whole)).otherwise(F.col("ld_runs"))
    empty = F.array().cast("array<int>")
    cut = F.when(F.size(chosen) > 0, _cut(F.col(text), chosen)).otherwise(empty)
    marked = named.withColumn("ld_cut", F.coalesce(cut, empty))
    lines = F.split(F.col(text), "\n")
    left = let(lines, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("ld_cut")), lambda i: F.get(ls, i)))
    kept = F.when(F.size("ld_cut") == 0, F.col(text)).otherwise(F.array_join(left, "\n"))
    others = [kept.alias(text) if c == text else F.col(f"`{c}`") for c in base.columns]
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    return marked.select(*others, count.alias("ld_lines"), "ld_cut", F.coalesce("ld_lines_copied", F.lit(0)).alias("ld_lines_copied"), "ld_source")


def runs(cut: Column) -> Column:
    """Maximal runs of a sorted array of line numbers, as "first-last" joined by commas."""
    edges = lambda c: (F.array_sort(F.array_except(c, F.transform(c, lambda x: x + 1))), F.array_sort(F.array_except(c, F.transform(c, lambda x: x - 1))))
    return let(cut, lambda c: F.array_join(F.zip_with(*edges(c), lambda a, b: F.concat_ws("-", a, b)), ","))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """df with later copies of line runs deleted, without the documents of which nothing but blanks is left by that."""
    done = line_dedup(df, key, text, min_lines)
    bare = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")) == 0
    return done.filter(~((F.size("ld_cut") > 0) & bare)).select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("ld_")])
