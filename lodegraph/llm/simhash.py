"""SimHash near-duplicates: a byte-position inverted index with count filtering, then exact verification.

Fingerprints at `distance` 4 or fewer differing bits share at least 4 of their 8 bytes in place, since a differing bit
spoils one byte. The index has a posting list for each set of 4 positional bytes (70 a fingerprint): pairs that share 4
or more are those that meet in some list, and each is taken once, under the first 4 places it shares. There the shared
positional bytes of the pair are tallied, pairs with the guaranteed number go on, and their differing bits are counted.
Lists of single bytes would hold 1/256 of all fingerprints each, so tallies over them grow with the square of the rows.
Only distinct fingerprints are indexed, so copies are never paired, and a list longer than LONG_LIST gives no pairs but
stars: a crowd of near copies costs some 2000 rows a fingerprint, whatever its size.

Null text counts as empty (fingerprint zero, linked like any other). In `classes` a null id gets a class but never
names one. `keep_one` removes by row: of each class the least row by id, then by content stays, whatever ids repeat;
null ids sort first. Extra columns pass through `keep_one`. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, spread_join
from .components import components

SEED = 42
#: Shingles whose bits are unpacked at once.
UNPACK = 1 << 16
#: Entries of a posting list up to which all its pairs are judged.
LONG_LIST = 1000


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of a text: bit set if it is set in over half of the hashes of its shingles of `width` words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), UNPACK):
        part = np.array(hashes[at : at + UNPACK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, name: Column | None = None) -> DataFrame:
    """(key, fp): each row's fingerprint as a signed 64-bit integer; `name`, a struct, replaces the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    given = df.select((F.col(key) if name is None else name).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"key {given.dtypes[0][1]}, fp long")


def _longs(values: list[int]) -> Column:
    """An array of signed 64-bit integers as one literal, which planning doesn't walk through."""
    return F.lit(np.array(values, dtype=np.int64))


def _keyed(fps: DataFrame, shared: int = 4) -> DataFrame:
    """(fp, k): one key for each set of `shared` byte positions: the set as 8 bits, then the bytes."""
    sets = list(combinations(range(8), shared))  # as numbers: the set, then 6 bits for the shift to each of its places
    codes = [sum(1 << i for i in places) << 6 * shared | sum(8 * i << 6 * (shared - 1 - n) for n, i in enumerate(places)) for places in sets]
    k = f"shiftright(code, {6 * shared})"
    for n in reversed(range(shared)):
        k = f"({k}) * 256 + (shiftrightunsigned(fp, cast(shiftright(code, {6 * n}) & 63 AS int)) & 255)"
    return fps.select("fp", F.explode(_longs(codes)).alias("code")).select("fp", F.expr(k).alias("k"))


def _tally(x: Column) -> Column:
    """Positional bytes that two fingerprints share, as a mask of 8 bits; x is what differs."""
    return sum([F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0, 1 << i).otherwise(0) for i in range(8)], F.lit(0))


def _within(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): stars that link fingerprints at up to 2 * radius bits: two are that close exactly if some number lies
    within `radius` bits of both, so the ones near each number, at most as many as there are masks, hang on the least."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    signed = _longs([m - (1 << 64) if m >> 63 else m for m in masks])
    spark = fps.sparkSession
    table = F.broadcast(spark.range(1).select(F.explode(signed).alias("mask")))  # some 2000 rows
    near = fps.join(table).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"))
    groups = near.groupBy("centre").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return stars.filter("a < b").distinct()


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints in column fp that differ in at most `distance` (up to 4) bits.

    Every such pair of which a posting list with at most LONG_LIST entries tells, each once; the entries of longer lists
    are linked by stars, so that as many as there are in one list never meet in pairs.
    """
    if not 0 <= distance <= 4:
        raise ValueError("distance must be from 0 to 4")
    parts = partitions(fps.sparkSession)
    spread = fps.select("fp").distinct().repartition(parts, F.xxhash64("fp"))  # few bytes, but 70 keys each: not to be coalesced
    keyed = _keyed(spread)
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark sizes an explode as what goes into it, so it would broadcast 70 keys a fingerprint; and files by their bytes on disk.
    index = saved(keyed.join(shared.hint("merge"), "k"), "simhash-index").rows  # posting lists of two entries or more
    x = F.col("a").bitwiseXOR(F.col("b"))
    chosen = F.shiftright("k", 32).cast("int")
    upto = chosen
    for s in (1, 2, 4):
        upto = upto.bitwiseOR(F.shiftright(upto, s))  # all positions up to the last chosen one
    short = index.filter(F.col("n") <= LONG_LIST)
    left, right = short.select("k", F.col("fp").alias("a")), short.select(F.col("k").alias("k2"), F.col("fp").alias("b"))
    met = left.join(right.hint("merge"), (F.col("k") == F.col("k2")) & (F.col("a") < F.col("b"))).withColumn("tally", _tally(x))
    counted = met.filter((F.bit_count("tally") >= 8 - distance) & (F.col("tally").bitwiseAND(upto) == chosen))  # once, at the first 4 shared places
    pairs = counted.filter(F.bit_count(x) <= distance).select("a", "b")
    longest = index.agg(F.max("n")).first()[0]
    if (longest or 0) <= LONG_LIST:
        return pairs
    crowd = saved(index.filter(F.col("n") > LONG_LIST).select("fp").distinct(), "simhash-crowd").rows
    stars = _within(crowd, distance // 2) if distance % 2 == 0 else _within(crowd, (distance + 1) // 2).filter(F.bit_count(x) <= distance)
    return pairs.union(stars)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(key, fp, component_id): component_id is the least key among the rows that links reach, the row's own included."""
    return _classed(saved(fingerprints(df, key, text, width), "simhash").rows, distance)


def _classed(fps: DataFrame, distance: int) -> DataFrame:
    """(key, fp, component_id) of fps(key, fp). Copies of a text and members of a class may be any share of the rows.

    A join with care for hot keys names its table several times, so every such table is written first: joins of joins
    would put the making of the first into a plan dozens of times, and the driver's memory goes with the size of plans and
    with the number of their stages and scans. Classes of one fingerprint, by far the most, take no part in the joins.
    """
    nodes = saved(fps.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-nodes").rows
    labels = components(links(nodes, distance))
    linked = saved(labels.join(nodes, labels["node"] == nodes["fp"]).select("fp", "least", "label"), "simhash-labels").rows
    ids = saved(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "simhash-ids").rows
    found = spread_join(linked.select("fp", "label"), ids, ["label"], "members").select("fp", "component_id")
    by_fp = nodes.join(found, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"))
    by_fp = saved(by_fp, "simhash-classes").rows
    return spread_join(fps, by_fp, ["fp"], "copies").select("key", "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The least row of each class of df, by id and then by a hash of the row; of equal rows, one."""
    cols = [df[f"`{c}`"] for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])  # hashes skip nulls
    x, y = F.xxhash64(nulls, *cols), F.hash(nulls, *cols)
    found = _classed(saved(fingerprints(df, key, text, width, F.struct(df[key].alias("id"), x.alias("x"), y.alias("y"))), "simhash").rows, distance)
    rows = found.groupBy("key.x", "key.y").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.expr("key = component_id")).alias("least"))
    special = saved(rows.filter("NOT least OR n > 1").select(F.col("x").alias("x_"), F.col("y").alias("y_"), "least"), "simhash-special").rows
    named = lambda s: (x == s["x_"]) & (y == s["y_"])
    kept = df.join(special, named(special), "left_anti")
    repeated = special.filter("least")
    if not repeated.isEmpty():
        kept = kept.union(df.join(repeated, named(repeated), "left_semi").dropDuplicates())
    return kept
