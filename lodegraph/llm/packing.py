"""Best-fit packing of documents into sequences: minimum bin slack on the histogram of lengths.

A document's ids are cut into pieces of `capacity` only if there are more; every piece must lie whole in a sequence.
For each bin a bitset subset-sum dynamic program over the lengths still there, the largest fixed first, finds the
fullest feasible combination; it is then removed, as often as the counts allow. There are at most `capacity` lengths,
so the plan is made on the driver from a table of that size however many documents there are, and pieces find their
places by their rank among the pieces of their length.

Null text is one document with the end id alone. Rows with equal ids are separate documents with pieces of their own.
Null ids are kept. Extra columns don't matter. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import scratch, slices

CAPACITY = 4096


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (each at most as often as counts has it) with the largest sum up to `room`.

    Bit s of the set says that sum s can be reached; a step adds 2^j pieces of a length at once, long ones first.
    """
    full, reach = 1 << room, 1
    within = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left and not reach & full:
            block = min(block, left)
            steps.append((reach, length, block))
            reach |= reach << length * block & within
            left, block = left - block, block * 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for before, length, block in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + block
            total -= length * block
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rows, sequences). A row: (length, first rank, bins, first sequence, first offset).

    Of the pieces with that length, those ranked from `first rank` on go one to each of `bins` sequences, then a second
    to each at the next offset, until the row's pieces are used up.
    """
    counts = dict(histogram)
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    order = sorted(counts, reverse=True)
    for largest in order:
        while counts[largest]:
            counts[largest] -= 1
            taken = fullest(counts, capacity - largest)
            counts[largest] += 1
            taken[largest] = taken.get(largest, 0) + 1
            bins = min(counts[x] // n for x, n in taken.items())
            offset = 0
            for length, n in sorted(taken.items(), reverse=True):
                rows.append((length, used[length], bins, sequence, offset))
                used[length] += n * bins
                counts[length] -= n * bins
                offset += n * length
            sequence += bins
    return rows, sequence


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int | None = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth), written to the shared folder for as long as the application runs.

    ids: little-endian unsigned 32-bit integers. nth: the piece's number among those of its length in its part.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tokens.read_file(tokenizer))  # a vocabulary file
    names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(shared.value)
        part = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch):
                ids, ends = tokens.with_end(*encoder.encode(some.column(1)), end)
                raw = ids.astype("<u4").tobytes()
                out: list[list] = [[], [], [], [], [], []]
                for i, name in enumerate(some.column(0).to_pylist()):
                    a, b = int(ends[i]), int(ends[i + 1])
                    for n, at in enumerate(range(a, b, capacity)):
                        size = min(capacity, b - at)
                        for column, value in zip(out, (name, n, at - a, size, raw[4 * at : 4 * (at + size)], int(met[size]))):
                            column.append(value)
                        met[size] += 1
                arrays = [pa.array(v, k) for v, k in zip(out[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())], names)

    path = scratch(spark, "pieces")
    made = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    made.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part int, nth long").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def place(found: DataFrame, table: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """found(length, part, nth, ...) plus sequence_id and offset. table: where the lengths are counted, if not in found."""
    counted = (found if table is None else table).groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(rest)
    lookup = {k: np.array(v, np.int64).reshape(-1, 4) for k, v in by_length.items()}
    shared = found.sparkSession.sparkContext.broadcast(lookup)  # bounded by the number of lengths
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part, not per piece
    bases = counted.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(bases, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))).withColumn("rank", F.col("base") + F.col("nth")).drop("of_length", "of_part", "base", "nth", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                first, bins, sequences, offsets = shared.value[int(lengths[own[0]])].T
                row = np.searchsorted(first, ranks[own], "right") - 1
                nth = ranks[own] - first[row]
                sequence[own] = sequences[row] + nth % bins[row]
                offset[own] = offsets[row] + nth // bins[row] * lengths[own[0]]
            keep = [i for i, f in enumerate(b.schema) if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(sequence), pa.array(offset)], [*[b.schema[i].name for i in keep], "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def best_fit(df: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of df's documents."""
    return place(pieces(df, capacity=capacity, **options), capacity=capacity)
