"""Token-id files: fixed-width bit packing, written in ascending document order and read back.

File format: a Parquet data set, so that any store Spark knows will do, one row per block of whole documents:
shard (files in document order), block (from 0 within the shard), first (ids of the shard before the block), n_ids,
bits (per id: those of the largest id), doc_ids, doc_ends (where each document's ids end in the block) and payload: id
i occupies bits [i * bits, (i + 1) * bits) counted from the least significant bit of each byte. Documents are found by
block and doc_ends, single ids by arithmetic; numpy unpacks a block at once.

Null text counts as empty and still gets the end id. Rows with equal ids are separate documents in the order of their
texts; null ids come first. Extra columns are not written. An empty table gives a file without blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import partitions, scratch, shuffle_files_deleted, slices

#: A block closes at this many ids; only a longer document makes a longer block.
BLOCK_IDS = 1 << 16
SCHEMA = "shard int, block int, first long, n_ids long, bits int, doc_ids array<long>, doc_ends array<long>, payload binary"
NAMES = ["shard", "block", "first", "n_ids", "bits", "doc_ids", "doc_ends", "payload"]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The low `bits` bits of each id, one after another."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of a payload."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, -(-(start + count) * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    own = raw[start * bits - low * 8 :][: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = own
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int | None = 1) -> None:
    """Encodes df's texts and writes the file at `path`. tokenizer: a file on the driver."""
    description = tokens.read_file(tokenizer)
    shared = df.sparkSession.sparkContext.broadcast(description)  # a vocabulary file
    bits = max(1, (max(tokens.encoder(description).vocab_size - 1, end or 0)).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(shared.value)
        shard, block, first, total = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, first, total
            ids = np.concatenate(held)
            row = [[shard], [block], [first], [len(ids)], [bits], [list(names)], [np.cumsum(sizes).tolist()], [pack(ids, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            block, first, total = block + 1, first + len(ids), 0
            held.clear(), names.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], NAMES)

        for batch in batches:
            for part in slices(batch):
                ids, ends = tokens.with_end(*encoder.encode(part.column(1)), end)
                for i, name in enumerate(part.column(0).to_pylist()):
                    held.append(ids[ends[i] : ends[i + 1]])
                    names.append(name)
                    sizes.append(int(ends[i + 1] - ends[i]))
                    total += sizes[-1]
                    if total >= BLOCK_IDS or len(sizes) >= BLOCK_IDS:
                        yield flush()
        if names:
            yield flush()

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(partitions(df.sparkSession), "key").sortWithinPartitions("key", "text")  # the text moves, not the ids: they are made once
    with shuffle_files_deleted(df.sparkSession):
        ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, shard_start, ids): each document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                shard, first, bits = (b.column(i)[r].as_py() for i in (0, 1, 2))
                names, ends, payload = b.column(3)[r].as_py(), b.column(4)[r].as_py(), b.column(5)[r].as_py()
                ids = unpack(payload, bits, 0, ends[-1]).astype("<u4").tobytes()
                starts = [0, *ends[:-1]]
                own = [ids[4 * s : 4 * e] for s, e in zip(starts, ends)]
                arrays = [pa.array(names, pa.int64()), pa.array([shard] * len(names), pa.int32()), pa.array([first + s for s in starts], pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "shard", "shard_start", "ids"])

    blocks = spark.read.parquet(path).select("shard", "first", "bits", "doc_ids", "doc_ends", "payload")
    return blocks.mapInArrow(run, "doc_id long, shard int, shard_start long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids of all shards before each; a row per written partition."""
    totals = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("shard").alias("of_shard"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def between(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): ids number start .. stop - 1 of the whole file, a row per block; only blocks that hold some are
    read, and of them only the bits asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids = [], []
            for base, n, bits, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
                a, z = max(start - base, 0), min(stop - base, n)
                at.append(base + a)
                ids.append(unpack(payload, bits, a, z - a).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.binary())], ["start", "ids"])

    blocks = spark.read.parquet(path).join(F.broadcast(shard_starts(spark, path)), F.col("shard") == F.col("of_shard"))  # a row per shard
    chosen = blocks.select((F.col("before") + F.col("first")).alias("base"), "n_ids", "bits", "payload").filter((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start))
    return chosen.mapInArrow(run, "start long, ids binary")


def document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, ids) of each row written for one document; of its blocks only its own bits are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for bits, names, ends, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
                starts = [0, *ends[:-1]]
                ids += [unpack(payload, bits, s, e - s).astype("<u4").tobytes() for name, s, e in zip(names, starts, ends) if name == doc_id]
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(ids), pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    blocks = spark.read.parquet(path).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return blocks.select("bits", "doc_ids", "doc_ends", "payload").mapInArrow(run, "doc_id long, ids binary")


def written(df: DataFrame, **options) -> str:
    """Writes df's ids into a new file of the shared folder, which goes with the application; its path."""
    path = scratch(df.sparkSession, "tokens")
    write(df, path, **options)
    return path
