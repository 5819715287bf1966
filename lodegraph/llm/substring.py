"""Substring dedup by fixed-block anchors: exact repeats of `window` words, wherever they start.

Reference blocks of `window` // 2 words lie side by side in every document, so any repeat of `window` words holds a
whole block of its earlier copy. The index of those blocks is probed with every rolling window of that many words; a
hit marks both ends, and hits are extended: every window of `window` words around a hit is compared in full. Runs of
such windows are the maximal exact repeats, and every word of a later copy goes.

Documents are dealt by id into units of some MB, sorted, so that order among units is order among documents. A unit
sends each distinct hash once to its place in hash space (5 bytes a probe, and its bits there as a bitmap back), so a
passage that fills the corpus costs one entry a unit, and no list of its places is ever made. Blocks meet under 40 bits
and their place, only to find candidates; windows are compared by 96 bits.

Null text is a document without words. Rows with equal ids are separate documents in the order of their texts; null ids
come first. White space of any length parts words, and the words left are joined by one blank. Extra columns don't
matter. Texts of any length are handled whole, in memory proportional to the longest. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, partitions, saved, slices

WINDOW = 20
#: Text of a unit, and the compressed text (some two bytes a word) whose hashes one place, so one task, should hold.
UNIT_BYTES = 8 << 20
PLACE_BYTES = 2_000_000
#: Multipliers of the rolling hashes: odd, fixed.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit sums, so that high bits depend on all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Unit:
    """The words of a run of documents, with rolling hashes over them."""

    def __init__(self, texts: pa.Array):
        import xxhash

        self.words = Words(texts)
        coded = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.vocab), np.uint64, len(self.words.vocab))
        self.hashes = coded[self.words.codes] if len(coded) else np.zeros(0, np.uint64)
        counts = np.diff(self.words.offsets)
        self.within = np.arange(len(self.hashes)) - np.repeat(self.words.offsets[:-1], counts)
        self.left = np.repeat(counts, counts) - self.within

    def starts(self, width: int) -> np.ndarray:
        """Where `width` words of one document begin."""
        return np.flatnonzero(self.left >= width)

    def rolling(self, width: int, which: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the `width` words from each of `at` on."""
        total = np.zeros(max(0, len(self.hashes) - width + 1), np.uint64)
        for i in range(width):
            total += self.hashes[i : len(self.hashes) - width + 1 + i] * np.uint64(pow(MULTIPLIERS[which], i, 1 << 64))
        return _mixed(total)[at]


def _units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(unit, rows): documents in order, some MB of text a row, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, limit=UNIT_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(some)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([some.num_rows], pa.int64())], ["unit", "rows", "n"])
                n += 1

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.repartitionByRange(partitions(df.sparkSession), "key").sortWithinPartitions("key", "text").mapInArrow(run, "unit long, rows binary, n long")


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def _texts(table: pa.Table) -> pa.Array:
    return table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())


def _places(sorted_hashes: np.ndarray, count: int) -> np.ndarray:
    """Where each of `count` equal ranges of hash space begins and the last ends in a sorted array."""
    bounds = [(i << 64) // count for i in range(1, count)]
    return np.concatenate([[0], np.searchsorted(sorted_hashes, np.array(bounds, np.uint64)), [len(sorted_hashes)]]).astype(np.int64)


def _low5(h: np.ndarray) -> bytes:
    """The low 40 bits; with the place, which follows from the high ones, they tell hashes apart."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from5(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


class Blocks:
    """Distinct block hashes of a unit, sorted, and whether any is a reference block or met twice."""

    def __init__(self, unit: Unit, width: int):
        self.at = unit.starts(width)
        self.distinct, self.of, counts = np.unique(unit.rolling(width, 0, self.at), return_inverse=True, return_counts=True)
        self.reference = np.zeros(len(self.distinct), bool)
        self.reference[self.of[unit.within[self.at] % width == 0]] = True
        self.twice = counts > 1


class Windows:
    """Distinct hashes of the candidate windows of a unit, sorted, and where each occurs."""

    def __init__(self, unit: Unit, width: int, block: int, hit: np.ndarray):
        """hit: for each word, whether a block that begins there is marked."""
        ends = np.cumsum(np.concatenate([[0], hit.astype(np.int64)]))
        at = unit.starts(width)
        at = at[ends[at + width - block + 1] > ends[at]]
        first, second = unit.rolling(width, 0, at), unit.rolling(width, 1, at) >> np.uint64(32)
        order = np.lexsort((second, first))
        first, second, self.at = first[order], second[order], at[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.of = np.cumsum(new) - 1
        self.first, self.second = first[new], second[new].astype("<u4")


def _bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(bitmap: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), count=count, bitorder="little").astype(bool)


def _collected(bits: pa.Table, places: np.ndarray) -> np.ndarray:
    """One flag per sorted hash from the bitmaps of its places."""
    flags = np.zeros(int(places[-1]), bool)
    for place, bitmap in zip(bits["place"].to_pylist(), bits["bits"].to_pylist()):
        a, b = int(places[place]), int(places[place + 1])
        flags[a:b] = _flags(bitmap, b - a)
    return flags


def repeats_removed(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each document without the words of later copies, the rest joined by blanks.

    A word goes if a window of `window` words that covers it also starts earlier, at a smaller id or before in the same
    document.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    block = window // 2
    units = saved(_units(df, key, text), "units", "none").rows  # compressed already
    compressed = units.agg(F.sum(F.length("rows"))).first()[0] or 0
    count = max(1, int(compressed // PLACE_BYTES))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Blocks(Unit(_texts(_opened(blob.as_py()))), block)
                places = _places(own.distinct, count)
                used = np.flatnonzero(np.diff(places))
                cut = [slice(places[p], places[p + 1]) for p in used]
                columns = [used, [unit] * len(used), [_low5(own.distinct[s]) for s in cut], [_bitmap(own.reference[s]) for s in cut], [_bitmap(own.twice[s]) for s in cut]]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["place", "unit", "hashes", "reference", "twice"])

    def matched(t: pa.Table) -> pa.Table:
        """Marks hashes that a reference block has and that occur elsewhere too."""
        parts = [_from5(x) for x in t["hashes"].to_pylist()]
        sizes = [len(x) for x in parts]
        values, of, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        reference = np.zeros(len(values), bool)
        again = counts > 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for i, (r, w) in enumerate(zip(t["reference"].to_pylist(), t["twice"].to_pylist())):
            own = of[ends[i] : ends[i + 1]]
            reference[own[_flags(r, sizes[i])]] = True
            again[own[_flags(w, sizes[i])]] = True
        hit = (reference & again)[of]
        bits = [_bitmap(hit[ends[i] : ends[i + 1]]) for i in range(len(sizes))]
        return pa.table({"unit": t["unit"], "place": t["place"], "bits": pa.array(bits, pa.binary())})

    slim = units.select("unit", "rows")
    probed = slim.mapInArrow(probes, "place int, unit long, hashes binary, reference binary, twice binary")
    hits = saved(probed.groupBy("place").applyInArrow(matched, "unit long, place int, bits binary"), "hits").rows

    def candidates_of(table: pa.Table, bits: pa.Table) -> tuple[Unit, Windows]:
        unit = Unit(_texts(table))
        own = Blocks(unit, block)
        marked = _collected(bits, _places(own.distinct, count))
        hit = np.zeros(len(unit.hashes) + 1, bool)
        hit[own.at[marked[own.of]]] = True
        return unit, Windows(unit, window, block, hit)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], []]
        for unit, blob in zip(left["unit"].to_pylist(), left["rows"].to_pylist()):
            _, own = candidates_of(_opened(blob), right)
            places = _places(own.first, count)
            for p in np.flatnonzero(np.diff(places)):
                s = slice(places[p], places[p + 1])
                for column, value in zip(rows, (p, unit, own.first[s].astype("<u8").tobytes(), own.second[s].tobytes())):
                    column.append(value)
        return pa.table([pa.array(v, k) for v, k in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["place", "unit", "first", "second"])

    def earliest(t: pa.Table) -> pa.Table:
        """Marks, for each unit's windows, those that no earlier unit has."""
        order = np.argsort(t["unit"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        firsts = [np.frombuffer(x, "<u8") for x in t["first"].to_pylist()]
        sizes = [len(x) for x in firsts]
        first, second = np.concatenate(firsts), np.frombuffer(b"".join(t["second"].to_pylist()), "<u4")
        by = np.lexsort((second, first))  # stable: earlier units first
        new = np.ones(len(by), bool)
        new[1:] = (first[by][1:] != first[by][:-1]) | (second[by][1:] != second[by][:-1])
        flags = np.zeros(len(by), bool)
        flags[by] = new
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bits = [_bitmap(flags[ends[i] : ends[i + 1]]) for i in range(len(sizes))]
        return pa.table({"unit": t["unit"], "place": t["place"], "bits": pa.array(bits, pa.binary())})

    found = slim.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(candidates, "place int, unit long, first binary, second binary")
    first_seen = saved(found.groupBy("place").applyInArrow(earliest, "unit long, place int, bits binary"), "first-seen").rows

    def left_over(left: pa.Table, right: pa.Table) -> pa.Table:
        made: list[pa.Table] = []
        marks = {k: right.filter(pc.equal(right["step"], k)) for k in (0, 1)}
        for blob in left["rows"].to_pylist():
            table = _opened(blob)
            unit, own = candidates_of(table, marks[0])
            fresh = _collected(marks[1], _places(own.first, count))
            starts = np.full(len(fresh), np.iinfo(np.int64).max)
            np.minimum.at(starts, own.of, own.at)
            later = own.at[~fresh[own.of] | (own.at != starts[own.of])]
            step = np.zeros(len(unit.hashes) + window + 1, np.int64)
            np.add.at(step, later, 1)
            np.add.at(step, later + window, -1)
            keep = np.cumsum(step)[: len(unit.hashes)] == 0
            codes, offsets, vocab = unit.words.codes, unit.words.offsets, unit.words.vocab
            texts, gone = [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                some = codes[a:b][keep[a:b]]
                gone.append(int(b - a - len(some)))
                texts.append(b" ".join([vocab[c] for c in some.tolist()]).decode("utf-8", "replace"))
            made.append(pa.table({"doc_id": table["key"], "n_words": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(gone, pa.int64()), "text": pa.array(texts, pa.string())}))
        kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
        return pa.concat_tables([m.cast(kinds) for m in made]) if made else kinds.empty_table()

    marks = hits.withColumn("step", F.lit(0)).union(first_seen.withColumn("step", F.lit(1)))
    return slim.groupBy("unit").cogroup(marks.groupBy("unit")).applyInArrow(left_over, "doc_id long, n_words long, n_removed long, text string")
