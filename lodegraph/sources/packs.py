"""Packs: objects one after another, each behind its length; and lines of identifiers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cbor import MOST_BYTES


def pack(objects: list[bytes]) -> bytes:
    """Frames of a big-endian 32-bit length and the object."""
    if any(len(o) > MOST_BYTES for o in objects):
        raise ValueError("an object exceeds the frame limit")
    return b"".join(struct.pack(">I", len(o)) + o for o in objects)


def unpack(data: bytes) -> list[bytes]:
    found, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("truncated length")
        (n,) = struct.unpack_from(">I", data, at)
        if n > MOST_BYTES:
            raise ValueError("frame too large")
        if at + 4 + n > len(data):
            raise ValueError("truncated frame")
        found.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, content, fault): the frames of every pack file; a broken pack gives one row with its fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    frames, fault = unpack(raw.as_py() or b""), None
                except ValueError as e:
                    frames, fault = [None], str(e)
                columns = [[name] * len(frames), list(range(len(frames))), frames, [fault] * len(frames)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.string()))], ["path", "n", "content", "fault"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, n int, content binary, fault string")


def cid_lines(spark: SparkSession, path: str) -> DataFrame:
    """(cid): identifiers one a line, blanks trimmed, empty lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("cid")).filter("cid <> ''")
