"""Scalars of TensorBoard event files (S9), read by Spark and decoded file by file.

An event file is a sequence of records (length, checksum, message, checksum); a message is an ``Event`` of
protocol buffers, of which the step and the scalar values are taken. A record cut off at the end is left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# fixed values: field numbers of the messages, and the kinds of their encoding
STEP, SUMMARY, VALUE, TAG, SIMPLE_VALUE = 2, 5, 1, 1, 2
VARINT, EIGHT_BYTES, SIZED, FOUR_BYTES = 0, 1, 2, 5
FILES = "events.out.tfevents.*"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 0x7F) << shift, at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: a number, or the bytes of anything else."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == VARINT:
            value, at = _varint(data, at)
        else:
            size, at = (_varint(data, at) if kind == SIZED else ({EIGHT_BYTES: 8, FOUR_BYTES: 4}[kind], at))
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def scalars_of(content: bytes) -> Iterator[tuple[int, str, float]]:
    """(step, tag, value) in the order of the file."""
    at = 0
    while at + 12 <= len(content):
        (size,) = struct.unpack_from("<Q", content, at)
        record, at = content[at + 12 : at + 12 + size], at + size + 16
        if len(record) < size:
            return
        event = list(_message(record))
        step = next((v for k, v in event if k == STEP), 0)
        for value in (v for k, summary in event if k == SUMMARY for n, v in _message(summary) if n == VALUE):
            found = dict(_message(value))
            if SIMPLE_VALUE in found and TAG in found:
                yield step, found[TAG].decode(), struct.unpack("<f", found[SIMPLE_VALUE])[0]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, step, tag, value) of all event files of a folder and those below."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = list(scalars_of(content.as_py()))
                yield pa.record_batch(
                    {
                        "path": pa.array([name] * len(rows), pa.string()), "place": pa.array(range(len(rows)), pa.int64()), "step": pa.array([r[0] for r in rows], pa.int64()),
                        "tag": pa.array([r[1] for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.float64()),
                    }
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", FILES).load(path)
    return files.select("path", "content").mapInArrow(decode, "path string, place long, step long, tag string, value double")
