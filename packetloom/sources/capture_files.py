"""Capture files (.pcap, .pcapng, .cap) to raw frames, one task per group of files.

Files are listed and read by Spark's ``binaryFile`` source, so any Hadoop file system works and the
same code serves batch and streaming reads. A file is one row, so files have a size limit (a parameter, 200 MB by
default); a file that is not admitted, or is damaged somewhere, gives a row with its ``error`` beside the frames that could
be read. Only the walk over record headers is Python, on Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_FILE_BYTES = 200 * 1024 * 1024
MIN_FILE_BYTES = 24
EXTENSIONS = [".pcap", ".pcapng", ".cap"]
FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

FRAME_DDL = (
    "capture_id string, packet_id bigint, ts_us bigint, caplen int, link_type int, raw binary, error string"
)
_FRAME_ARROW = pa.schema([
    ("capture_id", pa.string()), ("packet_id", pa.int64()), ("ts_us", pa.int64()), ("caplen", pa.int32()),
    ("link_type", pa.int32()), ("raw", pa.binary()), ("error", pa.string()),
])
_ROWS_PER_BATCH = 8192

# Fixed values of the two file formats.
_CLASSIC_MAGIC = {  # first four bytes -> (byte order, time units per second)
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
_NG_SECTION, _NG_INTERFACE, _NG_SIMPLE, _NG_ENHANCED = 0x0A0D0D0A, 1, 3, 6


def rejection(path: Column, length: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Why a file is not admitted; null for good ones."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return (
        F.when(~suffix.isin(EXTENSIONS), F.concat(F.lit("unsupported file type "), suffix))
        .when(length > max_bytes, f"file exceeds {max_bytes // 1024 ** 2} MB limit")
        .when(length < MIN_FILE_BYTES, "file is too small to be a capture")
    )


def list_captures(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Path, size and rejection reason of every file; reads no file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", rejection(F.col("path"), F.col("length"), max_bytes).alias("reason"))


def _classic(data: memoryview, order: str, per_second: int) -> Iterator[tuple]:
    (link,) = struct.unpack_from(order + "I", data, 20)
    header = struct.Struct(order + "IIII")
    at, end = 24, len(data)
    while at + 16 <= end:
        seconds, fraction, size, _ = header.unpack_from(data, at)
        at += 16
        if at + size > end:
            raise ValueError(f"record at byte {at - 16} is cut off")
        yield seconds * 1_000_000 + fraction * 1_000_000 // per_second, link & 0xFFFF, data[at:at + size]
        at += size
    if at < end:
        raise ValueError(f"record at byte {at} is cut off")


def _ng_resolution(options: memoryview, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size == 1:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10 ** value
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _ng(data: memoryview) -> Iterator[tuple]:
    at, end, order = 0, len(data), "<"
    interfaces: list[tuple[int, int]] = []
    while at + 12 <= end:
        (kind,) = struct.unpack_from(order + "I", data, at)
        if kind == _NG_SECTION:
            order = "<" if bytes(data[at + 8:at + 12]) == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        (size,) = struct.unpack_from(order + "I", data, at + 4)
        if size < 12 or at + size > end:
            raise ValueError(f"block at byte {at} is cut off")
        body = data[at + 8:at + size - 4]
        if kind == _NG_INTERFACE:
            (link,) = struct.unpack_from(order + "H", body, 0)
            interfaces.append((link, _ng_resolution(body[8:], order)))
        elif kind == _NG_ENHANCED:
            number, high, low, caplen, _ = struct.unpack_from(order + "IIIII", body, 0)
            link, per_second = interfaces[number]
            yield ((high << 32) | low) * 1_000_000 // per_second, link, body[20:20 + caplen]
        elif kind == _NG_SIMPLE:
            (wire,) = struct.unpack_from(order + "I", body, 0)
            yield 0, interfaces[0][0], body[4:4 + min(wire, len(body) - 4)]
        at += size


def walk_records(data: bytes) -> Iterator[tuple[int, int, memoryview]]:
    """(epoch microseconds, link type, frame bytes) of each record; ValueError on unknown content."""
    view = memoryview(data)
    magic = bytes(view[:4])
    if magic in _CLASSIC_MAGIC and len(view) >= 24:
        return _classic(view, *_CLASSIC_MAGIC[magic])
    if magic == b"\x0a\x0d\x0d\x0a":
        return _ng(view)
    raise ValueError("not a capture file")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("capture_id"), batch.column("content")):
            name, rows = path.as_py(), []
            try:
                for seq, (ts, link, frame) in enumerate(walk_records(content.as_buffer().to_pybytes())):
                    rows.append((name, seq, ts, len(frame), link, bytes(frame), None))
                    if len(rows) == _ROWS_PER_BATCH:
                        yield _batch(rows)
                        rows = []
            except (ValueError, IndexError, struct.error) as exc:
                rows.append((name, None, None, None, None, None, str(exc)))
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _FRAME_ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_FRAME_ARROW)


def frames_of(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Raw frames of the admitted files; where a file cannot be read any further it gives a row with ``error``."""
    admitted = files.where(rejection(F.col("path"), F.col("length"), max_bytes).isNull())
    return admitted.select(F.col("path").alias("capture_id"), "content").mapInArrow(_frames, FRAME_DDL)


def scan_captures(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Frames of all files below ``folder``, and one error row per file that is not admitted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rejected = list_captures(spark, folder, max_bytes).where("reason IS NOT NULL")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(FRAME_DDL).fields}
    errors = rejected.select(*[({**empty, "capture_id": F.col("path"), "error": F.col("reason")})[c].alias(c) for c in empty])
    return frames_of(files, max_bytes).unionByName(errors)


def stream_captures(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Frames of capture files as they land in ``folder``."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return frames_of(files)


def capture_status(spark: SparkSession, folder: str, frames: DataFrame, packets: DataFrame) -> DataFrame:
    """One row per listed file with its packet count and error text (null when usable)."""
    listed = list_captures(spark, folder).withColumnRenamed("path", "capture_id")
    broken = frames.where("error is not null").groupBy("capture_id").agg(F.first("error").alias("error"))
    counted = packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packets"))
    return (
        listed.join(broken, "capture_id", "left").join(counted, "capture_id", "left")
        .select(
            "capture_id", "length", F.coalesce("packets", F.lit(0).cast("bigint")).alias("packets"),
            F.coalesce("reason", "error", F.when(F.col("packets").isNull(), F.lit("no parseable IP/ARP packets found"))).alias("error"),
        )
    )
