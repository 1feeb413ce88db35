"""Token files coded by a static range asymmetric numeral system.

One table of token frequencies serves the whole corpus. Ids are cut into blocks that know nothing of each other;
in a block ``LANES`` coder states take turns over one stream of 32-bit words (interleaving). Every ``SEGMENT`` steps
the states and the place in the stream are noted (checkpoints), so that a reader starts at any of them: blocks and
segments decode in parallel, here as rows of one array operation. Each block carries the crc32 of its ids.

A token file is a folder: ``chunks``, a Parquet table in ascending doc_id order by (part, chunk), each row with the blocks of
about ``CHUNK_TOKENS`` ids and the ids and lengths of its documents, and ``frequencies``, one row with the shared table, the format it
was written in and its own crc32. The path alone is enough to read it, in any session. Writing through Spark's own writer
keeps half-written files of lost executors out; the frequencies are written last, so a folder without them is not complete.

Nulls and odd rows: a null or empty text is the end id alone; a null doc_id comes first in order; repeated rows are
written one after another; an empty table gives an empty file. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm import tokens
from packetloom.llm.common import shared_path, table, written

VOCABULARY = 49_408
SCALE_BITS = 20
LOW = 1 << 31
LANES = 32
STEPS = 1024
SEGMENT = 256
BLOCK = LANES * STEPS
CHUNK_TOKENS = 32 * BLOCK
MEMO = 300_000
MAGIC = b"RANS"
HEAD = "<4sIII"  # magic, ids, words, crc32 of the ids

IDS = "part int, chunk int, doc_ids array<long>, lengths array<long>, ids binary"
CHUNKS = "part int, chunk int, doc_ids array<long>, lengths array<long>, n_tokens long, blocks array<binary>"


FORMAT = [1, SCALE_BITS, LANES, STEPS, SEGMENT]
TABLE = "format array<int>, scaled binary, crc32 long"


class Frequencies:
    """Shares of 2^SCALE_BITS, at least 1 for every id that occurs."""

    def __init__(self, scaled: np.ndarray):
        self.freq = scaled.astype(np.uint64)
        self.start = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(scaled), dtype=np.uint16), scaled)

    @classmethod
    def of(cls, counts: np.ndarray) -> Frequencies:
        """Counts scaled to the sum."""
        total, room = int(counts.sum()), 1 << SCALE_BITS
        if not total:
            counts, total = np.bincount([0], minlength=len(counts)), 1
        scaled = np.where(counts > 0, np.maximum(1, counts * room // total), 0).astype(np.int64)
        most = np.argsort(-scaled, kind="stable")
        off = room - int(scaled.sum())
        at = 0
        while off:  # the largest give or take what rounding left; they change least by it
            i = most[at % max(1, np.count_nonzero(scaled > 1) or 1)]
            step = off if off > 0 else -min(-off, int(scaled[i]) // 2)
            scaled[i] += step
            off -= step
            at += 1
        return cls(scaled)

    def row(self) -> tuple:
        scaled = self.freq.astype("<u4").tobytes()
        return FORMAT, bytearray(scaled), zlib.crc32(scaled)

    @classmethod
    def from_row(cls, format_: list[int], scaled: bytes, crc32: int) -> Frequencies:
        if list(format_) != FORMAT:
            raise ValueError(f"written in format {list(format_)}, this reads {FORMAT}")
        if zlib.crc32(scaled) != crc32:
            raise ValueError("checksum of the frequency table differs")
        return cls(np.frombuffer(scaled, "<u4").astype(np.int64))


def encode(ids: np.ndarray, table: Frequencies) -> list[bytes]:
    """Blocks of up to ``BLOCK`` ids each; all blocks are coded side by side."""
    if not len(ids):
        return []
    n_blocks = -(-len(ids) // BLOCK)
    pad = int(np.argmax(table.freq))
    padded = np.full(n_blocks * BLOCK, pad, np.uint16)
    padded[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(n_blocks, STEPS, LANES).transpose(1, 0, 2))
    state = np.full((n_blocks, LANES), LOW, np.uint64)
    low, out = np.empty(steps.shape, np.uint32), np.empty(steps.shape, bool)
    marks = np.empty((STEPS // SEGMENT, n_blocks, LANES), np.uint64)
    down, bits, limit = np.uint64(32), np.uint64(SCALE_BITS), np.uint64(31 - SCALE_BITS + 32)
    for t in range(STEPS - 1, -1, -1):
        f, c = table.freq[steps[t]], table.start[steps[t]]
        full = state >= (f << limit)
        low[t], out[t] = state.astype(np.uint32), full
        state = np.where(full, state >> down, state)
        q = state // f
        state = (q << bits) + (state - q * f) + c
        if t % SEGMENT == 0:
            marks[t // SEGMENT] = state
    used = out.sum(axis=2).cumsum(axis=0)  # words up to and with each step
    blocks = []
    for b in range(n_blocks):
        mine = ids[b * BLOCK:(b + 1) * BLOCK]
        words = low[:, b][out[:, b]]
        at = np.array([0, *used[SEGMENT - 1:-1:SEGMENT, b]], np.uint32)
        blocks.append(struct.pack(HEAD, MAGIC, len(mine), len(words), zlib.crc32(mine.astype("<u4").tobytes()))
                      + at.tobytes() + np.ascontiguousarray(marks[:, b]).tobytes() + words.tobytes())
    return blocks


def decode(blocks: list[bytes], table: Frequencies) -> np.ndarray:
    """The ids of consecutive blocks; every segment of every block is decoded side by side."""
    n_segments = STEPS // SEGMENT
    heads, places, states, words, base = [], [], [], [], 0
    for block in blocks:
        magic, n, n_words, crc = struct.unpack_from(HEAD, block)
        if magic != MAGIC:
            raise ValueError("not a block of ids")
        at = struct.calcsize(HEAD)
        places.append(np.frombuffer(block, np.uint32, n_segments, at).astype(np.int64) + base)
        at += 4 * n_segments
        states.append(np.frombuffer(block, np.uint64, n_segments * LANES, at))
        at += 8 * n_segments * LANES
        words.append(np.frombuffer(block, np.uint32, n_words, at))
        heads.append((n, crc))
        base += n_words
    if not blocks:
        return np.empty(0, np.uint16)
    place, state = np.concatenate(places), np.concatenate(states).reshape(-1, LANES)
    stream = np.append(np.concatenate(words), np.uint32(0)).astype(np.uint64)
    out = np.empty((SEGMENT, *state.shape), np.uint16)
    mask, bits, up, low = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32), np.uint64(LOW)
    for t in range(SEGMENT):
        slot = state & mask
        s = table.symbol[slot]
        out[t] = s
        state = table.freq[s] * (state >> bits) + slot - table.start[s]
        empty = state < low
        taken = empty.cumsum(axis=1)
        # A damaged block may ask for words beyond the end; its checksum then tells.
        where = np.where(empty, np.minimum(place[:, None] + taken, len(stream)) - 1, len(stream) - 1)
        state = np.where(empty, (state << up) | stream[where], state)
        place = place + taken[:, -1]
    flat = out.transpose(1, 0, 2).reshape(len(blocks), BLOCK)
    parts = []
    for ids, (n, crc) in zip(flat, heads):
        if zlib.crc32(ids[:n].astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block of ids differs")
        parts.append(ids[:n])
    return np.concatenate(parts)


def _tokenised(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode_texts = tokens.batch_encoder(path, MEMO)
    task = TaskContext.get()
    part, chunk = task.partitionId() if task else 0, 0
    doc_ids, lengths, ids, waiting = [], [], [], 0

    def flush():
        nonlocal chunk, waiting
        row = {"part": [part], "chunk": [chunk], "doc_ids": [list(doc_ids)], "lengths": [list(lengths)], "ids": [np.concatenate(ids).tobytes()]}
        chunk, waiting = chunk + 1, 0
        for x in (doc_ids, lengths, ids):
            x.clear()
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([
            ("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())]))

    for batch in batches:
        for doc_id, found in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist())):
            own = tokens.with_end(found)
            doc_ids.append(doc_id)
            lengths.append(len(own))
            ids.append(own)
            waiting += len(own)
            if waiting >= CHUNK_TOKENS:
                yield flush()
    if ids:
        yield flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            counts += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=VOCABULARY)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["id", "n"])


def _coded(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            ids = np.frombuffer(one.column(4)[0].as_buffer(), "<u2")
            yield pa.RecordBatch.from_arrays(
                [*one.columns[:4], pa.array([len(ids)], pa.int64()), pa.array([encode(ids, table.value)], pa.list_(pa.binary()))],
                names=["part", "chunk", "doc_ids", "lengths", "n_tokens", "blocks"])


def write_token_file(docs: DataFrame, file: str | None = None, tokenizer: str | None = None) -> str:
    """Write the token file ``file`` (by default a new one in the shared folder); returns its path."""
    spark = docs.sparkSession
    path = tokenizer or tokens.tokenizer_path()
    file = (file or shared_path(spark, "token-file")).rstrip("/")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ids = written(ordered.mapInArrow(lambda b: _tokenised(b, path), IDS), "ids")
    # At most VOCABULARY rows reach the driver.
    counts = np.zeros(VOCABULARY, np.int64)
    for row in ids.select("ids").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    frequencies = Frequencies.of(counts)
    shared = spark.sparkContext.broadcast(frequencies)
    ids.mapInArrow(lambda b: _coded(b, shared), CHUNKS).write.option("compression", "uncompressed").parquet(f"{file}/chunks")
    spark.createDataFrame([frequencies.row()], TABLE).coalesce(1).write.parquet(f"{file}/frequencies")
    return file


def _read(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, doc_ids, lengths, blocks in zip(*(batch.column(i) for i in range(4))):
            ids = decode(blocks.as_py(), table.value).astype("<u4")
            lengths = np.asarray(lengths.values)
            stops = np.cumsum(lengths)
            starts = stops - lengths
            yield pa.RecordBatch.from_arrays(
                [doc_ids.values, pa.array(starts + first.as_py(), pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array([ids[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"])


def read_token_file(spark: SparkSession, file: str) -> DataFrame:
    """Per document its ids (little-endian unsigned 32-bit) and how many ids stand before it in the file."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{file}/chunks")
    shared = spark.sparkContext.broadcast(Frequencies.from_row(*spark.read.schema(TABLE).parquet(f"{file}/frequencies").first()))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_part_start"))
    starts = (
        chunks.select("part", "chunk", "n_tokens").withColumn("_in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(before_part, "part").select("part", "chunk", (F.col("_part_start") + F.col("_in_part")).alias("first"))
    )
    return chunks.join(starts, ["part", "chunk"]).select("first", "doc_ids", "lengths", "blocks").mapInArrow(
        lambda b: _read(b, shared), "doc_id long, start long, n_tokens long, ids binary")


def op5_rans_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = write_token_file(table(spark, sf_dir, "documents"))
    return read_token_file(spark, file).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
