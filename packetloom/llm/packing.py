"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Documents are cut into full windows of ``capacity`` tokens and a rest. Rests are packed in groups of about
``GROUP_WINDOWS`` windows: every rest starts as a partial partition with one filled slot; the two partitions of
largest imbalance are merged, fullest slot to emptiest, until one is left. The number of slots is the least that
can hold the group and rises when the group exceeds the capacity. Differencing levels the windows but cannot meet
a capacity exactly, so what stands over in a window is cut off and laid into the windows that are below the level.

Groups are formed from consecutive rows of one task, so there is no shuffle and a task holds one group at a time.
A partition wastes less than one window per group, and the sequence ids of a task start at its partition number
times 2^32.

Nulls and odd rows: a null or empty text is one token, the end id; a null doc_id is kept; repeated rows are packed
each on its own; an empty table gives no pieces. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import tokens
from packetloom.llm.common import table

CAPACITY = 2048
GROUP_WINDOWS = 256
#: Packing moves nothing, so its tasks can afford larger word tables.
MEMO = 300_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` slots of near-equal sums."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i]]))  # sums descend; slots behind the listed ones are empty
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, a_slots = heapq.heappop(heap)
        _, _, b, b_slots = heapq.heappop(heap)
        sums = a + b[::-1]
        slots = a_slots + [[] for _ in range(k - len(a_slots))]
        for j, items in enumerate(b_slots):
            if items:
                slots[k - 1 - j] = slots[k - 1 - j] + items
        by_size = np.argsort(-sums, kind="stable")
        sums = sums[by_size]
        slots = [slots[j] for j in by_size.tolist()]
        while slots and not slots[-1]:
            slots.pop()
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums - sums[-1], slots))
        order += 1
    slots = heap[0][3] if heap else []
    return slots + [[] for _ in range(k - len(slots))]


def fill(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, from, to), each of at most ``capacity`` tokens."""
    total = sum(sizes)
    if not total:
        return []
    k = -(-total // capacity)
    level = -(-total // k)
    windows, over = [], []
    for slot in difference(sizes, k):
        pieces = [(i, 0, sizes[i]) for i in sorted(slot)]
        excess = sum(sizes[i] for i in slot) - level
        if excess + level > capacity:
            # Cut from the largest pieces, so that small documents stay whole.
            for at in sorted(range(len(pieces)), key=lambda j: -pieces[j][2]):
                i, start, stop = pieces[at]
                cut = min(excess, stop - start)
                pieces[at] = (i, start, stop - cut)
                over.append((i, stop - cut, stop))
                excess -= cut
                if not excess:
                    break
        windows.append([p for p in pieces if p[2] > p[1]])
    for limit in (level, capacity):
        for pieces in windows:
            room = limit - sum(stop - start for _, start, stop in pieces)
            while over and room > 0:
                i, start, stop = over.pop()
                take = min(room, stop - start)
                pieces.append((i, start, start + take))
                room -= take
                if start + take < stop:
                    over.append((i, start + take, stop))
    return [w for w in windows if w]


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, group_windows: int) -> Iterator[pa.RecordBatch]:
    encode = tokens.encoder(path, MEMO)
    task = TaskContext.get()
    sequence = (task.partitionId() if task else 0) << 32
    rests: list[tuple[int | None, np.ndarray, int]] = []
    waiting = 0
    out: list[tuple] = []

    def piece(doc_id, ids, start, stop, sequence_id, offset):
        out.append((doc_id, start, stop - start, len(ids), sequence_id, offset, ids[start:stop].astype("<u4").tobytes()))

    def pack_group():
        nonlocal sequence, waiting
        for window in fill([len(ids) - start for _, ids, start in rests], capacity):
            offset = 0
            for i, a, b in window:
                doc_id, ids, start = rests[i]
                piece(doc_id, ids, start + a, start + b, sequence, offset)
                offset += b - a
            sequence += 1
        rests.clear()
        waiting = 0

    def flush():
        columns = list(zip(*out)) if out else [()] * 7
        types = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = tokens.with_end(encode(text.as_py()))
            full = len(ids) // capacity * capacity
            for start in range(0, full, capacity):
                piece(doc_id, ids, start, start + capacity, sequence, 0)
                sequence += 1
            if full < len(ids):
                rests.append((doc_id, ids, full))
                waiting += len(ids) - full
                if waiting >= group_windows * capacity:
                    pack_group()
            if len(out) >= 2000:
                yield flush()
    pack_group()
    yield flush()


def pack(docs: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, tokenizer: str | None = None) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit) and their place in a sequence."""
    path = tokenizer or tokens.tokenizer_path()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _packed(batches, path, capacity, group_windows), PIECES)


def pieces_with_crc(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_with_crc(table(spark, sf_dir, "documents"))
