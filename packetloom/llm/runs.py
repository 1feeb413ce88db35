"""Removing repeated byte passages by a run-length index.

The windows of 50 bytes that may repeat are cut out as strings, one per stretch of windows with the same smallest gram, so
that equal windows always meet in the same range of gram hashes. Per range the different strings are indexed: their
windows, in order of their first eight bytes, then of the hash of all fifty, then of document and place, give a
Burrows-Wheeler transform of bounded context that is kept as runs; a run also ends where the fifty bytes change, and run
heads carry a sample (document of the row). As rows of equal context are in document order, the sample at the head of a
context names the first document with it. Matching statistics, capped at 50, are then streamed: each window of each string
is put to the index, and where its match of 50 bytes has a sample of a smaller document it is a long match. Long matches
of all strings, merged, are the removed spans.

Where a task meets one string in several documents, all but the first are long matches at once, and the string is sent on
for its first document alone: a passage in a third of all rows reaches its range once per task. Strings travel packed by
range. A string's windows need no more than their 50 bytes, and neighbours of equal hash are compared byte by byte.

Nulls and odd rows: a null or empty text has no bytes; a null doc_id counts as larger than all others; rows with the
same doc_id do not remove each other's bytes (rows are told apart by doc_id and a 64-bit hash of the text); an
empty table gives an empty result. Only ``doc_id`` and ``text`` are read. Bytes that are kept may begin or end inside a
character, as windows are of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table
from packetloom.llm.shared_windows import (
    NO_ID, TOGETHER_UNITS, WINDOW, Bytes, candidates, eights, from_planes, joined_windows, minima, mixed, n_ranges, planes, ranges)
from packetloom.llm.substrings import keyed

BATCH_BYTES = 2_000_000
GROUP_BYTES = 12_000_000
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<int>, stops array<int>, whole string"
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept", pa.binary()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("whole", pa.string())])


class Grouping(Bytes):
    """Shorter grams give longer stretches; they only have to group windows, not to tell them apart."""

    gram = 16

    @classmethod
    def grams(cls, units: np.ndarray) -> np.ndarray:
        eight = eights(units)
        n = len(units) - cls.gram + 1
        return mixed(mixed(eight[:n] * np.uint64(0xC2B2AE3D27D4EB4F)) + eight[8:n + 8] * np.uint64(0x165667B19E3779F9))


def stretches(texts: list[np.ndarray], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, first window, last window, group) of each stretch of repeatable windows with one smallest gram.

    An anchor that repeats does so for every text that has it, so ``anchors`` may be those of all the texts.
    """
    flat, found, whole, ends = joined_windows(texts, Bytes)
    none = np.empty(0, np.int64)
    if not len(found) or not len(anchors):
        return none, none, none, np.empty(0, np.uint64)
    runs = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    wanted = np.flatnonzero(np.repeat(np.isin(found[runs], anchors), np.diff(runs, append=len(found))) & whole)
    if not len(wanted):
        return none, none, none, np.empty(0, np.uint64)
    group = minima(flat, Grouping)[wanted]
    new = np.ones(len(wanted), bool)
    new[1:] = (np.diff(wanted) != 1) | (group[1:] != group[:-1])
    heads = np.flatnonzero(new)
    first, last = wanted[heads], wanted[np.append(heads[1:], len(wanted)) - 1]
    number = np.searchsorted(ends, first, side="right")
    start = ends[number] - np.array([len(t) for t in texts])[number]
    return number, first - start, last - start, group[heads]


_SENT = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("spans", pa.list_(pa.int64())), ("blob", pa.binary())])
SENT = "bucket long, doc_id long, row_key long, spans array<long>, blob binary"


_NUMBERS = (np.int32, np.uint8, np.int32, np.int32)


def _pack(strings: list[bytes], parts: np.ndarray, docs: np.ndarray, keys: np.ndarray, places: np.ndarray) -> bytes:
    """One entry per string and place: which part of the range it belongs to, the number of its row, its place; and the rows."""
    import zstandard

    rows, number = np.unique(np.stack((docs, keys), 1), axis=0, return_inverse=True)
    lengths = np.array([len(x) for x in strings], np.int32)
    numbers = (lengths, parts, number.reshape(-1).astype(np.int32), places)
    raw = np.array([len(strings), len(rows)], np.int64).tobytes() + b"".join(planes(np.ascontiguousarray(x)) for x in (
        *numbers, rows[:, 0], rows[:, 1])) + b"".join(strings)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, found = 16, []
    for kind, count in (*((k, n) for k in _NUMBERS), (np.int64, m), (np.int64, m)):
        size = np.dtype(kind).itemsize * count
        found.append(from_planes(np.frombuffer(raw, np.uint8, size, at), kind, count))
        at += size
    lengths, parts, number, places, docs, keys = found
    ends = (at + np.cumsum(lengths)).tolist()
    return [raw[a:b] for a, b in zip([at, *ends], ends)], parts, docs[number], keys[number], places


def _sent(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Candidate documents -> long matches seen in the task, and the different strings by ranges of their group."""
    first: dict[bytes, list] = {}  # string -> [document, group, (row key, place), ...]
    seen: set[tuple[int, int]] = set()  # a repeated row has the same strings
    matched: dict[tuple[int, int], list[int]] = {}
    size = 0

    def match(string: bytes, doc_id: int, places) -> None:
        for key, at in places:
            matched.setdefault((doc_id, key), []).append(at << 32 | at + len(string))

    def flush():
        rows = [(-1 - key % 65536, doc_id, key, spans, None) for (doc_id, key), spans in matched.items()]
        if first:
            strings = [s for s, entry in first.items() for _ in entry[2:]]
            docs, groups, keys, places = (np.array(x, t) for x, t in zip(
                zip(*[(e[0], e[1], key, at) for e in first.values() for key, at in e[2:]]), (np.int64, np.uint64, np.int64, np.int32)))
            at = ranges(groups, WINDOW - Grouping.gram + 1, buckets)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(buckets + 1))
            parts = (groups & np.uint64(255)).astype(np.uint8)
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                if j > i:
                    own = order[i:j]
                    rows.append((b, None, None, None, _pack([strings[x] for x in own.tolist()], parts[own], docs[own], keys[own], places[own])))
        first.clear()
        matched.clear()
        for i in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 5000]), _SENT)], schema=_SENT)

    waiting: list[tuple] = []
    units = 0

    def take():
        nonlocal size, units
        if waiting:
            anchors = np.unique(np.concatenate([w[3] for w in waiting])).view(np.uint64)
            number, starts, last, group = stretches([np.frombuffer(w[1], np.uint8) for w in waiting], anchors)
            for i, a, b, g in zip(number.tolist(), starts.tolist(), (last + WINDOW).tolist(), group.tolist()):
                doc_id, raw, key, _ = waiting[i]
                string = raw[a:b]
                entry = first.get(string)
                if entry is None:
                    first[string] = [doc_id, g, (key, a)]
                    size += b - a
                elif doc_id == entry[0]:
                    entry.append((key, a))
                elif doc_id > entry[0]:
                    match(string, doc_id, [(key, a)])
                else:
                    match(string, entry[0], entry[2:])
                    first[string] = [doc_id, g, (key, a)]
        waiting.clear()
        units = 0

    for batch in batches:
        for doc_id, text, anchors, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            if (doc_id, key) in seen:
                continue
            seen.add((doc_id, key))
            raw = text.as_py().encode()
            waiting.append((doc_id, raw, key, np.asarray(anchors.values)))
            units += len(raw)
            if units >= TOGETHER_UNITS:
                take()
                if size >= GROUP_BYTES:
                    yield from flush()
                    size = 0
    take()
    yield from flush()


class RunLengthIndex:
    """Runs of the transform over ``strings`` (bytes, first document), with a sample at each run's head."""

    def __init__(self, strings: list[bytes], docs: np.ndarray):
        lengths = np.array([len(s) for s in strings])
        text = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        ends = np.cumsum(lengths)
        self.counts = lengths - WINDOW + 1
        self.places = np.repeat(ends - lengths - np.cumsum(self.counts) + self.counts, self.counts) + np.arange(self.counts.sum())
        eight = eights(text)
        words = [eight[self.places + at] for at in (0, 8, 16, 24, 32, 40, WINDOW - 8)]
        context = words[0]
        for w in words[1:]:
            context = mixed(context * np.uint64(0x9E3779B97F4A7C15) + w)
        owner = np.repeat(docs, self.counts)
        # Rows: by the next bytes, then document, then place.
        rows = np.lexsort((owner, context, words[0].byteswap()))
        self.row_of = np.empty(len(rows), np.int64)
        self.row_of[rows] = np.arange(len(rows))
        changed = np.ones(len(rows), bool)
        changed[1:] = False
        for w in words:
            w = w[rows]
            changed[1:] |= w[1:] != w[:-1]
        is_first = np.zeros(len(text), bool)
        is_first[ends - lengths] = True
        letters = np.where(is_first[self.places], 256, text[np.maximum(self.places - 1, 0)].astype(np.int64))[rows]
        new = changed.copy()
        new[1:] |= letters[1:] != letters[:-1]
        self.heads = np.flatnonzero(new)  # first row of each run
        self.letters = letters[self.heads]
        self.samples = owner[rows[self.heads]]  # document at each run's head
        self.context_run = np.maximum.accumulate(np.where(changed[self.heads], np.arange(len(self.heads)), 0))

    def first_of_windows(self) -> np.ndarray:
        """For each window of all strings the first document with its 50 bytes (streamed over all windows)."""
        run = np.searchsorted(self.heads, self.row_of, side="right") - 1
        return self.samples[self.context_run[run]]

    def first_documents(self) -> list[np.ndarray]:
        """:meth:`first_of_windows` per string."""
        return np.split(self.first_of_windows(), np.cumsum(self.counts)[:-1])


def long_spans(index: RunLengthIndex, number: np.ndarray, docs: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """The long matches of entries (number of the string, document, row, place), one list of spans per row."""
    counts = index.counts[number]
    ends = np.cumsum(counts)
    window = np.repeat((np.cumsum(index.counts) - index.counts)[number] - ends + counts, counts) + np.arange(counts.sum())
    gone = index.first_of_windows()[window] < np.repeat(docs, counts)
    # Where a stretch of long matches begins and ends; entries do not run into each other.
    first, last = gone.copy(), gone.copy()
    inner = np.ones(len(gone), bool)
    inner[ends - counts] = False
    first[1:] &= ~(gone[:-1] & inner[1:])
    last[:-1] &= ~(gone[1:] & inner[1:])
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    entry = np.searchsorted(ends, first, side="right")
    shift = places[entry] - ends[entry] + counts[entry]
    spans = (first + shift) << 32 | (last + shift + WINDOW)
    order = np.lexsort((spans, keys[entry], docs[entry]))
    docs, keys, spans = docs[entry][order], keys[entry][order], spans[order]
    new = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1]))) if len(spans) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(spans)).astype(np.int32)), pa.array(spans))
    return pa.RecordBatch.from_arrays([pa.array(docs[new]), pa.array(keys[new]), lists], names=["doc_id", "row_key", "spans"])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their range -> (doc_id, row_key, spans) of the long matches."""
    current, blobs, out = None, [], []

    def batches_of(strings, parts, docs, keys, places):
        """The range's entries, a few parts at a time: equal windows are in one part."""
        order = np.argsort(parts, kind="stable")
        sizes = np.array([len(strings[i]) for i in order.tolist()])
        part, total, start = parts[order], 0, 0
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(order))
        for end in ends.tolist():
            total = int(sizes[start:end].sum())
            if total >= BATCH_BYTES or end == len(order):
                own = order[start:end]
                yield [strings[i] for i in own.tolist()], docs[own], keys[own], places[own]
                start = end

    def finish():
        if blobs:
            unpacked = [_unpack(b) for b in blobs]
            strings = [s for u in unpacked for s in u[0]]
            for some, docs, keys, places in batches_of(strings, *(np.concatenate(x) for x in list(zip(*unpacked))[1:])):
                different: dict[bytes, int] = {}
                number = [different.setdefault(s, len(different)) for s in some]
                least = np.full(len(different), NO_ID)
                np.minimum.at(least, number, docs)
                yield long_spans(RunLengthIndex(list(different), least), np.array(number), docs, keys, places.astype(np.int64))
        blobs.clear()

    def flush():
        columns = list(zip(*out)) if out else [()] * 3
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))],
                                           names=["doc_id", "row_key", "spans"])
        out.clear()
        return batch

    for batch in batches:
        for bucket, doc_id, key, spans, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
            if bucket < 0:
                out.append((doc_id, key, np.asarray(spans.values)))
            else:
                if bucket != current:
                    yield from finish()
                    current = bucket
                blobs.append(blob.as_py())
            if len(out) >= 20_000:
                yield flush()
    yield from finish()
    yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw, spans = text.as_py().encode(), np.asarray(spans.values)
            if (spans & 0xFFFFFFFF > len(raw)).any():
                raise RuntimeError(f"spans of another text came to doc_id {doc_id}: two row keys are equal")
            marks = np.bincount(spans >> 32, minlength=len(raw) + 1) - np.bincount(spans & 0xFFFFFFFF, minlength=len(raw) + 1)
            removed = np.cumsum(marks[:-1]) > 0
            edges = np.flatnonzero(np.diff(removed, prepend=False, append=False))
            kept = np.frombuffer(raw, np.uint8)[~removed].tobytes()
            out.append((doc_id, len(raw), int(removed.sum()), len(edges) // 2, kept, edges[::2], edges[1::2], hashlib.sha256(raw).hexdigest()))
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _CUT)], schema=_CUT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _CUT)], schema=_CUT)


def long_matches(docs: DataFrame) -> DataFrame:
    """Rows that lose bytes: the removed spans, what is kept, and the sha256 of the whole text."""
    docs = keyed(docs).where("text IS NOT NULL")
    buckets = n_ranges(docs.sparkSession)
    sent = candidates(docs, Bytes).mapInArrow(lambda b: _sent(b, buckets), SENT)
    matched = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_matched, "doc_id long, row_key long, spans array<long>")
    # As in ``candidates`` the texts are dealt by row_key alone, so that both joins read one exchange.
    lists = matched.groupBy(F.col("row_key").alias("_key")).agg(F.collect_list(F.struct("doc_id", "spans")).alias("_lists"))
    own = F.filter("_lists", lambda x: x["doc_id"] == F.col("doc_id"))
    met = docs.join(lists, F.col("row_key") == F.col("_key")).select("doc_id", "text", F.flatten(F.transform(own, lambda x: x["spans"])).alias("spans"))
    return met.mapInArrow(_cut, CUT).where("n_removed > 0")


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = long_matches(docs).select("doc_id", "whole", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    cut = digests.dropDuplicates(["doc_id", "whole"])
    text = F.coalesce("text", F.lit(""))
    all_docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return all_docs.join(cut, ["doc_id", "whole"], "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
