"""Which documents share a window of units (words or bytes) with another, found without shipping every window.

A window's anchor is the smallest hash among its grams, so equal windows have equal anchors. A document's anchors are
the different anchors of its windows, about one for every dozen positions. Anchors that occur in two rows or more are
the only ones whose windows can repeat. They are found in sorted, delta-coded lists by ranges of the hash: a task
flags what repeats among its own rows and sends each hash on once, so a passage in a third of all rows reaches a range
once per task. Hashes are cut to 48 bits; a clash only flags a window that is later found unique. As small hashes are
the likelier minima, ranges are cut by the odds of a minimum, so that all are about equally full.

A row is known by its ``row_key``, a 64-bit hash of doc_id and text: rows without an id, and texts that share one, keep
their anchors apart. Lists name their rows by numbers into a table of keys; number 0 marks a hash that has been flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 50
HASH_BITS = 48
GROUP_ANCHORS = 2_000_000
TOGETHER_UNITS = 40_000
#: Stands for a null doc_id: such a row is smaller than no other.
NO_ID = (1 << 63) - 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every ``width`` neighbours; join must not mind overlaps."""
    size, cur = 1, x
    while size * 2 <= width:
        cur = join(cur[:-size], cur[size:])
        size *= 2
    n = len(x) - width + 1
    return cur[:n] if size == width else join(cur[:n], cur[width - size:width - size + n])


def chained(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` neighbours."""
    n, out, done, size, cur, base = len(x) - width + 1, None, 0, 1, x, int(_ODD)
    left = width
    while left:
        if left & 1:
            part = cur[done:done + n]
            out = part if out is None else out * np.uint64(base) + part
            done += size
        left >>= 1
        if left:
            cur = cur[:-size] * np.uint64(base) + cur[size:]
            base = base * base % (1 << 64)
            size *= 2
    return mixed(out)


class Words:
    """A text as the hashes of its words."""

    gram = 8

    @staticmethod
    def cut(text: str | None) -> list[bytes]:
        return text.encode().split() if text else []

    @staticmethod
    def hashed(words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))

    @classmethod
    def units(cls, text: str | None) -> np.ndarray:
        return cls.hashed(cls.cut(text))

    @classmethod
    def grams(cls, units: np.ndarray) -> np.ndarray:
        return chained(units, cls.gram)


class Bytes:
    """A text as its UTF-8 bytes."""

    gram = 24

    @staticmethod
    def units(text: str | None) -> np.ndarray:
        return np.frombuffer((text or "").encode(), np.uint8)

    @classmethod
    def grams(cls, units: np.ndarray) -> np.ndarray:
        eight = eights(units)
        n = len(units) - cls.gram + 1
        h = eight[:n] * _ODD
        h ^= eight[8:n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = mixed(h) + eight[16:n + 16] * np.uint64(0x165667B19E3779F9)
        return mixed(h)


def eights(units: np.ndarray) -> np.ndarray:
    """Every eight neighbouring bytes as one number."""
    return np.lib.stride_tricks.as_strided(units[:8].view(np.uint64), (len(units) - 7,), (1,)).copy()


def minima(units: np.ndarray, kind) -> np.ndarray:
    """The anchor of every window; empty if there is no whole window."""
    if len(units) < WINDOW:
        return np.empty(0, np.uint64)
    return sliding(kind.grams(units) >> np.uint64(64 - HASH_BITS), WINDOW - kind.gram + 1, np.minimum)


def joined_windows(texts: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, anchor of each window, whether it lies in one text, ends) of texts given as units, one behind the other."""
    flat, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    found = minima(flat, kind)
    whole = np.ones(len(found), bool)
    for end in ends.tolist():
        whole[max(0, end - WINDOW + 1):end] = False  # windows that reach into the next text
    return flat, found, whole, ends


def anchors_of(texts: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, number of the text): one for each run of windows of a text with the same anchor."""
    _, found, whole, ends = joined_windows(texts, kind)
    head = whole.copy()
    head[1:] &= (found[1:] != found[:-1]) | ~whole[:-1]
    at = np.flatnonzero(head)
    return found[at], np.searchsorted(ends, at, side="right")


def ranges(hashes: np.ndarray, grams: int, buckets: int) -> np.ndarray:
    """The range of each hash that is the smallest of so many; ranges are equally likely and in order of the hash."""
    share = -np.expm1(grams * np.log1p(-np.minimum(hashes.astype(np.float64) / 2.0 ** HASH_BITS, 1 - 2.0 ** -53)))
    return np.minimum((share * buckets).astype(np.int64), buckets - 1)


def n_ranges(spark: SparkSession) -> int:
    """Ranges are equally full; each list of a range names its rows, so that many short lists would take more room."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)


def planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal rank side by side."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def from_planes(raw: np.ndarray, kind, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).reshape(-1).view(kind)


FLAGGED = 0


def _pack(hashes: np.ndarray, numbers: np.ndarray, keys: np.ndarray) -> bytes:
    """Sorted hashes and the numbers of their rows, small where neighbours are close; only the keys that are named."""
    import zstandard

    named, own = np.unique(np.append(numbers, FLAGGED), return_inverse=True)
    raw = np.array([len(hashes), len(named) - 1], np.int64).tobytes() + planes(np.diff(hashes, prepend=np.uint64(0))) + planes(
        own[:-1].astype(np.uint32)) + planes(keys[named[1:] - 1])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row keys, flagged); the key of a flagged hash is 0."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, m = raw[:16].view(np.int64).tolist()
    deltas, numbers = from_planes(raw[16:16 + 8 * n], np.uint64, n), from_planes(raw[16 + 8 * n:16 + 12 * n], np.uint32, n)
    keys = np.append(np.zeros(1, np.int64), from_planes(raw[16 + 12 * n:], np.int64, m))
    return np.cumsum(deltas, dtype=np.uint64), keys[numbers], numbers == FLAGGED


_SCHEMA = pa.schema([("bucket", pa.int64()), ("row_key", pa.int64()), ("anchors", pa.list_(pa.int64())), ("blob", pa.binary())])


def per_row(h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its different hashes)"""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    cuts = np.flatnonzero(np.diff(rows)) + 1
    return ((int(a[0]), np.unique(b).view(np.int64)) for a, b in zip(np.split(rows, cuts), np.split(h, cuts)) if len(a))


def _grouped(batches: Iterator[pa.RecordBatch], kind, buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, owners, keys_of, waiting = [], [], [], 0
    texts, units = [], 0

    def cut():
        nonlocal waiting, units
        if texts:
            found, number = anchors_of(texts, kind)
            hashes.append(found)
            owners.append(number + (len(keys_of) - len(texts) + 1))
            waiting += len(found)
        texts.clear()
        units = 0

    def flush():
        nonlocal waiting
        h = np.concatenate(hashes)
        keys, numbers = np.array(keys_of, np.int64), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, numbers = h[order], numbers[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (numbers[1:] != numbers[:-1])
        h, numbers = h[once], numbers[once]
        same = h[1:] == h[:-1]
        repeats = np.append(same, False) | np.insert(same, 0, False)
        rows = [(-1 - k % 65536, k, own, None) for k, own in per_row(h[repeats], keys[numbers[repeats] - 1])]
        first = np.insert(~same, 0, True)
        h, numbers = h[first], np.where(repeats[first], FLAGGED, numbers[first])
        at = ranges(h, WINDOW - kind.gram + 1, buckets)
        cuts = np.searchsorted(at, np.arange(buckets + 1))
        rows += [(b, None, None, _pack(h[i:j], numbers[i:j], keys)) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
        hashes.clear()
        owners.clear()
        keys_of.clear()
        waiting = 0
        for i in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 5000]), _SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        for row_key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = kind.units(text.as_py())
            if len(own) >= WINDOW:
                keys_of.append(row_key)
                texts.append(own)
                units += len(own)
                if units >= TOGETHER_UNITS:
                    cut()
                    if waiting >= GROUP_ANCHORS:
                        yield from flush()
    cut()
    if waiting:
        yield from flush()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their bucket -> (row_key, anchors that repeat)."""
    current, parts, out = None, [], []

    def finish():
        if len(parts) > 1:
            h, keys, flagged = (np.concatenate(x) for x in zip(*[_unpack(p) for p in parts]))
            order = np.argsort(h, kind="stable")
            h, keys, flagged = h[order], keys[order], flagged[order]
            same = h[1:] == h[:-1]
            wanted = (np.append(same, False) | np.insert(same, 0, False)) & ~flagged
            out.extend(per_row(h[wanted], keys[wanted]))
        parts.clear()

    def flush():
        ids, lists = zip(*out) if out else ((), ())
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["row_key", "anchors"])
        out.clear()
        return batch

    for batch in batches:
        for bucket, row_key, anchors, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if bucket < 0:
                out.append((row_key, np.asarray(anchors.values)))
            else:
                if bucket != current:
                    finish()
                    current = bucket
                parts.append(blob.as_py())
            if len(out) >= 20_000:
                yield flush()
    finish()
    yield flush()


def shared_anchors(docs: DataFrame, kind) -> DataFrame:
    """(row_key, text) -> (row_key, anchors): per row its anchors that another row has as well."""
    spark = docs.sparkSession
    buckets = n_ranges(spark)
    rows = docs.select("row_key", "text").mapInArrow(
        lambda b: _grouped(b, kind, buckets), "bucket long, row_key long, anchors array<long>, blob binary")
    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "row_key long, anchors array<long>")
    return met.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"))


def candidates(docs: DataFrame, kind) -> DataFrame:
    """Rows of (doc_id, text, row_key) that may share a window with another row, with their repeated anchors."""
    return docs.where("text IS NOT NULL").join(shared_anchors(docs, kind).withColumnRenamed("row_key", "_key"), F.col("row_key") == F.col("_key")).select(
        "doc_id", "text", "anchors", "row_key")
