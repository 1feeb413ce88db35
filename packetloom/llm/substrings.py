"""Removing repeated passages by a lookup of window hashes.

Every window of 50 words that may occur in several documents is looked up by its hash in a table (hash -> first document
that has it), and the words under windows that an earlier document has are removed. The table holds no places in its
documents and nothing is factored greedily: factors are derived afterwards, as stretches of neighbouring windows with one
first document, and need not be one copied run of it. They are for information; what is removed does not depend on them.
Windows are judged on the input, not on what is left.

Which windows can repeat at all is found by anchors (``shared_windows``); all other windows, and documents without any,
are never shipped. The index is a minimum per window hash, combined before the shuffle; a window's hash has 64 bits.

Nulls and odd rows: a null or empty text has no words and loses none; a null doc_id counts as larger than all others;
rows with the same doc_id do not remove each other's words; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read, other columns pass through :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import n_words, table, words, written
from packetloom.llm.shared_windows import NO_ID, WINDOW, Words, candidates, chained, minima

PARSED = "doc_id long, whole string, n_words long, n_removed long, kept string, factors array<struct<start: int, length: int, source: long>>"
_PARSED = pa.schema([
    ("doc_id", pa.int64()), ("whole", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("factors", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64())])))])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_key): doc_id is ``NO_ID`` for null, row_key a 64-bit hash of both."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()  # a repeated row has the same windows
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            ids, hashes, keys = [], [], []
            for doc_id, text, anchors, key in zip(part.column(0).to_pylist(), part.column(1), part.column(2), part.column(3).to_pylist()):
                if (doc_id, key) in seen:
                    continue
                seen.add((doc_id, key))
                units = Words.units(text.as_py())
                wanted = np.isin(minima(units, Words), np.asarray(anchors.values).view(np.uint64))
                if wanted.any():
                    found = np.unique(chained(units, WINDOW)[wanted])
                    ids.append(np.full(len(found), doc_id, np.int64))
                    keys.append(np.full(len(found), key, np.int64))
                    hashes.append(found.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, ids, keys)], names=["h", "doc_id", "row_key"])


def parse(words_: list[bytes], hashes: np.ndarray, sources: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(factors, removed): factors as (first word, words, source); ``hashes`` ascend and name windows with a source."""
    windows = chained(Words.hashed(words_), WINDOW)
    at = np.searchsorted(hashes, windows)
    at[at == len(hashes)] = 0
    starts = np.flatnonzero(hashes[at] == windows)
    source = sources[at[starts]]
    # A factor ends where the next window is not the neighbour, or has another source.
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (source[1:] != source[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts)) - 1
    removed = np.zeros(len(words_) + 1, np.int64)
    factors = []
    for i, j in zip(heads.tolist(), tails.tolist()):
        start, stop = int(starts[i]), int(starts[j]) + WINDOW
        factors.append((start, stop - start, int(source[i])))
        removed[start] += 1
        removed[stop] -= 1
    return factors, np.cumsum(removed)[:-1] > 0


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, hashes, sources in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            cut = Words.cut(text.as_py())
            hashes, sources = np.asarray(hashes.values).view(np.uint64), np.asarray(sources.values)
            if len(cut) < WINDOW:
                continue
            order = np.argsort(hashes)
            factors, removed = parse(cut, hashes[order], sources[order])
            kept = b" ".join([w for w, gone in zip(cut, removed.tolist()) if not gone]).decode()
            out.append((doc_id, hashlib.sha256(b" ".join(cut)).hexdigest(), len(cut), int(removed.sum()), kept,
                        [{"start": a, "length": b, "source": c} for a, b, c in factors]))
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARSED)], schema=_PARSED)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARSED)], schema=_PARSED)


def factored(docs: DataFrame) -> DataFrame:
    """Documents that lose words, once each: their doc_id (``NO_ID`` for null), the sha256 of their words, what is kept, factors."""
    found = written(candidates(keyed(docs), Words), "lz-candidates")
    windows = written(found.mapInArrow(_windows, "h long, doc_id long, row_key long"), "lz-windows")
    index = windows.groupBy("h").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_last")).where("source < _last")
    hits = windows.join(index, "h").where(F.col("doc_id") > F.col("source"))
    by_row = hits.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("h", "source")).alias("_hits"))
    met = found.select("doc_id", "text", "row_key").join(by_row, ["doc_id", "row_key"]).select("doc_id", "text", F.col("_hits.h").alias("h"), F.col("_hits.source").alias("source"))
    return met.mapInArrow(_parsed, PARSED).where("n_removed > 0").dropDuplicates(["doc_id", "whole"])


def _digest(text: Column) -> Column:
    return F.sha2(F.array_join(words(text), " "), 256)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; columns and other texts are unchanged.

    A text that loses words comes back as its kept words joined by one space, possibly empty. ``n_chars``, where there is
    such a column, follows the text.
    """
    cut = factored(docs).select(F.col("doc_id").alias("__id"), F.col("whole").alias("__whole"), F.col("kept").alias("__kept"))
    id_ = F.coalesce(F.col("d.doc_id").cast("long"), F.lit(NO_ID))
    same = (id_ == F.col("c.__id")) & (_digest(F.col("d.text")) == F.col("c.__whole"))
    joined = docs.alias("d").join(cut.alias("c"), same, "left")
    new = {"text": F.coalesce(F.col("c.__kept"), F.col("d.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("c.__kept").isNull(), F.col("d.n_chars")).otherwise(F.char_length("c.__kept")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns])


def op6_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = factored(docs).select("doc_id", "whole", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    all_docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), n_words(F.col("text")).alias("n_words"), _digest(F.col("text")).alias("whole"))
    return all_docs.join(cut, ["doc_id", "whole"], "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
