"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, one per majority over the XXH64 of the text's word shingles. Two fingerprints that differ
in at most ``K`` = 3 bits are linked. They are cut into two segments of 32 bits, so that one segment differs in at
most one bit: each segment is indexed with every single bit replaced by a wildcard (2 x 32 keys), linked fingerprints
share a key, and the pairs that a key brings together are verified on all 64 bits.

Only different fingerprints enter the index; a key's fingerprints become a spanning forest of their links, never all
pairs. A key with more than ``HOT`` fingerprints is refined: its fingerprints agree on 31 bits, so the other 33 are
cut into four pieces, of which one must be equal in a linked pair, and each piece makes a key of its own, again and
again. Each refinement leaves at least a quarter fewer free bits, so a key's fingerprints are bounded by the free bits
it has left, and no link is lost.

Nulls and odd rows: a null or empty text has the fingerprint 0 and is linked like any other; texts shorter than a
shingle are one shingle; repeated rows share a component; a null doc_id gets a component but never names one, unless
no other id is reachable (then null). An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table, written
from packetloom.llm.links import components

SHINGLE = 3
SEED = 42
K = 3
HOT = 4096
#: Free bits of a key below which it cannot hold more than HOT fingerprints.
FEW_BITS = 12
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit majority fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    # bytes.split() cuts at ASCII white space only, which is the definition of a word here.
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()[shingle - 1:]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a part of the shingles at a time bounds the memory
        bits = np.unpackbits(hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    majority = 2 * set_bits > len(hashes)
    return int.from_bytes(np.packbits(majority).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
        rest = batch.columns[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *rest], names=["doc_id", "fp", "digest"][:2 + len(rest)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digest: Column | None = None) -> DataFrame:
    """(doc_id, fp), and the digest if one is given; fp holds the 64 bits in a signed long."""
    rest = [] if digest is None else [digest.alias("digest")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest).mapInArrow(
        lambda b: _fingerprints(b, shingle), "doc_id long, fp long" + ", digest string" * len(rest))


def _bits(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)


def _variants(fp: Column) -> Column:
    """Per segment and wildcard: (free bits of the pair, key)."""
    keys = []
    for segment in (0, 32):
        inside = ((1 << 32) - 1) << segment
        for bit in range(segment, segment + 32):
            fixed = inside & ~(1 << bit)
            keys.append(F.struct(F.lit(bit).alias("free"), fp.bitwiseAND(_bits(fixed)).alias("key")))
    return F.array(*keys)


def _forest(members: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Links (indices) that span the groups of ``members`` (uint64) chained by at most ``k`` differing bits."""
    left = np.arange(len(members))
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(members[left] ^ members[at]) <= k
            if near.any():
                reached = left[near].tolist()
                a += [at] * len(reached)
                b += reached
                front += reached
                left = left[~near]
    return a, b


def _spanned(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        values = np.asarray(lists.values).view(np.uint64)
        ends = np.asarray(lists.offsets)
        a, b = [], []
        for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
            members = np.unique(values[start:stop])
            i, j = _forest(members, k)
            a.append(members[i])
            b.append(members[j])
        whole = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in whole], names=["a", "b"])


def _links_of(keyed: DataFrame, k: int) -> DataFrame:
    """(key columns, fp) -> links, for keys that few fingerprints share."""
    keys = [c for c in keyed.columns if c != "fp"]
    met = keyed.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return met.mapInArrow(lambda b: _spanned(b, k), "a long, b long").distinct()


def _pieces(mask: int) -> list[int]:
    """The bits of a mask dealt into four masks; one of them is equal in a pair with at most three differing bits."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[i::K + 1]) for i in range(K + 1)]


def _refined(hot: DataFrame, k: int, hot_rows: int) -> DataFrame:
    """Links among the fingerprints of hot keys: keys get longer until few fingerprints share each."""
    links = None
    # What is free in the first key: the other segment and the wildcard bit.
    masks = {bit: ((1 << 64) - 1) & ~((((1 << 32) - 1) << (bit // 32 * 32)) & ~(1 << bit)) for bit in range(64)}
    level = hot.select(F.col("free").cast("string").alias("path"), F.col("key").cast("string").alias("key"), "fp")
    paths = {str(bit): mask for bit, mask in masks.items()}
    for _ in range(10):
        present = [r["path"] for r in level.select("path").distinct().collect()]  # at most 64 * 4^depth names
        parts, deeper = [], {}
        for path in present:
            for i, piece in enumerate(_pieces(paths[path])):
                deeper[f"{path}.{i}"] = paths[path] & ~piece
                parts.append((path, f"{path}.{i}", piece))
        lookup = F.create_map(*[x for p in present for x in (F.lit(p), F.array(*[
            F.struct(F.lit(q).alias("path"), _bits(m).alias("mask")) for o, q, m in parts if o == p]))])
        longer = written(
            level.withColumn("_to", F.explode(F.element_at(lookup, F.col("path")))).select(
                F.col("_to.path").alias("path"),
                F.concat_ws(":", "key", F.col("fp").bitwiseAND(F.col("_to.mask")).cast("string")).alias("key"), "fp"), "simhash-level")
        sizes = longer.groupBy("path", "key").agg(F.count("*").alias("n"))
        few = [p for p, mask in deeper.items() if mask.bit_count() <= FEW_BITS]
        full = sizes.where((F.col("n") > hot_rows) & ~F.col("path").isin(few)).select("path", "key")
        found = _links_of(longer.join(full, ["path", "key"], "left_anti"), k)
        links = found if links is None else links.union(found)
        level = written(longer.join(full, ["path", "key"], "left_semi"), "simhash-level")
        if level.isEmpty():
            return links
        paths = deeper
    raise RuntimeError("hot keys did not get smaller")


def links(distinct: DataFrame, k: int = K, hot_rows: int = HOT) -> DataFrame:
    """(fp) of different fingerprints -> pairs (a, b) that chain all that differ in at most ``k`` bits."""
    if not 0 <= k <= K:  # two segments and four pieces find every pair of at most three differing bits, not more
        raise ValueError(f"k must be from 0 to {K}, not {k}")
    # 64 rows come of each fingerprint: a table of few bytes must not mean few tasks.
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    low = F.lit((1 << 32) - 1)
    halves = distinct.select(F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(low).alias("half")),
        F.struct(F.lit(32).alias("seg"), F.shiftrightunsigned("fp", 32).alias("half")))).alias("s")).select("s.*")
    # A key has two halves as members, so it can be hot only if one of them is in more than hot_rows / 2 fingerprints.
    full = written(halves.groupBy("seg", "half").count().where(F.col("count") > hot_rows // 2), "simhash-hot")
    keyed = distinct.select(F.explode(_variants(F.col("fp"))).alias("v"), "fp").select("v.free", "v.key", "fp")
    if full.isEmpty():
        return _links_of(keyed, k)
    hot_keys = written(full.withColumn("free", F.explode(F.sequence(F.col("seg"), F.col("seg") + 31))).select(
        "free", F.expr("shiftleft(half, seg) & ~shiftleft(1L, free)").alias("key")).distinct(), "simhash-hot")
    cold = keyed.join(hot_keys, ["free", "key"], "left_anti")
    hot = written(keyed.join(hot_keys, ["free", "key"], "left_semi"), "simhash-level")
    return _links_of(cold, k).union(_refined(hot, k, hot_rows))


def _rooted(found: DataFrame, k: int, hot_rows: int) -> DataFrame:
    """``found`` (doc_id, fp, ...) with the component's root fingerprint and its smallest doc_id."""
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = written(components(links(distinct.select("fp"), k, hot_rows)), "simhash-roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(rooted.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, k: int = K, shingle: int = SHINGLE, hot_rows: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a document reaches over links."""
    found = written(fingerprints(docs, shingle), "simhash-fp")
    return _rooted(found, k, hot_rows).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, k: int = K, shingle: int = SHINGLE, hot_rows: int = HOT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays.

    A null doc_id is larger than all others, so a row with one stays only if no other id is in its component. Different
    texts of one component under its smallest doc_id (or all null) are told apart by their sha256, of which the
    smallest stays; under one doc_id in different components each stays. Rows that repeat both doc_id and text count as
    one document: one of them stays.
    """
    id_, digest = F.col("doc_id").cast("long"), F.sha2(F.col("text").cast("string"), 256)
    found = written(fingerprints(docs, shingle, digest), "simhash-fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    kept = _rooted(found, k, hot_rows).groupBy("root").agg(F.min(order).alias("_least")).select(
        F.col("_least.doc_id").alias("__id"), F.col("_least.digest").alias("__kept"))
    rows = docs.withColumn("__digest", digest)
    same = id_.eqNullSafe(F.col("__id")) & F.col("__digest").eqNullSafe(F.col("__kept"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
