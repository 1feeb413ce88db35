"""Vector retrieval: exact cosine top-k for a table of query vectors, and an index of random-projection buckets.

Exact search is a join of blocks. Vectors and queries are packed into matrices of bounded size, every block of vectors meets every
block of queries, one product gives their scores and only ``k`` rows per query and block go on; a window takes the best of
those. Few queries are broadcast (their bytes are checked) and the vectors stay where they are; otherwise blocks are
dealt to lanes, and each lane gets all query blocks. The driver sees one number, the size of the queries.

The index cuts the space by random planes: a vector's bucket in a table is the row of sides it lies on. A query looks into its own
bucket and those across the planes it lies closest to, in every table; what it finds there is ranked by exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.sparse import TOP_K
from packetloom.runtime import broadcast_if_small

BLOCK_VALUES = 65_536  # numbers of one block, 512 KB
BROADCAST_BYTES = 32_000_000


def normalise(vectors: DataFrame, column: str) -> DataFrame:
    """Unit-length vectors; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # Bound as a lambda variable, the norm is computed once per row and not once per element.
    scaled = F.transform(F.array(F.when(norm == 0, F.lit(1.0)).otherwise(norm)),
                         lambda n: F.transform(F.col(column), lambda x: x.cast("double") / n))
    return vectors.withColumn(column, F.element_at(scaled, 1))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores; equal scores in order of id."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= bar)
    else:
        kept = np.arange(len(ids))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def _blocks(vectors: DataFrame, id_col: str, column: str, lanes: int, values: int = BLOCK_VALUES) -> DataFrame:
    """(lane, ids, m): the vectors as matrices of about ``values`` numbers, dealt to lanes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, values // max(1, flat.shape[1]))
            lane = lane or int(batch.column(0)[0].as_py() or 0)  # tasks begin with different lanes
            for at in range(0, batch.num_rows, step):
                ids = batch.column(0).slice(at, step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lane % lanes], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids),
                     pa.array([np.ascontiguousarray(flat[at:at + step], np.float64).tobytes()], pa.binary())], ["lane", "ids", "m"])
                lane += 1

    return vectors.select(F.col(id_col).cast("bigint"), column).mapInArrow(pack, "lane int, ids array<bigint>, m binary")


def _products(pairs: DataFrame, doc_id: str, query_id: str, k: int, digits: int) -> DataFrame:
    """Per query and pair of blocks the ``k`` best rows."""
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m, names, q in zip(*batch.columns):
                docs = ids.values.to_numpy(zero_copy_only=False)
                scores = np.round(np.frombuffer(m.as_buffer()).reshape(len(docs), -1) @ np.frombuffer(q.as_buffer()).reshape(len(names), -1).T, digits)
                best = [_best(docs, scores[:, i], k) for i in range(len(names))]
                sizes = [len(b) for b in best]
                at = np.concatenate(best)
                row = np.repeat(np.arange(len(names)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.values.to_numpy(zero_copy_only=False)[row]), pa.array(docs[at]), pa.array(scores[at, row])], [query_id, doc_id, "score"])

    return pairs.mapInArrow(top, f"{query_id} bigint, {doc_id} bigint, score double")


def _top(hits: DataFrame, doc_id: str, query_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(doc_id).asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(vectors: DataFrame, queries: DataFrame, doc_id: str, query_id: str, column: str, k: int = TOP_K,
             digits: int = 6, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Best ``k`` rows per query over unit vectors, without a score cut.

    Both ids are bigint. ``vectors`` and ``queries`` hold normalised double arrays of one length.
    """
    spark = vectors.sparkSession
    small = 8 * (queries.agg(F.sum(F.size(column))).first()[0] or 0) <= broadcast_bytes
    lanes = 1 if small else int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _blocks(queries, query_id, column, 1).select(F.col("ids").alias("names"), F.col("m").alias("q"))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    asked = F.broadcast(asked) if small else asked.hint("merge")
    pairs = _blocks(vectors, doc_id, column, lanes).join(asked, "lane").select("ids", "m", "names", "q")
    return _top(_products(pairs, doc_id, query_id, k, digits), doc_id, query_id, k)


# ---- buckets of random projections

TABLES = 16
BITS = 10
PROBES = 40
SEED = 11


def planes(dimensions: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables * bits, dimensions))


def _flips(bits: int, probes: int, margins: np.ndarray) -> list[int]:
    """Masks of the ``probes`` likeliest neighbours: flips of one or two bits in order of the margins crossed."""
    cost = margins * margins
    masks = [(0.0, 0), *((cost[i], 1 << i) for i in range(bits)),
             *((cost[i] + cost[j], 1 << i | 1 << j) for i, j in combinations(range(bits), 2))]
    return [m for _, m in sorted(masks)[:probes]]


def buckets(vectors: DataFrame, id_col: str, column: str, dimensions: int, probes: int = 1, tables: int = TABLES, bits: int = BITS,
            seed: int = SEED) -> DataFrame:
    """(id, table, code): the bucket of every vector in every table, and for ``probes`` > 1 its likeliest neighbours."""
    shared = vectors.sparkSession.sparkContext.broadcast(planes(dimensions, tables, bits, seed))  # tables x bits x dimensions numbers

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            margins = (flat @ shared.value.T).reshape(batch.num_rows, tables, bits)
            codes = (margins >= 0) @ powers
            if probes == 1:
                found = codes[:, :, None]
            else:
                found = np.array([[[c ^ m for m in _flips(bits, probes, margins[i, t])] for t, c in enumerate(row)] for i, row in enumerate(codes.tolist())])
            n, width = found.shape[0], found.shape[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), tables * width)),
                 pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), width), n)), pa.array(found.reshape(-1).astype(np.int64))], [id_col, "table", "code"])

    return vectors.select(F.col(id_col).cast("bigint"), column).mapInArrow(code, f"{id_col} bigint, table int, code bigint")


def without_copies(vectors: DataFrame, id_col: str, column: str, k: int) -> DataFrame:
    """Of rows with the same vector the ``k`` smallest ids; no others can be among the best ``k`` of any query."""
    w = Window.partitionBy(column).orderBy(id_col)
    return vectors.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= k).drop("_copy")


def retrieve_lsh(vectors: DataFrame, queries: DataFrame, doc_id: str, query_id: str, column: str, k: int = TOP_K, digits: int = 6,
                 tables: int = TABLES, bits: int = BITS, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """Like :func:`retrieve`, among the rows that share a probed bucket with the query; scores are exact.

    More tables and probes raise the recall, more bits make buckets smaller; :func:`recall` measures it.
    """
    first = queries.select(F.size(column)).first()
    dimensions = first[0] if first else 1
    rows = without_copies(vectors.select(F.col(doc_id).cast("bigint").alias(doc_id), column), doc_id, column, k)
    asked = queries.select(F.col(query_id).cast("bigint").alias(query_id), F.col(column).alias("_q"))
    held = buckets(rows, doc_id, column, dimensions, 1, tables, bits, seed)
    probed = buckets(queries, query_id, column, dimensions, probes, tables, bits, seed)
    pairs = held.join(broadcast_if_small(probed), ["table", "code"]).select(query_id, doc_id).distinct()
    joined = pairs.join(rows, doc_id).join(broadcast_if_small(asked), query_id)
    dot = F.aggregate(F.zip_with(column, "_q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return _top(joined.select(query_id, doc_id, F.round(dot, digits).alias("score")), doc_id, query_id, k)


def recall(found: DataFrame, exact: DataFrame, doc_id: str, query_id: str) -> DataFrame:
    """Per query the share of the exact rows that were found."""
    known = found.select(query_id, doc_id, F.lit(1).alias("_found"))
    return exact.select(query_id, doc_id).join(known, [query_id, doc_id], "left").groupBy(query_id).agg(
        (F.count("_found") / F.count(F.lit(1))).alias("recall"))
