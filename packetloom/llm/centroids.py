"""Centroid clustering: Lloyd's rounds over column blocks.

Vectors are stored once as chunks of up to ``CHUNK_ROWS`` rows whose components are cut into ``BLOCKS`` column blocks, one
Parquet column each. In a round every block's tasks read only their column and the slice of the centroids that belongs to it
and give exact partial squared distances; these meet by chunk, are added over the blocks, and the smallest sum is the
assignment. Every block then adds up its own columns by cluster and sets its slice of the next centroids. What reaches the driver
and the tasks is k x dimensions numbers a round, whatever the number of vectors. Rounds hang together only by those numbers
and by written tables, so a lost executor repeats a part of one round.

All arithmetic is on integers: components are floor(scale * x), products run in doubles only where every partial sum
stays below 2^53.

Nulls and odd rows: vectors that are null, have another length, or hold a null or non-finite component are left out;
components beyond +-2^27 after scaling are set to that bound, since squared distances have to fit 64 bits; a null vec_id is
hashed as ``null`` and kept; repeated rows are clustered each by itself, and equal ids start in the order of their
components; with fewer vectors than centroids all of them start one; an empty table gives an empty result. Only the two named
columns are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table, written

DIMENSIONS = 64
SCALE = 256
K = 40
ROUNDS = 5
SEED = "2"
BLOCKS = 4
CHUNK_ROWS = 2048
BOUND = 1 << 27
EXACT = 1 << 53

FINAL = "cluster int, centroid array<long>, total decimal(38,0), whole decimal(38,0)"


def _bounds(dimensions: int, blocks: int) -> list[tuple[int, int]]:
    at = [dimensions * i // blocks for i in range(blocks + 1)]
    return list(zip(at, at[1:]))


def _sliced(batches: Iterator[pa.RecordBatch], dimensions: int, scale: float, blocks: int, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 32
    for batch in batches:
        right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimensions), False)
        batch = batch.filter(right)
        x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)
        finite = np.isfinite(x).all(axis=1)
        ids = batch.column(0).filter(pa.array(finite))
        x = np.clip(np.floor(scale * x[finite]), -BOUND, BOUND).astype("<i4")
        for a in range(0, len(x), chunk_rows):
            rows = x[a:a + chunk_rows]
            own = ids.slice(a, chunk_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own), pa.array([int(np.abs(rows).max())], pa.int64()),
                 *[pa.array([np.ascontiguousarray(rows[:, i:j]).tobytes()], pa.binary()) for i, j in _bounds(dimensions, blocks)]],
                names=["chunk", "ids", "largest", *[f"s{b}" for b in range(blocks)]])
            chunk += 1


def sliced(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS, scale: float = SCALE, blocks: int = BLOCKS,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The stored chunks: chunk, ids, largest (magnitude) and the column blocks s0, s1, ... as int32 matrices."""
    schema = "chunk long, ids array<long>, largest long, " + ", ".join(f"s{b} binary" for b in range(blocks))
    two = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return written(two.mapInArrow(lambda b: _sliced(b, dimensions, scale, blocks, chunk_rows), schema), "cluster-slices")


def _matrix(cell: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<i4").reshape(-1, width)


def _smallest(batches: Iterator[pa.RecordBatch], k: int, seed: str, widths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            x = np.hstack([_matrix(batch.column(1 + b)[row], w) for b, w in enumerate(widths)])
            digests = [hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest() for i in batch.column(0)[row].as_py()]
            best = sorted(range(len(digests)), key=lambda i: (digests[i], x[i].tolist()))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in best]), pa.array([x[i].tolist() for i in best], pa.list_(pa.int64()))],
                                             names=["digest", "x"])


def first_centroids(chunks: DataFrame, k: int, seed: str, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and id; every task keeps k rows at most a chunk."""
    widths = [j - i for i, j in bounds]
    rows = chunks.select("ids", *[f"s{b}" for b in range(len(bounds))]).mapInArrow(
        lambda b: _smallest(b, k, seed, widths), "digest string, x array<long>").orderBy("digest", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, bounds[-1][1])


def _partial(batches: Iterator[pa.RecordBatch], slice_, largest: int) -> Iterator[pa.RecordBatch]:
    c = slice_.value
    width = c.shape[1]
    exact = np.float64 if 4 * width * largest * largest < EXACT else np.int64
    out = "<i4" if 4 * width * largest * largest < 1 << 31 else "<i8"
    right = c.astype(exact)
    square = (right * right).sum(axis=1)
    for batch in batches:
        cells = []
        for cell in batch.column(1):
            x = _matrix(cell, width).astype(exact)
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ right.T) + square
            cells.append(np.ascontiguousarray(d.astype(out)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["chunk", "partial"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int, largest: int, widths: list[int]) -> Iterator[pa.RecordBatch]:
    kinds = {w: "<i4" if 4 * w * largest * largest < 1 << 31 else "<i8" for w in set(widths)}
    for batch in batches:
        clusters, distances = [], []
        for cells in batch.column(1):
            total = sum(np.frombuffer(cell["partial"].as_buffer(), kinds[widths[cell["block"].as_py()]]).reshape(-1, k).astype(np.int64) for cell in cells.values)
            best = total.argmin(axis=1)
            clusters.append(best.astype("<i4").tobytes())
            distances.append(total[np.arange(len(best)), best].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clusters, pa.binary()), pa.array(distances, pa.binary())],
                                         names=["chunk", "clusters", "distances"])


def assigned(chunks: DataFrame, centroids: np.ndarray, bounds: list[tuple[int, int]], largest: int) -> DataFrame:
    """Per chunk the nearest centroid of every vector (ties: the smaller number) and the squared distance; written."""
    context = chunks.sparkSession.sparkContext
    partial = None
    for b, (i, j) in enumerate(bounds):
        shared = context.broadcast(np.ascontiguousarray(centroids[:, i:j]))
        own = chunks.select("chunk", f"s{b}").mapInArrow(lambda x, s=shared: _partial(x, s, largest), "chunk long, partial binary")
        own = own.select("chunk", F.struct(F.lit(b).alias("block"), "partial").alias("p"))
        partial = own if partial is None else partial.unionByName(own)
    widths, k = [j - i for i, j in bounds], len(centroids)
    return written(partial.groupBy("chunk").agg(F.collect_list("p").alias("p")).mapInArrow(
        lambda x: _nearest(x, k, largest, widths), "chunk long, clusters binary, distances binary"), "cluster-assigned")


def _sums(batches: Iterator[pa.RecordBatch], first: int, width: int, k: int) -> Iterator[pa.RecordBatch]:
    total, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        for cell, own in zip(batch.column(1), batch.column(2)):
            labels = np.frombuffer(own.as_buffer(), "<i4")
            order = np.argsort(labels, kind="stable")
            found, at = np.unique(labels[order], return_index=True)
            total[found] += np.add.reduceat(_matrix(cell, width)[order].astype(np.int64), at, axis=0)
            counts += np.bincount(labels, minlength=k)
    cluster, dim = np.repeat(np.arange(k), width), np.tile(np.arange(first, first + width), k)
    yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(total.ravel()), pa.array(np.repeat(counts, width))],
                                     names=["cluster", "dimension", "total", "n"])


def moved(chunks: DataFrame, labels: DataFrame, centroids: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The next centroids: every block sets its own columns to floor(sum / count); empty clusters stay where they are."""
    k, sums = len(centroids), None
    for b, (i, j) in enumerate(bounds):
        own = chunks.select("chunk", f"s{b}").join(labels.select("chunk", "clusters"), "chunk").select("chunk", f"s{b}", "clusters").mapInArrow(
            lambda x, i=i, j=j: _sums(x, i, j - i, k), "cluster int, dimension int, total long, n long")
        sums = own if sums is None else sums.unionByName(own)
    after = centroids.copy()
    added = sums.groupBy("cluster", "dimension").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    for r in added.select("cluster", "dimension", F.expr("(total - pmod(total, n)) div n").alias("mean")).collect():  # k x dimensions rows
        after[r["cluster"], r["dimension"]] = r["mean"]
    return after


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, clusters, distances in zip(*batch.columns):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(clusters.as_buffer(), "<i4")), pa.array(np.frombuffer(distances.as_buffer(), "<i8"))],
                                             names=["id", "cluster", "distance"])


def _inertia(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    totals = [0] * k
    for batch in batches:
        for clusters, distances in zip(*batch.columns):
            c, d = np.frombuffer(clusters.as_buffer(), "<i4"), np.frombuffer(distances.as_buffer(), "<i8")
            for i in np.unique(c):
                totals[i] += int(d[c == i].sum(dtype=object))
    yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([str(t) for t in totals])], names=["cluster", "total"])


def cluster(vectors: DataFrame, id_col: str, vector_col: str, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
            scale: float = SCALE, blocks: int = BLOCKS, seed: str = SEED, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance per kept vector; cluster, centroid, its total distance and that of all clusters)."""
    spark = vectors.sparkSession
    blocks = min(blocks, dimensions)
    bounds = _bounds(dimensions, blocks)
    chunks = sliced(vectors, id_col, vector_col, dimensions, scale, blocks, chunk_rows)
    largest = chunks.agg(F.max("largest").alias("m")).first()["m"] or 0
    centroids = first_centroids(chunks, k, seed, bounds)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "id long, cluster int, distance long"), spark.createDataFrame([], FINAL)
    for _ in range(rounds):
        centroids = moved(chunks, assigned(chunks, centroids, bounds, largest), centroids, bounds)
    labels = assigned(chunks, centroids, bounds, largest)
    totals = labels.select("clusters", "distances").mapInArrow(lambda b: _inertia(b, k), "cluster int, total string").groupBy("cluster").agg(
        F.sum(F.col("total").cast("decimal(30,0)")).cast("decimal(38,0)").alias("total")).collect()  # k rows
    whole = sum(r["total"] for r in totals)
    final = spark.createDataFrame([(r["cluster"], centroids[r["cluster"]].tolist(), r["total"], whole) for r in totals], FINAL)
    return chunks.select("chunk", "ids").join(labels, "chunk").select("ids", "clusters", "distances").mapInArrow(_rows, "id long, cluster int, distance long"), final


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, final = cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    as_long = lambda c: F.least(F.col(c), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    per_cluster = final.select(  # k rows at most
        "cluster", as_long("total").alias("cluster_inertia"), as_long("whole").alias("inertia"),
        F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(per_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql() -> str:
    """Lloyd's rounds written out as one long form: a row per vector and component."""
    ctes = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
x AS MATERIALIZED (SELECT vec_id, i, e[i::INT] AS x FROM v, range(1, {DIMENSIONS + 1}) r(i)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN x USING (vec_id) WHERE c < {K})"""]
    for r in range(ROUNDS + 1):
        ctes.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, min(c) AS c, any_value(d) AS d FROM (SELECT vec_id, c, d, min(d) OVER (PARTITION BY vec_id) AS best FROM (
    SELECT vec_id, c, sum((x.x - c{r}.x) * (x.x - c{r}.x))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY 1, 2)) WHERE d = best GROUP BY 1)""")
        if r < ROUNDS:
            ctes.append(f"""
c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (
    SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM a{r} JOIN x USING (vec_id) GROUP BY 1, 2) n ON o.c = n.c AND o.i = n.i)""")
    return f"""WITH {','.join(ctes)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY 1)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha AS centroid_sha256 FROM a{ROUNDS} JOIN h USING (c)"""


OP12_SQL = _op12_sql()
