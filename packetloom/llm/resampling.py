"""Target-distribution importance resampling over distinct lines.

Documents are drawn towards the distribution of a target corpus: hashed n-gram counts of all documents and of all target
texts give every bucket a log-ratio gain, a document's weight is the mean gain of its features, and Gumbel noise on the
weights with a top share of the scores is a draw without replacement.

No word touches a line break, so line breaks cut a text into lines whose features are independent of their neighbours.
Each distinct line of the corpus is read once (:func:`distinct_lines`): its buckets, times its occurrences, give the
corpus counts, and the sum of its gains goes to every place that has the line, through a join on a 128-bit line hash. The
n-grams that reach over a line break are read from the documents and added (:func:`crossing_features`; none for unigrams).
Words of a document travel once, in the shuffle that finds equal lines. Lines that hold many rows meet their sums in a
salted join. Ranks come from a range partitioning of the rows above the cut, each partition counting by itself.

Nulls and odd rows: a null or empty text has no features, weight 0, and is not drawn; a null doc_id takes the noise of
the text ``null`` and comes last among equal scores; repeated rows are scored alike and each take a rank of their own;
empty documents give an empty result and an empty target leaves gains that only follow the corpus. Only ``doc_id`` and
``text`` are read, so other columns do not matter. Very long texts are ordinary: nothing holds a text beside its own row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import table, written
from packetloom.runtime import salted_join

MAX_N = 1
BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
DRAW_PERCENT = 10
HOT_ROWS = 100_000
MEMO = 200_000
# On the bytes of a lower-cased line: digits, a-z and every byte of a character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

LINES = "h1 long, h2 long, occurrences long, n_words long, buckets binary"
SUMS = "h1 long, h2 long, occurrences long, n_words long, n_features long, gain long"


class _Bucket(dict):
    """Feature -> bucket, remembered; starts anew when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value


def _grams(words: list[bytes], n: int, starts) -> list[bytes]:
    return words if n == 1 else [b" ".join(words[i:i + n]) for i in starts]


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: x != "")


def _key(line: Column) -> list[Column]:
    """Two hashes with different seeds: 128 bits."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _line_features(batches: Iterator[pa.RecordBatch], max_n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = _Bucket(buckets)
    for batch in batches:
        counts, found = [], []
        for line in batch.column(3).to_pylist():
            words = _WORD.findall(line.lower())
            counts.append(len(words))
            grams = [g for n in range(1, max_n + 1) for g in _grams(words, n, range(len(words) - n + 1))]
            found.append(np.fromiter(map(bucket.__getitem__, grams), "<u4", len(grams)).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(found, pa.binary())],
                                         names=["h1", "h2", "occurrences", "n_words", "buckets"])


def distinct_lines(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """One row per distinct line: its hash, how often it occurs, its words and the buckets of its features."""
    lines = texts.select(F.explode(_lines(F.col("text"))).alias("line")).groupBy("line").agg(F.count("*").alias("occurrences"))
    return lines.select(*_key(F.col("line")), "occurrences", F.col("line").cast("binary").alias("line")).mapInArrow(
        lambda b: _line_features(b, max_n, buckets), LINES)


def _crossing(batches: Iterator[pa.RecordBatch], max_n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = _Bucket(buckets)
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            words, starts = [], []
            for line in (text or b"").lower().split(b"\n"):
                starts.append(len(words))
                words += _WORD.findall(line)
            grams = []
            for n in range(2, max_n + 1):
                at = {i for s in starts for i in range(max(0, s - n + 1), s) if i + n <= len(words)}
                grams += _grams(words, n, sorted(at))
            found.append(np.fromiter(map(bucket.__getitem__, grams), "<u4", len(grams)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["row", "buckets"])


def crossing_features(rows: DataFrame, max_n: int, buckets: int = BUCKETS) -> DataFrame:
    """(row, buckets) of the n-grams that reach over a line break; ``rows`` has row and text."""
    return rows.select("row", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        lambda b: _crossing(b, max_n, buckets), "row long, buckets binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all buckets of a batch one after another, how many each row has)"""
    values = [np.frombuffer(x.as_buffer(), "<u4") for x in column]
    return (np.concatenate(values) if values else np.empty(0, "<u4")), np.array([len(v) for v in values], np.int64)


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        values, sizes = _flat(batch.column(0))
        times = np.repeat(batch.column(1).to_numpy(), sizes).astype(np.float64)
        counts += np.bincount(values, times, minlength=buckets).astype(np.int64)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["bucket", "n"])


def bucket_counts(lines: DataFrame, crossing: DataFrame | None = None, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket: a line's features count as often as the line occurs. At most ``buckets`` numbers come back."""
    weighted = lines.select("buckets", "occurrences")
    if crossing is not None:
        weighted = weighted.unionByName(crossing.select("buckets", F.lit(1).cast("long").alias("occurrences")))
    counts = np.zeros(buckets, np.int64)
    for r in weighted.mapInArrow(lambda b: _counted(b, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one added to every count."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(corpus, target)], np.int64)


def _summed(batches: Iterator[pa.RecordBatch], table_, lead: int) -> Iterator[pa.RecordBatch]:
    gain = table_.value
    for batch in batches:
        values, sizes = _flat(batch.column(lead))
        upto = np.concatenate([[0], np.cumsum(gain[values])])
        stops = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([*batch.columns[:lead], pa.array(sizes), pa.array(upto[stops] - upto[stops - sizes])],
                                         names=[*batch.schema.names[:lead], "n_features", "gain"])


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 x Gumbel noise) from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs``: row, doc_id, n_words, n_features, weight."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if max_n > 1:
        rows = written(rows, "resampling-rows")  # row numbers must be the same for both uses
    lines = written(distinct_lines(docs, max_n, buckets), "resampling-lines")
    crossing = written(crossing_features(rows, max_n, buckets), "resampling-crossing") if max_n > 1 else None
    wanted = distinct_lines(target, max_n, buckets)
    across = crossing_features(target.select(F.lit(0).cast("long").alias("row"), "text"), max_n, buckets) if max_n > 1 else None
    shared = spark.sparkContext.broadcast(gains(bucket_counts(lines, crossing, buckets), bucket_counts(wanted, across, buckets)))

    sums = lines.mapInArrow(lambda b: _summed(b, shared, 4), SUMS)
    line = F.col("line")
    places = written(
        rows.select("row", "doc_id", F.explode_outer(_lines(F.col("text"))).alias("line"))
        .select("row", "doc_id", *[F.when(line.isNotNull(), k).alias(n) for k, n in zip(_key(line), ("h1", "h2"))]), "resampling-places")
    sums = written(sums, "resampling-sums")
    parts = ["row", "doc_id", "n_words", "n_features", "gain"]
    none = F.lit(0).cast("long")
    found = salted_join(places.where("h1 is not null"), sums, ["h1", "h2"], "occurrences", "row", HOT_ROWS).select(*parts)
    bare = places.where("h1 is null").select("row", "doc_id", *[none.alias(c) for c in parts[2:]])
    every = found.unionByName(bare)
    if max_n > 1:
        ids = rows.select("row", "doc_id")
        more = crossing.mapInArrow(lambda b: _summed(b, shared, 1), "row long, n_features long, gain long")
        every = every.unionByName(ids.join(more.where("n_features > 0"), "row").select("row", "doc_id", none.alias("n_words"), "n_features", "gain"))
    per_row = every.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in parts[2:]])
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    return per_row.select("row", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``rank`` 1, 2, ... of the ``drawn`` highest scores among rows with ``eligible``, null elsewhere.

    Scores are integers of a narrow range, so their histogram is small; it gives the score below which nothing is drawn.
    Rows from there on are dealt to sorted ranges, counted where they lie and shifted by the sizes of the ranges before.
    """
    left, cut = drawn, None
    for r in sorted(scored.where("eligible").groupBy("score").count().collect(), key=lambda r: -r["score"]):
        if left <= 0:
            break
        left, cut = left - r["count"], r["score"]
    nothing = scored.withColumn("rank", F.lit(None).cast("long"))
    if cut is None:
        return nothing
    above = F.col("eligible") & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    place = F.monotonically_increasing_id()
    dealt = written(scored.where(above).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "resampling-ranges")
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per partition
    rank = F.col("_before") + inside + 1
    counted = dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= drawn, rank))
    return counted.select(*scored.columns, "rank").unionByName(nothing.where(~above))


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED,
             min_words: int = MIN_WORDS, percent: int = DRAW_PERCENT) -> DataFrame:
    """Every row of ``docs`` with doc_id, n_words, n_features, weight, score and the rank of its draw (null: not drawn)."""
    scored = written(
        weighted(docs, target, max_n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        .withColumn("eligible", F.col("n_words") >= min_words), "resampling-scored")
    return ranked(scored, scored.where("eligible").count() * percent // 100).drop("row", "eligible")


def op11_line_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 by bytes: 3988292384 is the fixed polynomial of that checksum, written from the low bit.
OP11_SQL = f"""
WITH crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM (SELECT b,
    list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
d AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
tw AS (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
c AS MATERIALIZED (SELECT word, count(*) AS n FROM dw GROUP BY 1),
t AS MATERIALIZED (SELECT word, count(*) AS n FROM tw GROUP BY 1),
b AS MATERIALIZED (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i::INT, 2))::BIGINT)),
    lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
    FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM c UNION SELECT word FROM t)), crc),
cb AS (SELECT bucket, sum(n)::BIGINT AS n FROM c JOIN b USING (word) GROUP BY 1),
tb AS (SELECT bucket, sum(n)::BIGINT AS n FROM t JOIN b USING (word) GROUP BY 1),
g AS MATERIALIZED (SELECT word, floor(1000 * ln(((coalesce(tb.n, 0) + 1) * ((SELECT sum(n) FROM cb) + {BUCKETS}))::DOUBLE
    / ((cb.n + 1) * ((SELECT sum(n) FROM tb) + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM b JOIN cb USING (bucket) LEFT JOIN tb USING (bucket)),
s AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS gain FROM dw JOIN g USING (word) GROUP BY 1),
r AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN s ON d.doc_id = s.doc_id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM r WHERE n_features >= {MIN_WORDS})
SELECT r.doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= (SELECT count(*) FROM o) * {DRAW_PERCENT} // 100 THEN rank END AS rank
FROM r LEFT JOIN o ON r.doc_id = o.doc_id"""
