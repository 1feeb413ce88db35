"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Whole copies of a document are certain; what is left of the target is drawn by Pareto order
sampling with unequal chances: a document's inclusion odds are proportional to its size, documents are ranked by their random odds
``u / (1 - u)`` divided by their inclusion odds, and the lowest ranks are taken until the words taken come nearest to what is left.
The sample has thus a fixed size in words. (The factor by which all inclusion odds of a source reach that size does not change its order,
so ranks are kept without it.)

The rank is cut off without sorting a source in one task: words are first summed in bins of the rank (``BINS`` to every doubling),
the running sum over bins finds the bin in which the target is reached, and only that bin's rows are ranked.
Every document then compares its rank with the cut of its source by itself, so no text is moved.

``u`` comes from doc_id, text and, among rows equal in both and the source, a running number (:func:`numbered`); so every row is drawn by
itself, whatever its id. Nulls and ties: a null text has size 0, and a text without a word is never drawn (whole copies it gets like any
other); a null source is a source of its own, last in order; a null doc_id is hashed as ``null``. An empty table gives an empty
mix. Only ``doc_id``, ``source`` and ``text`` are read; all other columns pass through :func:`mixed_rows` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import WORD, n_words, table, written
from packetloom.runtime import broadcast_if_small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix-1"
BINS = 512
NEVER = 1e300
ROW = ["doc_id", "source", "_text"]


def uniform(doc_id: Column, text_hash: Column, copy: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the md5 of seed, id, text and running number: 52 bits, the same on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash, copy.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def odds(p: Column) -> Column:
    return p / (1.0 - p)


def rank_of(u: Column, size: Column) -> Column:
    """Random odds over inclusion odds."""
    return F.when(size > 0, odds(u) / size).otherwise(NEVER)


def _same(left: str, right: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def numbered(rows: DataFrame, keys: list[str], name: str = "_copy") -> DataFrame:
    """``rows`` with a running number from 0 among those equal in ``keys``.

    Only rows that have an equal are moved. They are numbered inside the partition they were read in and shifted by the numbers of the
    partitions before, so a key that a third of all rows share is never gathered.
    """
    placed = rows.withColumn("_part", F.spark_partition_id())
    several = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "mix-equal")
    if several.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    several = broadcast_if_small(several)
    equal = written(placed.alias("r").join(several.alias("s"), _same("r", "s", keys), "left_semi"), "mix-equal-rows")
    counts = equal.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = Window.partitionBy(*keys).orderBy("_part")  # a row per partition
    before = counts.withColumn("_before", F.sum("_n").over(parts) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*keys, "_part").orderBy(F.xxhash64(*rows.columns))
    counted = equal.withColumn("_at", F.row_number().over(inside) - 1).alias("e").join(before.alias("b"), _same("e", "b", [*keys, "_part"]))
    shifted = counted.select("e.*", (F.col("b._before") + F.col("e._at")).alias(name)).select(*rows.columns, name)
    alone = rows.alias("r").join(several.alias("s"), _same("r", "s", keys), "left_anti").withColumn(name, F.lit(0).cast("long"))
    return alone.unionByName(shifted)


def drawn_rows(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with ``_size`` and the rank ``_rank`` of every row's draw."""
    rows = numbered(docs.withColumn("_text", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))), ROW)
    size = n_words(F.col("text"))
    return rows.withColumn("_size", size).withColumn(
        "_rank", rank_of(uniform(F.col("doc_id"), F.col("_text"), F.col("_copy"), seed), F.col("_size"))).drop("_text", "_copy")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """(source, source_size) -> with target, ``whole`` copies and the fraction ``p``; one row per source.

    ``min(max_copies * size, level * weight)`` with the level at which the targets sum to ``share`` of all words.
    The sum as a function of the level is the lowest of the lines "the first j sources in order of
    ``size / weight`` are full", so the level is the largest of the lines' solutions.
    """
    ws = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_w", F.element_at(ws, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(max_copies))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = ranked.withColumn("_level", (total - before) / left).withColumn("_level", F.max("_level").over(everything))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        level.withColumn("target", target)
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("p", ratio - F.floor(ratio))
        .withColumn("left_words", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "p", "left_words")
    )


def plan_mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES, seed: str = SEED, bins: int = BINS):
    """(sizes, cuts): per document (doc_id, source, size, rank), per source its target and the rank of its last document."""
    only = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    sizes = written(drawn_rows(only, seed).select("doc_id", "source", F.col("_size").alias("size"), F.col("_rank").alias("rank")), "mix-sizes")
    binned = sizes.withColumn("_bin", F.floor(F.log2("rank") * bins).cast("int"))
    sums = written(binned.groupBy("source", "_bin").agg(F.sum("size").alias("_words"), F.max("rank").alias("_top")), "mix-bins")
    targets = source_targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_copies)
    same = F.col("b.source").eqNullSafe(F.col("t.source"))
    running = Window.partitionBy("source").orderBy("_bin")
    reached = (
        sums.withColumn("_upto", F.sum("_words").over(running)).withColumn("_below", F.lag("_top").over(running)).alias("b")
        .join(targets.alias("t"), same)
        .where(F.col("_upto") - F.col("_words") <= F.col("left_words"))
        .groupBy("t.source", "source_size", "target", "whole", "p", "left_words")
        .agg(F.max("_bin").alias("_bin"), F.max_by(F.col("_upto") - F.col("_words"), "_bin").alias("_before"), F.max_by("_below", "_bin").alias("_below"))
    )
    reached = written(reached, "mix-reached")
    order = Window.partitionBy("source").orderBy("rank", "doc_id")
    last = (
        binned.alias("d")
        .join(reached.where("p > 0").alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d._bin") == F.col("r._bin")))
        .select("d.source", "d.doc_id", "d.rank", "size", "left_words", "_before")
        .withColumn("_upto", F.col("_before") + F.sum("size").over(order))
        .where(F.col("_upto") - F.col("size") / 2 <= F.col("left_words"))
        .groupBy("source").agg(F.max("rank").alias("_last"))
    )
    # Bins before the one in which the target is reached are taken whole; so is any row up to the last one taken.
    cuts = (
        reached.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left")
        .select("r.source", "source_size", "target", "whole", F.coalesce("_last", F.when(F.col("p") > 0, F.col("_below")), F.lit(-1.0)).alias("cut"))
    )
    return sizes, written(cuts, "mix-cuts")


def copies(rank: Column, whole: Column, cut: Column) -> Column:
    return whole + F.when((rank <= cut) & (rank < NEVER), 1).otherwise(0)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    _, cuts = plan_mix(docs, **options)
    given = docs.columns
    # Under names of its own, so that no column of docs can clash with what is computed.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), "text")
    rows = drawn_rows(own, options.get("seed", SEED))
    joined = rows.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    n = copies(F.col("d._rank"), F.col("c.whole"), F.col("c.cut")).cast("int")
    taken = joined.select("d._row", n.alias("_n")).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return taken.select("_row.*")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, cuts = plan_mix(table(spark, sf_dir, "documents"))
    joined = sizes.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    return joined.select("d.doc_id", "d.size", "c.source_size", "c.target",
                         (F.col("d.size") * copies(F.col("d.rank"), F.col("c.whole"), F.col("c.cut"))).alias("taken"))


def mix_ctes(docs: str = "documents", word: str = WORD) -> str:
    """CTEs up to ``mix_plan`` (all columns of docs, u, size, rank, source_size, target, n_copies)."""
    return f"""
mix_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS copy FROM {docs}),
mix_u AS (SELECT *, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{word}')) END::BIGINT AS size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || copy), 1, 13))::BIGINT + 0.5)
      / 4503599627370496.0 AS u FROM mix_n),
mix_d AS (SELECT *, CASE WHEN size > 0 THEN u / (1.0::DOUBLE - u) / size ELSE 1e300 END AS rank FROM mix_u),
mix_s AS (SELECT source, sum(size)::BIGINT AS source_size FROM mix_d GROUP BY 1),
mix_w AS (SELECT *, source_size * {MAX_COPIES} AS cap,
    ([{", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w FROM mix_s),
mix_l AS (SELECT max(((SELECT sum(source_size) FROM mix_s) * {SHARE}::DOUBLE - before) / w_left) AS level FROM (
    SELECT coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM mix_w WINDOW o AS (ORDER BY cap / w, source NULLS LAST))),
mix_t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM mix_w, mix_l),
mix_r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p FROM mix_t),
mix_o AS (SELECT d.*, r.source_size, r.target, r.whole, r.p, r.target - r.whole * r.source_size AS left_words,
    sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
    FROM mix_d d JOIN mix_r r ON d.source IS NOT DISTINCT FROM r.source),
mix_plan AS (SELECT *, whole + CASE WHEN p > 0 AND size > 0 AND middle <= left_words THEN 1 ELSE 0 END AS n_copies FROM mix_o)"""


OP8_SQL = f"WITH {mix_ctes()} SELECT doc_id, size, source_size, target, (size * n_copies)::BIGINT AS taken FROM mix_plan"
