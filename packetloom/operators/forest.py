"""Isolation forest: trees grown from small samples, scoring inside the tasks.

Liu, Ting and Zhou (2008): score(x) = 2 ** (-mean path length / c(sample size)). The decision value
is ``-score - offset`` with the offset at the contamination quantile of the training data.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions.values import clip01
from packetloom.operators.anomalies import FEATURES

TREES, SAMPLE, CONTAMINATION, SEED = 200, 256, 0.05, 42
QUANTILE_ACCURACY = 1_000_000
NODE_DDL = "tree int, node int, feature int, split double, left int, right int, size int"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    far = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, far))


@dataclass
class Forest:
    """At most ``trees * (2 * sample - 1)`` nodes, whatever the size of the training table."""

    nodes: pd.DataFrame
    sample: int
    offset: float

    def arrays(self) -> list[tuple]:
        """Per tree (feature, split, left, path, levels), renumbered level by level: the right child follows the left one and a
        leaf is its own left child behind a split that nothing exceeds, so a step needs no test for leaves."""
        out = []
        for _, t in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            feature, split, left, right = (t[c].to_numpy() for c in ("feature", "split", "left", "right"))
            order, depth, child = [0], [0], []
            for at, node in enumerate(order):  # grows while it is read
                child.append(at if feature[node] < 0 else len(order))
                if feature[node] >= 0:
                    order += [left[node], right[node]]
                    depth += [depth[at] + 1] * 2
            leaf = feature[order] < 0
            out.append((np.where(leaf, 0, feature[order]).astype(np.intp), np.where(leaf, np.inf, split[order]), np.array(child, np.intp),
                        np.array(depth) + average_path(t["size"].to_numpy())[order], max(depth)))
        return out


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, split, left, right, size) of one tree; leaves have feature -1."""
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        if parent >= 0:
            nodes[parent][2 + side] = at
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        split = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] <= split
        nodes[at][0], nodes[at][1] = f, split
        todo.append((rows[goes_left], depth + 1, at, 0))
        todo.append((rows[~goes_left], depth + 1, at, 1))
    return nodes


def _tree_samples(features: DataFrame, ids: list[str], trees: int, sample: int, n: int, seed: int) -> DataFrame:
    """Up to ``sample`` rows per tree, picked by hash.

    A first hash keeps a pool of about ``4 * trees * sample`` rows; only those are tested per tree,
    so the full table is hashed once and never multiplied by the number of trees.
    """
    scale = float(1 << 31)
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 31)) / scale
    want = min(1.0, 4.0 * sample / n)
    pool = min(1.0, want * trees)
    chance = want / pool
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit(*ids, t, F.lit(seed)) < chance)
    spread = features.where(unit(*ids, F.lit(-seed)) < pool).withColumn("tree", F.explode(picks))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(*ids, "tree", F.lit(seed + 1)), *ids)
    return spread.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample)


def fit_forest(features: DataFrame, ids: list[str], trees: int = TREES, contamination: float = CONTAMINATION,
               seed: int = SEED, sample: int = SAMPLE) -> Forest:
    n = features.count()
    if n == 0:
        raise ValueError("no rows to train on")
    size = min(sample, n)
    limit = max(1, ceil(log2(max(2, size))))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        x = frame.sort_values("_r")[FEATURES].to_numpy(dtype=np.float64)
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "size"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    nodes = _tree_samples(features, ids, trees, size, n, seed).groupBy("tree").applyInPandas(build, NODE_DDL).toPandas()
    forest = Forest(nodes, size, 0.0)
    scored = _scores(features, forest)
    # One method at every size: the score at the rank, to one part in QUANTILE_ACCURACY of the rows.
    bar = F.percentile_approx(-F.col("_s"), F.lit(contamination), F.lit(QUANTILE_ACCURACY))
    forest.offset = float(scored.agg(bar.alias("o")).first()["o"])
    return forest


def _paths(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Summed path length of every row; all rows go down a tree side by side, in buffers that are used again."""
    rows, width = x.shape
    x = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x))  # no number goes right, as it always did
    flat, first = x.ravel(), np.arange(rows) * width
    total, value, bound = np.zeros(rows), np.empty(rows), np.empty(rows)
    at, place, right = np.empty(rows, np.intp), np.empty(rows, np.intp), np.empty(rows, bool)
    for feature, split, left, path, levels in trees:
        at[:] = 0
        for _ in range(levels):
            # Without "clip" a take into a buffer is copied once more; no index is out of range.
            np.take(feature, at, out=place, mode="clip")
            np.take(flat, np.add(place, first, out=place), out=value, mode="clip")
            np.take(split, at, out=bound, mode="clip")
            np.greater(value, bound, out=right)
            np.take(left, at, out=place, mode="clip")
            np.add(place, right, out=at)
        total += np.take(path, at, out=value, mode="clip")
    return total


def _scores(features: DataFrame, forest: Forest) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast((forest.arrays(), float(average_path(forest.sample))))

    @F.pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        trees, scale = shared.value
        total = _paths(columns.to_numpy(dtype=np.float64), trees)
        return pd.Series(np.exp2(-total / max(1, len(trees)) / scale) if scale > 0 else np.full(len(total), 0.5))

    # Marked nondeterministic so that no filter on the score is pushed below it and scored twice.
    return features.withColumn("_s", score.asNondeterministic()(F.struct(*FEATURES)))


def score_forest(features: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds raw_score, score in [0, 1] (1 is most anomalous) and is_anomaly."""
    if forest is None:
        raise RuntimeError("score_forest needs a fitted forest")
    return (
        _scores(features, forest)
        .withColumn("raw_score", -F.col("_s") - F.lit(forest.offset))
        .withColumn("score", clip01(F.lit(0.5) - F.col("raw_score")))
        .withColumn("is_anomaly", F.col("raw_score") < 0)
        .drop("_s")
    )


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    spark.createDataFrame(forest.nodes, NODE_DDL).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(forest.sample, forest.offset)], "sample int, offset double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/params")


def load_forest(spark: SparkSession, path: str) -> Forest:
    p = spark.read.parquet(f"{path}/params").first()
    return Forest(spark.read.parquet(f"{path}/nodes").toPandas(), p["sample"], p["offset"])
