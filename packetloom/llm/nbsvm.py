"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-grams: runs of one to ``MAX_N`` word forms (letters by case, digits, punctuation as it is; a word that repeats
the one before it has a form of its own) and its single words, hashed to ``FEATURES`` indicators. Indicators are scaled by the log-count
ratio of the two classes (one added to every count) and by one over the square root of their number, and a linear hinge-loss model is
fitted by dual coordinate descent, classes weighted alike. Margins become chances by a logistic curve fitted on learning rows that the
model has not seen.

Learning rows are drawn from the labels whose id is not in the held-out fold: at most ``SAMPLE_ROWS`` ids of each class, those with the
smallest hashes. Only their features travel, to one task: no more than 2 x SAMPLE_ROWS x FEATURES numbers, whatever the size of the tables. All
documents are then scored where they lie, with a model of ``FEATURES`` numbers broadcast.

Nulls and odd rows: a null or empty text has no features and gets the score of the bias; a null doc_id is held out and never learned
from; labels that are null, not 0 or 1, or contradict each other for one id are not learned from; repeated documents are learned
once (the row with the smallest hash of its features) and scored each by itself; without labels every score is 0.5, with one class alone the share
of that class, one added to both counts; an empty table gives an empty result. Only the columns named here are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table, written

MAX_N = 3
FEATURES = 1 << 16
SAMPLE_ROWS = 3000
FOLDS = 5
CALIBRATION_FOLDS = 5
PENALTY = 1.0
EPOCHS = 30
THRESHOLD = 0.3
MEMO = 200_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = re.compile(r"([A-Z]+)|([0-9]+)|([a-z\x80-\U0010ffff]+)|(.)\4*", re.DOTALL)
_AGAIN = np.uint64(0x5DEECE66D)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # odd 64-bit multipliers


def form(word: str) -> str:
    """The word with its runs of letters and digits cut to one sign and runs of one mark to three."""
    return _RUNS.sub(lambda m: "A" if m[1] else "0" if m[2] else "a" if m[3] else m[0][:3], word)


class _Words(dict):
    """Word -> hash of its form (high half) and of itself (low half), remembered; starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = zlib.crc32(form(word).encode()) << 32 | zlib.crc32(word.encode())
        return value


def indicators(text: str | None, words: _Words, max_n: int = MAX_N, features: int = FEATURES) -> np.ndarray:
    """The distinct features of a text in ascending order."""
    found = _WORD.findall(text or "")
    if not found:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    forms = codes >> np.uint64(32)
    forms[1:][codes[1:] == codes[:-1]] = _AGAIN
    seen = np.zeros(features, bool)
    shift = np.uint64(64 - features.bit_length() + 1)
    seen[((codes & np.uint64(0xFFFFFFFF)) * _MIX[0] + _MIX[1]) * _MIX[2] >> shift] = True
    run = forms * _MIX[0]
    for n in range(1, max_n + 1):
        seen[run * _MIX[1] >> shift] = True
        run = (run[:-1] * _MIX[2] + np.uint64(n)) ^ (forms[n:] * _MIX[0])
        if not len(run):
            break
    return np.flatnonzero(seen)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, features: int, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights (the bias last) of the hinge-loss model: each step solves one row's dual variable exactly, within [0, cost]."""
    w, alpha = np.zeros(features + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            now = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (now - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = now
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from margins to chances; counts are smoothed so that neither end is certain."""
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    want = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - want) * margins).sum(), (p - want).sum()])
        h = p * (1 - p) + 1e-9
        hessian = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        step *= min(1.0, 5.0 / np.abs(step).max()) if np.abs(step).max() else 1.0
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-6), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, checks: np.ndarray, features: int = FEATURES) -> tuple[np.ndarray, float, float]:
    """(weights with the bias last, slope, shift) from indicator rows with labels 0 or 1; ``checks`` marks rows for calibration."""
    y = np.where(labels > 0, 1.0, -1.0)
    positive, negative = int((labels > 0).sum()), int((labels == 0).sum())
    if not positive or not negative:
        return np.zeros(features + 1), 1.0, math.log((positive + 1) / (negative + 1))
    learn = ~checks if len(set(y[~checks])) == 2 and len(set(y[checks])) == 2 else np.ones(len(y), bool)
    p, q = np.ones(features), np.ones(features)
    for r, l, use in zip(rows, labels, learn):
        if use:
            (p if l > 0 else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[r] / math.sqrt(max(1, len(r))) for r in rows]
    at = np.flatnonzero(learn)
    share = {1.0: (y[at] > 0).mean(), -1.0: (y[at] < 0).mean()}
    cost = np.array([PENALTY / (2 * share[y[i]]) for i in at])
    w = descend([rows[i] for i in at], [values[i] for i in at], y[at], cost, features)
    rest = np.flatnonzero(~learn) if not learn.all() else at
    slope, shift = calibrate(np.array([w[rows[i]] @ values[i] + w[-1] for i in rest]), y[rest])
    w[:-1] *= ratio
    return w, slope, shift


def _featured(batches: Iterator[pa.RecordBatch], max_n: int, features: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        cells = [indicators(t.as_py(), words, max_n, features).astype("<u4").tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cells, pa.binary())], names=["doc_id", "label", "features"])


def _fitted(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    ids, labels, rows = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        rows += [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column(2)]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    checks = np.array([zlib.crc32(f"check {ids[i]}".encode()) % CALIBRATION_FOLDS == 0 for i in order], bool)
    w, slope, shift = fit([rows[i] for i in order], np.array([labels[i] for i in order], np.int64), checks, features)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([slope]), pa.array([shift])], names=["w", "slope", "shift"])


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def learning_rows(labels: DataFrame, label_col: str, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> DataFrame:
    """(doc_id, label) of at most ``sample_rows`` ids of either class, those with the smallest hashes."""
    sure = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
    sure = sure.where((F.col("label") == F.col("_most")) & ~held_out(F.col("doc_id"), folds)).drop("_most")
    halves = [sure.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    return halves[0].unionByName(halves[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, max_n: int = MAX_N,
          features: int = FEATURES, folds: int = FOLDS) -> tuple[np.ndarray, float, float]:
    """The fitted model; the labels that are drawn are the only rows whose features move."""
    drawn = F.broadcast(learning_rows(labels, label_col, sample_rows, folds))  # 2 x sample_rows rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(drawn, "doc_id")
    rows = texts.select("doc_id", "label", "text").mapInArrow(lambda b: _featured(b, max_n, features), "doc_id long, label int, features binary")
    once = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("features", F.xxhash64("features")).alias("features"))
    model = written(once.repartition(1).mapInArrow(lambda b: _fitted(b, features), "w binary, slope double, shift double"), "nbsvm-model").collect()
    if not model:
        return np.zeros(features + 1), 1.0, 0.0
    return np.frombuffer(model[0]["w"], "<f8"), model[0]["slope"], model[0]["shift"]


def _scored(batches: Iterator[pa.RecordBatch], model, max_n: int, features: int) -> Iterator[pa.RecordBatch]:
    w, slope, shift = model.value
    words = _Words()
    for batch in batches:
        margins = np.empty(batch.num_rows)
        for i, text in enumerate(batch.column(1)):
            found = indicators(text.as_py(), words, max_n, features)
            margins[i] = w[found].sum() / math.sqrt(max(1, len(found))) + w[-1]
        scores = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], max_n: int = MAX_N, features: int = FEATURES) -> DataFrame:
    """(doc_id, score) of every row; the text is all that a score sees."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _scored(b, shared, max_n, features), "doc_id long, score double")


def op13_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
