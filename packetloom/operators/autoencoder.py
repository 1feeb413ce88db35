"""Reconstruction-error detector: a 13-64-32-64-13 network trained by model averaging.

Each round every learner (one partition of about ``LEARNER_ROWS`` rows, dealt by a random hash) runs one epoch of
mini-batch Adam from the shared weights and moments; both are averaged, weighted by rows, and the means
(three times 5,933 numbers) start the next round (McMahan et al. 2017). A learner hands on its numbers as one row; beyond
``MEET`` learners, tasks add up those of ``MEET`` each before the driver adds their sums. With one learner this is plain mini-batch
training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.anomalies import FEATURES
from packetloom.runtime import broadcast_if_small, materialize

HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 50, 64, 1e-3, 42
LEARNER_ROWS = 50_000
MEET = 64
LEARNED = "learner int, w binary, rows bigint"


def layer_sizes(inputs: int = len(FEATURES), hidden: int = HIDDEN) -> list[int]:
    return [inputs, hidden * 2, hidden, hidden * 2, inputs]


def _unpack(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return layers


def initial_weights(sizes: list[int], seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        bound = 1.0 / np.sqrt(a)
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def _activations(x: np.ndarray, layers) -> list[np.ndarray]:
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0.0) if i + 1 < len(layers) else z)
    return out


class _Network:
    """Weights and buffers of one learner; a step writes into them and allocates next to nothing."""

    def __init__(self, flat: np.ndarray, sizes: list[int]):
        self.flat, self.grad, self._spare, self._step = flat.copy(), np.empty(len(flat)), np.empty(len(flat)), np.empty(len(flat))
        self.sizes, self.layers, self.grads = sizes, _unpack(self.flat, sizes), _unpack(self.grad, sizes)
        self._rooms: dict[int, tuple] = {}

    def gradient(self, x: np.ndarray) -> np.ndarray:
        """Gradient of the mean squared reconstruction error over a mini-batch."""
        if len(x) not in self._rooms:
            self._rooms[len(x)] = ([np.empty((len(x), n)) for n in self.sizes[1:]], [np.empty((len(x), n)) for n in self.sizes[1:]])
        outs, deltas = self._rooms[len(x)]
        acts = [x, *outs]
        for i, (w, b) in enumerate(self.layers):
            np.matmul(acts[i], w, out=outs[i])
            outs[i] += b
            if i + 1 < len(self.layers):
                np.maximum(outs[i], 0.0, out=outs[i])
        delta = np.subtract(outs[-1], x, out=deltas[-1])
        delta *= 2.0
        delta /= x.size
        for i in range(len(self.layers) - 1, -1, -1):
            np.matmul(acts[i].T, delta, out=self.grads[i][0])
            np.add.reduce(delta, axis=0, out=self.grads[i][1])
            if i:
                delta = np.matmul(delta, self.layers[i][0].T, out=deltas[i - 1])
                delta *= acts[i] > 0
        return self.grad

    def adam(self, x: np.ndarray, rate: float, state: list) -> None:
        g, (mean, square, _), spare, step = self.gradient(x), state, self._spare, self._step
        state[2] += 1
        mean *= 0.9
        mean += np.multiply(g, 0.1, out=spare)
        square *= 0.999
        square += np.multiply(np.multiply(g, 0.001, out=spare), g, out=spare)
        np.sqrt(np.divide(square, 1 - 0.999 ** state[2], out=spare), out=spare)
        spare += 1e-8
        np.divide(np.divide(mean, 1 - 0.9 ** state[2], out=step), spare, out=step)
        self.flat -= np.multiply(step, rate, out=step)


def _gradient(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    return _Network(flat, sizes).gradient(x)


def _adam_epoch(x: np.ndarray, flat: np.ndarray, sizes, rng, batch: int, rate: float, state: list) -> np.ndarray:
    order, network = rng.permutation(len(x)), _Network(flat, sizes)
    state[:2] = [np.array(s) for s in state[:2]]
    for start in range(0, len(x), batch):
        network.adam(x[order[start:start + batch]], rate, state)
    return network.flat


def _total(frame: pd.DataFrame) -> tuple[np.ndarray, int]:
    """Row-weighted sum of the learners' numbers, in order of the learners, and the rows."""
    total = np.zeros(0)
    for w, rows in zip(frame.sort_values("learner")["w"], frame.sort_values("learner")["rows"]):
        part = np.frombuffer(w) * rows
        total = total + part if len(total) else part
    return total, int(frame["rows"].sum())


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total, rows = _total(frame)
    return pd.DataFrame({"learner": [frame["learner"].min()], "w": [(total / rows).tobytes()], "rows": [rows]})


def errors_of(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    return ((x - _activations(x, _unpack(flat, sizes))[-1]) ** 2).mean(axis=1)


@dataclass
class Autoencoder:
    weights: np.ndarray
    sizes: list[int]
    threshold: float
    max_error: float


def fit_autoencoder(features: DataFrame, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH,
                    rate: float = RATE, seed: int = SEED, partitions: int | None = None,
                    ids: list[str] | None = None) -> Autoencoder:
    """``partitions`` fixes the number of parallel learners; by default it follows from the rows."""
    spark = features.sparkSession
    sizes = layer_sizes(len(FEATURES), hidden)
    learners = partitions or max(1, -(-features.count() // LEARNER_ROWS))
    deal = F.xxhash64(*(ids or FEATURES), F.lit(seed))
    placed = features.repartition(learners, deal).sortWithinPartitions(deal)
    # Executors that are lost only cost a recomputation of their cached blocks.
    placed = placed.select(*FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    flat = initial_weights(sizes, seed)
    carried = np.concatenate([flat, np.zeros(2 * len(flat) + 1)])  # weights, both moments, steps so far
    try:
        for epoch in range(epochs):
            shared = spark.sparkContext.broadcast(carried)

            def learn(frames: Iterator[pd.DataFrame], epoch=epoch, shared=shared) -> Iterator[pd.DataFrame]:
                weights, *state = np.split(shared.value[:-1], 3)
                state, rows = [*state, round(shared.value[-1])], 0
                for frame in frames:  # Arrow batches bound the memory of a task
                    x = frame[FEATURES].to_numpy(dtype=np.float64)
                    if len(x):
                        weights = _adam_epoch(x, weights, sizes, np.random.default_rng([seed, epoch, rows]), batch, rate, state)
                        rows += len(x)
                if rows:
                    numbers = np.concatenate([weights, *state[:2], state[2:]])
                    yield pd.DataFrame({"learner": [TaskContext.get().partitionId()], "w": [numbers.tobytes()], "rows": [rows]})

            local = placed.mapInPandas(learn, LEARNED)
            if learners > MEET:
                local = local.groupBy(F.floor(F.col("learner") / MEET)).applyInPandas(_added, LEARNED)
            total, rows = _total(local.toPandas())
            if len(total) != len(carried):
                raise ValueError("no rows to train on")
            carried = total / rows
            flat = carried[:len(flat)]
            shared.unpersist()
        model = Autoencoder(flat, sizes, 0.0, 1.0)
        stats = _errors(placed, model).agg(
            (F.avg("_e") + 3 * F.stddev_pop("_e")).alias("t"), F.max("_e").alias("m")).first()
        model.threshold, model.max_error = float(stats["t"]), float(stats["m"]) or 1.0
    finally:
        placed.unpersist()
    return model


def _errors(features: DataFrame, model: Autoencoder) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast((model.weights, model.sizes))

    @F.pandas_udf("double")
    def error(columns: pd.DataFrame) -> pd.Series:
        weights, sizes = shared.value
        return pd.Series(errors_of(columns.to_numpy(dtype=np.float64), weights, sizes))

    # Marked nondeterministic so that no filter on the error is pushed below it and computed twice.
    return features.withColumn("_e", error.asNondeterministic()(F.struct(*FEATURES)))


def score_autoencoder(features: DataFrame, model: Autoencoder | None, scope: list[str] | None = None) -> DataFrame:
    """Adds reconstruction_error, score and is_anomaly.

    The error is divided by the largest one of its ``scope`` (one capture), found by a partial
    aggregate; without a scope the training maximum stored with the model is used, as a stream must.
    """
    if model is None:
        raise RuntimeError("score_autoencoder needs a fitted model")
    scored = _errors(features, model).withColumnRenamed("_e", "reconstruction_error")
    if scope:
        scored = materialize(scored, "errors")  # the network runs once; the peaks and the rows read its result
        top = F.max("reconstruction_error")
        peaks = scored.groupBy(*scope).agg(F.when(top == 0, F.lit(1.0)).otherwise(top).alias("_max"))
        # A few captures hold all rows: dealt by capture, they would keep as few tasks busy.
        scored = scored.join(broadcast_if_small(materialize(peaks, "peaks")), scope)
    else:
        scored = scored.withColumn("_max", F.lit(model.max_error))
    return (
        scored.withColumn("score", F.col("reconstruction_error") / F.col("_max"))
        .withColumn("is_anomaly", F.col("reconstruction_error") > model.threshold)
        .drop("_max")
    )


def save_autoencoder(spark: SparkSession, model: Autoencoder, path: str) -> None:
    row = (model.weights.tolist(), model.sizes, model.threshold, model.max_error)
    spark.createDataFrame([row], "weights array<double>, sizes array<int>, threshold double, max_error double").coalesce(
        1).write.mode("overwrite").parquet(path)


def load_autoencoder(spark: SparkSession, path: str) -> Autoencoder:
    r = spark.read.parquet(path).first()
    return Autoencoder(np.array(r["weights"]), list(r["sizes"]), r["threshold"], r["max_error"])
