"""Training and scoring jobs that combine scaler and detectors."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.anomalies import (FEATURES, RuleThresholds, apply_scaler, enough_to_train, ensemble,
                                            feature_vector, fit_scaler)
from packetloom.operators.autoencoder import (Autoencoder, fit_autoencoder, load_autoencoder, save_autoencoder,
                                              score_autoencoder)
from packetloom.operators.forest import Forest, fit_forest, load_forest, save_forest, score_forest


class Detector(Protocol):
    """Learns from a scaled feature table and adds ``score`` and ``is_anomaly`` to one."""

    name: str

    def fit(self, features: DataFrame, ids: list[str]) -> Detector:
        """A detector of the same kind that has learned from ``features``."""

    def score_flows(self, features: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ForestDetector:
    model: Forest | None = None
    name: str = "isolation_forest"

    def fit(self, features: DataFrame, ids: list[str]) -> ForestDetector:
        return replace(self, model=fit_forest(features, ids))

    def score_flows(self, features: DataFrame) -> DataFrame:
        return score_forest(features, self.model)


@dataclass(frozen=True)
class AutoencoderDetector:
    model: Autoencoder | None = None
    scope: tuple[str, ...] = ("capture_id",)
    name: str = "autoencoder"

    def fit(self, features: DataFrame, ids: list[str]) -> AutoencoderDetector:
        return replace(self, model=fit_autoencoder(features, ids=ids))

    def score_flows(self, features: DataFrame) -> DataFrame:
        return score_autoencoder(features, self.model, list(self.scope))


@dataclass(frozen=True)
class DeviationDetector:
    """The largest deviation of any feature, as a share of the largest one seen in training; flagged from ``bound`` deviations on."""

    bound: float = 3.0
    largest: float | None = None
    name: str = "deviation"

    @staticmethod
    def _deviation() -> Column:
        return F.greatest(*[F.abs(F.col(f)) for f in FEATURES])

    def fit(self, features: DataFrame, ids: list[str]) -> DeviationDetector:
        return replace(self, largest=features.agg(F.max(self._deviation())).first()[0] or 1.0)

    def score_flows(self, features: DataFrame) -> DataFrame:
        if self.largest is None:
            raise RuntimeError("the detector has learned from no rows")
        deviation = self._deviation()
        return features.withColumn("score", F.least(F.lit(1.0), deviation / self.largest)).withColumn("is_anomaly", deviation >= self.bound)


@dataclass
class Models:
    """Scaler parameters travel with the models, so later runs scale in the same way."""

    scaler: DataFrame | None
    forest: Forest | None
    autoencoder: Autoencoder | None

    def detectors(self, scope: tuple[str, ...] = ("capture_id",)) -> list[Detector]:
        found: list[Detector] = []
        if self.forest is not None:
            found.append(ForestDetector(self.forest))
        if self.autoencoder is not None:
            found.append(AutoencoderDetector(self.autoencoder, scope))
        return found


def train(flows: DataFrame, keys: tuple[str, ...] = ("capture_id", "flow_id"), trees: int = 200, epochs: int = 50,
          partitions: int | None = None) -> Models | None:
    """Both detectors on all flows; fewer than ten flows train nothing."""
    if not enough_to_train(flows):
        return None
    features = feature_vector(flows, *keys)
    scaler = fit_scaler(features)
    scaler = flows.sparkSession.createDataFrame([scaler.first()], scaler.schema)
    scaled = apply_scaler(features, scaler).persist()
    try:
        forest = fit_forest(scaled, list(keys), trees=trees)
        network = fit_autoencoder(scaled, epochs=epochs, partitions=partitions, ids=list(keys))
    finally:
        scaled.unpersist()
    return Models(scaler, forest, network)


def analyse(flows: DataFrame, models: Models | None, keys: tuple[str, ...] = ("capture_id", "flow_id"),
            scope: tuple[str, ...] = ("capture_id",), thresholds: RuleThresholds = RuleThresholds(),
            more: tuple[Detector, ...] = ()) -> DataFrame:
    """Flow rows with if_score, ae_score, ensemble_score, is_anomaly, anomaly_type and severity.

    All detectors score the same feature projection, one after the other; no join by flow is needed. ``more`` adds
    detectors to the two models; each brings a column ``<name>_score`` and takes part in the ensemble. Without any
    every score is 0 and nothing is anomalous.
    """
    scored = flows.withColumns({f"_raw_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES})
    rest = [c for c in flows.columns]
    scored = scored.select(F.struct(*rest).alias("_flow"), *scope, *[F.col(f"_raw_{f}").alias(f) for f in FEATURES])
    if models is not None:
        scored = apply_scaler(scored, models.scaler)
    found = [*(models.detectors(scope) if models else []), *more]
    known = {"isolation_forest": "if", "autoencoder": "ae"}
    prefixes = [*known.values(), *[d.name for d in more]]
    for prefix in prefixes:
        scored = scored.withColumns({f"{prefix}_score": F.lit(None).cast("double"), f"{prefix}_flag": F.lit(None).cast("boolean")})
    for detector in found:
        prefix = known.get(detector.name, detector.name)
        scored = detector.score_flows(scored).withColumns(
            {f"{prefix}_score": F.col("score"), f"{prefix}_flag": F.col("is_anomaly")}).drop(
            "score", "is_anomaly", "raw_score", "reconstruction_error")
    flags = [f"{p}_flag" for p in prefixes]
    scores = [f"{p}_score" for p in prefixes]
    return ensemble(scored.select("_flow.*", *scores, *flags), scores, flags, thresholds).drop(*flags)


def save_models(spark: SparkSession, models: Models, path: str) -> None:
    save_forest(spark, models.forest, f"{path}/forest")
    save_autoencoder(spark, models.autoencoder, f"{path}/autoencoder")
    models.scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")


def load_models(spark: SparkSession, path: str) -> Models:
    return Models(spark.read.parquet(f"{path}/scaler"), load_forest(spark, f"{path}/forest"),
                  load_autoencoder(spark, f"{path}/autoencoder"))
