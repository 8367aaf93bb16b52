"""Severity and escalation models, and user models applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hazardflow import dims
from hazardflow.functions.decisions import (
    argmax_label,
    channels,
    escalation_confidence,
    escalation_likely,
    untrained_prediction,
)
from hazardflow.operators import boosting, sequence_training, workers
from hazardflow.operators.boosting import Trees
from hazardflow.operators.sequence_training import SequenceModel

# Training settings of the severity model.
TREES = 200
STEP_SIZE = 0.05
DEPTH = 5
SUBSAMPLE = 0.8
SEED = 42

HORIZONS = (1, 3, 6)
# Steps and features of a sensor sequence.
SEQUENCE_VALUES = 24 * 15
CLASSES = sorted(dims.SEVERITIES)  # probability order


def label_index(severity: Column) -> Column:
    """Class position in probability order, so that every run numbers the classes alike."""
    return (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), severity) - 1).cast("double")


def train_severity(
    rows: DataFrame,
    features: list[str] = dims.MODEL_FEATURES,
    label: str = "severity",
    trees: int = TREES,
    step_size: float = STEP_SIZE,
    depth: int = DEPTH,
    subsample: float = SUBSAMPLE,
    seed: int = SEED,
    row_id: str | None = None,
    n_workers: int | None = None,
) -> Trees:
    """Multiclass gradient boosting: ``trees`` rounds, one tree of ``depth`` for each class and round.

    Rows with an unknown label are left out. Trees compare values only, so features need no scaling. ``row_id`` names
    what decides the rounds a row takes part in; without it, rows of equal values take part together.
    """
    labeled = rows.withColumn("_label", label_index(F.col(label))).where(F.col("_label") >= 0)
    drawn = F.xxhash64(row_id) if row_id else F.xxhash64(*features, "_label")
    return boosting.train(labeled, features, "_label", drawn, CLASSES, trees, step_size, depth, subsample, seed, n_workers)


def score_severity(rows: DataFrame, model: Trees | None, features: list[str] = dims.MODEL_FEATURES) -> DataFrame:
    """Add ``severity``, ``confidence``, ``probabilities``, ``feature_importance`` and ``channels``.

    Missing features read 0. The importance map is that of the whole model. Without a model every row is MODERATE with
    confidence 0 and an empty map.
    """
    if model is None:
        fallback = untrained_prediction()
        plain = rows.withColumns({"severity": fallback["severity"], "confidence": fallback["confidence"]})
        empty = F.create_map().cast("map<string,double>")
        return plain.withColumns({"feature_importance": empty, "channels": channels(F.col("severity"))})
    present = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0) for n in features]
    scored = rows.withColumn("probabilities", model.probabilities(F.array(*[F.nanvl(c, F.lit(0.0)) for c in present])))
    weights = F.create_map(*[F.lit(v) for pair in zip(model.features, model.importance) for v in pair])
    scored = scored.withColumns({"severity": argmax_label(F.col("probabilities"), CLASSES), "feature_importance": weights})
    return scored.withColumns({"confidence": F.array_max("probabilities"), "channels": channels(F.col("severity"))})


def score_distinct(
    rows: DataFrame,
    model: Trees | None,
    features: list[str] = dims.MODEL_FEATURES,
) -> DataFrame:
    """Score each distinct feature vector once and share the result.

    Worth the extra shuffle for costly models on repetitive input; ``score_severity`` alone is better otherwise.
    """
    filled = rows.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) + F.lit(0.0) for n in features})
    scored = score_severity(filled.select(*features).distinct(), model, features)
    return filled.join(scored, features, "left")


def feature_importances(spark: SparkSession, model: Trees, top: int | None = None) -> DataFrame:
    """Mean share of the gain per feature over all trees, largest first."""
    table = spark.createDataFrame(list(zip(model.features, model.importance)), "feature string, importance double")
    ordered = table.orderBy(F.col("importance").desc(), "feature")
    return ordered if top is None else ordered.limit(top)


def save_model(model: Trees | SequenceModel, path: str) -> None:
    workers.save(SparkSession.active(), model.dump(), path)


def load_model(path: str) -> Trees | None:
    """The saved severity model, or None when the folder is not there (callers then use the untrained answers).

    A folder that is there but cannot be read as a model is an error.
    """
    text = workers.load(SparkSession.active(), path)
    return None if text is None else Trees.read(text)


def load_escalation(path: str) -> SequenceModel | None:
    """The saved escalation model, or None when the folder is not there."""
    text = workers.load(SparkSession.active(), path)
    return None if text is None else SequenceModel.read(text)


def train_escalation(
    sequences: DataFrame,
    validation: DataFrame,
    horizons: tuple[int, ...] = HORIZONS,
    epochs: int = sequence_training.EPOCHS,
    seed: int = sequence_training.SEED,
    n_workers: int | None = None,
) -> SequenceModel:
    """One logistic unit per horizon on the flattened sequence; the epoch with the least validation loss is kept.

    ``sequences`` and ``validation`` carry ``sequence`` and ``y{h}h``.
    """
    return sequence_training.train(sequences, validation, horizons, SEQUENCE_VALUES, epochs, seed, n_workers)


def score_escalation(
    sequences: DataFrame,
    model: SequenceModel | None,
    threshold: float = dims.ESCALATION_THRESHOLD,
    horizons: tuple[int, ...] = HORIZONS,
) -> DataFrame:
    """Add ``p{h}h`` per horizon, ``escalation_likely`` and ``escalation_confidence``.

    Without a model the probabilities are null and escalation is not likely.
    """
    if model is None:
        scored = sequences.withColumns({f"p{h}h": F.lit(None).cast("double") for h in horizons})
    else:
        found = sequences.withColumn("_p", model.probabilities(F.col("sequence")))
        scored = found.withColumns({f"p{h}h": F.col("_p")[i] for i, h in enumerate(model.horizons)}).drop("_p")
    probabilities = [F.col(f"p{h}h") for h in horizons]
    return scored.withColumns(
        {
            "escalation_likely": escalation_likely(F.col("p3h"), threshold),
            "escalation_confidence": escalation_confidence(*probabilities),
        }
    )


class UserModels:
    """Versions backed by a ``pandas.DataFrame -> pandas.DataFrame`` callable."""

    def __init__(self) -> None:
        self._models: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], StructType | str]] = {}

    def register_model(
        self, version: str, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str
    ) -> None:
        """``schema`` is that of the callable's output; its rows may be any subset of columns and more."""
        self._models[version] = (predict, schema)

    def apply(self, version: str, rows: DataFrame) -> DataFrame:
        """Score rows in Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows per call)."""
        if version not in self._models:
            raise ValueError(f"version {version} not found")
        predict, schema = self._models[version]

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield predict(part)

        return rows.mapInPandas(batches, schema)
