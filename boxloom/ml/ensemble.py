"""The combined predictor: a forest, two boosted models and the sequence model, averaged with fixed weights."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..scale import PAGE
from . import train as TR
from .combine import BOX, WEIGHTS, weighted_arrays
from .marginals import sequence_probabilities

# Settings of the two boosted models.
BOOSTED_A = {"maxIter": 20, "maxDepth": 6, "stepSize": 0.1}
BOOSTED_B = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 43}


@dataclass(frozen=True)
class Ensemble:
    """Fitted models by name, the training boxes of the sequence model, and the labels in the order of the arrays."""

    labels: list[str]
    models: dict[str, PipelineModel]
    boxes: DataFrame
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def label_probabilities(model: PipelineModel, rows: DataFrame, name: str = "probs") -> DataFrame:
    """Probability of each of the model's labels as an array; those of one-against-rest models are scaled to sum to 1."""
    index, fitted = model.stages[0], model.stages[1]
    n = len(index.labels)
    if not isinstance(fitted, OneVsRestModel):
        out = fitted.transform(rows)
        return out.withColumn(name, F.slice(vector_to_array("probability"), 1, n)).drop("rawPrediction", "probability", "prediction")
    out = rows
    for k, part in enumerate(fitted.models[:n]):
        part = part.copy({}).setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_p{k}").setPredictionCol(f"_y{k}")
        out = part.transform(out).drop(f"_r{k}", f"_y{k}")
    own = F.array(*[vector_to_array(f"_p{k}")[1] for k in range(n)])
    total = F.aggregate(own, F.lit(0.0), lambda x, y: x + y)
    return out.withColumn(name, F.transform(own, lambda v: v / total)).drop(*[f"_p{k}" for k in range(n)])


def fit(rows: DataFrame, boxes: DataFrame, weight: str | None = None, forest: Mapping | None = None, boosted: tuple[Mapping, Mapping] = (BOOSTED_A, BOOSTED_B),
        weights: Mapping[str, float] = WEIGHTS) -> Ensemble:
    """Fit all models on the same pages: ``rows`` with ``features`` and ``label``, ``boxes`` with text and place."""
    models = {"forest": TR.train_forest(rows, weight=weight, **(forest or {}))}
    for name, settings in zip(("boosted_a", "boosted_b"), boosted, strict=True):
        models[name] = TR.train_boosted(rows, parallelism=4, **settings)
    return Ensemble(list(models["forest"].stages[0].labels), models, boxes, dict(weights))


def predict(ensemble: Ensemble, rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """``predicted, confidence, probs`` per box; the first label in the alphabet on ties. ``rows``: features of ``boxes``."""
    out, names = rows.select(*BOX, "features"), list(ensemble.models)
    for name in names:
        out = label_probabilities(ensemble.models[name], out, name)
    chain = sequence_probabilities(boxes, ensemble.boxes, ensemble.labels).withColumnRenamed("probs", "sequence")
    joined = out.join(chain, BOX)
    mean = weighted_arrays([F.col(n) for n in [*names, "sequence"]], [ensemble.weights[n] for n in [*names, "sequence"]])
    scored = joined.select(*PAGE, "entity_seq", F.transform(mean, lambda v: F.round(v, 12)).alias("probs")).withColumn("confidence", F.array_max("probs"))
    labels = F.array(*[F.lit(x) for x in ensemble.labels])
    return scored.select(*BOX, F.element_at(labels, F.array_position("probs", F.col("confidence")).cast("int")).alias("predicted"), "confidence", "probs")
