"""Whole jobs put together from the operators: save, train, suggest, validate."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..ml import combine as CB, ensemble as EN, features as FE, train as TR
from ..operators import convert as V, corrections as C, positions as P, quality as Q, ranking as K
from ..scale import PAGE


def save_labels(boxes: DataFrame, path: str) -> None:
    """New page labels: group the boxes, write flat groups and entity pages, partitioned by document type."""
    V.item_groups(boxes).write.mode("append").parquet(f"{path}/groups")
    V.page_documents(V.entity_rows(boxes)).write.mode("append").json(f"{path}/entities")


def train_models(boxes: DataFrame, relations: bool = True, **params) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Forest over the box features, learned positions and learned corrections."""
    weighted = boxes.withColumn("weight", CB.sample_weight(F.col("ocr_confidence"), F.col("was_corrected")))
    data = TR.stable(FE.assemble(weighted, relations, ("label", "weight")))
    if not TR.enough(data):
        raise ValueError(f"at least {TR.MIN_SAMPLES} boxes are needed")
    corr = C.corrections_v1(boxes)
    return TR.train_forest(data, weight="weight", **params), P.position_ranges(boxes, ["doc_type", "label"]), C.learned_corrections(corr)


def suggest_labels(words: DataFrame, model: PipelineModel, ranges: DataFrame, relations: bool = True, ensemble: EN.Ensemble | None = None, sure_from: float = 0.8) -> DataFrame:
    """Ranked label suggestions per page: the combined predictor where there is one and it is sure, else the model where it
    is, else the learned position."""
    rows = FE.assemble(words, relations, ())
    scored = TR.probabilities(model, rows)
    sure = scored.select(*PAGE, "entity_seq", "predicted", "confidence")
    placed = P.position_predict(words, ranges).select(*PAGE, "entity_seq", "predicted", F.col("position_score").alias("confidence"))
    hybrid = EN.predict(ensemble, rows, words).filter(F.col("confidence") >= sure_from).drop("probs") if ensemble else sure.limit(0)
    best = CB.cascade(hybrid, sure, placed).withColumnRenamed("predicted", "label")
    return K.suggest_topk(best.join(words.select(*PAGE, "entity_seq", "x", "y", "text"), [*PAGE, "entity_seq"]))


def validate_dataset(items: DataFrame, fields: DataFrame) -> DataFrame:
    """One report row over a dataset."""
    return Q.validation_report(items, fields)
