"""From feature views to a saved, evaluated model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators.features import FeatureView, get_historical_features
from tierline.operators.models import (
    classification_metrics, fit_model, predict, regression_metrics, save_model, train_test_split,
)
from tierline.operators.sinks import write_parquet
from tierline.session import scratch_path


def train_from_views(entity_df: DataFrame, refs: Sequence[tuple[FeatureView, Sequence[str] | None]],
                     entity_ts: str, label: str, keys: Sequence[str], model_path: str,
                     framework: str = "random_forest", task: str = "classification", test_size: float = 0.2,
                     seed: int = 42, fill: float | None = 0.0, **params) -> dict:
    """Entity rows -> point-in-time features -> split -> fit -> metrics -> saved model.

    Features are all columns that the views add.  The training frame is written once
    and read by the fit and the evaluation.  Returns the model's path, the feature
    names, the scored frame (entity columns, features as the model saw them with
    NULLs replaced by ``fill``, split, prediction) and one metrics row per split."""
    spark = entity_df.sparkSession
    joined = get_historical_features(entity_df, refs, entity_ts)
    features = [c for c in joined.columns if c not in entity_df.columns]
    path = scratch_path(spark, "training")
    write_parquet(train_test_split(joined, keys, test_size, seed), path)
    frame = spark.read.parquet(path)
    model = fit_model(frame.filter(F.col("split") == "train"), features, label, framework, task,
                      seed=seed, fill=fill, **params)
    scored = predict(model, frame, features, [*entity_df.columns, *features, "split"], probabilities=False, fill=fill)
    measure = classification_metrics if task == "classification" else regression_metrics
    metrics = None
    for split in ("train", "test"):
        part = scored.filter(F.col("split") == split)
        rows = part.select(F.col(label).cast("double").alias("label"), "prediction")
        one = measure(rows, "label", "prediction").withColumn("split", F.lit(split))
        metrics = one if metrics is None else metrics.unionByName(one)
    return {"model": save_model(model, model_path), "features": features, "scored": scored, "metrics": metrics}
