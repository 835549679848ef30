"""Feature table to an embedding run."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import EmbeddingModel, FeatureWeights, TextVectorization
from shelfwise.operators.svd import embed, truncated_svd
from shelfwise.operators.text_features import feature_matrix, feature_schema


def train_embedding(
    features: DataFrame,
    *,
    text: TextVectorization | None = None,
    weights: FeatureWeights | None = None,
    model: EmbeddingModel | None = None,
    exclude: Sequence[str] = ("num_user_ratings",),
    prefix_mode: bool = False,
) -> DataFrame:
    """Base columns and an ``embedding`` array per item.

    Columns are found by prefix. ``exclude`` leaves out the raw rating count,
    which only shares the ``num_`` prefix; ``prefix_mode`` keeps it.
    """
    text, weights, model = text or TextVectorization(), weights or FeatureWeights(), model or EmbeddingModel()
    if model.dimensions <= 0:
        raise ValueError("dimensions must be greater than zero")
    if features.isEmpty():
        raise ValueError("cannot train on an empty feature table")
    left_out = () if prefix_mode else tuple(exclude)
    matrix = feature_matrix(features, text, weights, exclude=left_out)
    projected, _, _ = truncated_svd(matrix, model.dimensions, seed=model.seed)
    return embed(features, projected, model.dimensions, normalize=model.normalize)


def manifest(
    run_id: str, created_at: str, features: DataFrame, model: EmbeddingModel, *, exclude: Sequence[str] = ()
) -> DataFrame:
    """One row describing a run: size, dimensions, feature schema and configuration."""
    schema = feature_schema(features, exclude=exclude)
    return features.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(run_id).alias("run_id"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        "row_count",
        F.lit(model.dimensions).alias("embedding_dimensions"),
        F.lit(json.dumps(schema)).alias("feature_schema"),
        F.lit(json.dumps(asdict(model))).alias("config"),
        F.lit(True).alias("complete"),
    )


def widen_embedding(vectors: DataFrame, dimensions: int) -> DataFrame:
    """The array as scalar columns ``embedding_dimension_0..k-1``."""
    names = {f"embedding_dimension_{at}": F.col("embedding")[at] for at in range(dimensions)}
    return vectors.withColumns(names).drop("embedding")


def narrow_embedding(vectors: DataFrame, declared: Sequence[str] | None = None) -> DataFrame:
    """Scalar dimension columns as one array, checking the declared columns."""
    found = [name for name in vectors.columns if name.startswith("embedding_dimension_")]
    if declared:
        missing = [name for name in declared if name not in found]
        if missing:
            raise ValueError(f"declared embedding columns are missing: {missing}")
    elif not found:
        raise ValueError("no embedding_dimension_* columns")
    columns = list(declared or found)
    return vectors.withColumn("embedding", F.array(*columns).cast("array<double>")).drop(*found)
