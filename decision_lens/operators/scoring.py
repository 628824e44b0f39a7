"""Batch scoring with a frozen linear model as plain columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from decision_lens.functions.columns import logistic
from decision_lens.schemas import FEATURE_COLUMNS, Frozen


def scaled(c: str, frozen: Frozen, value: Column | None = None) -> Column:
    """Missing as 0, then (x - center) / scale."""
    x = F.coalesce(F.col(c) if value is None else value, F.lit(0.0))
    return (x - frozen.center[c]) / frozen.scale[c]


def linear_logit(frozen: Frozen, values: dict[str, Column] | None = None) -> Column:
    values = values or {}
    terms = [F.lit(frozen.weights[c]) * scaled(c, frozen, values.get(c)) for c in FEATURE_COLUMNS]
    return reduce(lambda a, b: a + b, terms, F.lit(frozen.intercept))


def score_linear(df: DataFrame, frozen: Frozen, threshold: float = 0.5) -> DataFrame:
    """Adds logit, probability of default, prediction (1 = declined) and a stable id."""
    return (df.withColumn("logit", linear_logit(frozen))
            .withColumn("probability", logistic(F.col("logit")))
            .withColumn("prediction", F.when(F.col("probability") > threshold, 1).otherwise(0))
            .withColumn("prediction_id", F.concat(F.lit("app-"), F.col("row_id").cast("string"))))


def attach_clusters(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Left look-up of the cluster by row id; rows without one keep null."""
    return df.join(clusters.select("row_id", "cluster_id"), "row_id", "left")
