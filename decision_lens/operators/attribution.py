"""Shapley attributions in log-odds space."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from decision_lens.functions.columns import logistic, logit
from decision_lens.operators.training import score_model
from decision_lens.schemas import FEATURE_COLUMNS, TECHNICAL, Frozen


def background_means(df: DataFrame, features: list[str] = FEATURE_COLUMNS) -> dict:
    """Means of the background rows with missing as 0, as literals."""
    return df.agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in features]).first().asDict()


def linear_attribution(df: DataFrame, frozen: Frozen, means: dict) -> DataFrame:
    """Exact values of a linear model: weight * (x - background mean) / scale, as phi_<feature>."""
    baseline = frozen.intercept
    for c in FEATURE_COLUMNS:
        baseline += frozen.weights[c] * ((means[c] - frozen.center[c]) / frozen.scale[c])
    phi = {f"phi_{c}": F.lit(frozen.weights[c]) * ((F.coalesce(F.col(c), F.lit(0.0)) - means[c]) / frozen.scale[c])
           for c in FEATURE_COLUMNS}
    return df.withColumns(phi).withColumn("baseline", F.lit(baseline))


def contributions(names: dict = TECHNICAL) -> F.Column:
    """Map technical name -> phi from the phi_ columns."""
    return F.create_map(*[x for c in FEATURE_COLUMNS for x in (F.lit(names[c]), F.col(f"phi_{c}"))])


def additivity(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Sum of attributions plus baseline against the model's probability."""
    total = reduce(lambda a, b: a + b, [F.col(f"phi_{c}") for c in FEATURE_COLUMNS], F.col("baseline"))
    return (df.withColumn("shap_sum_logit", total)
            .withColumn("shap_probability", logistic(F.col("shap_sum_logit")))
            .withColumn("difference", F.abs(F.col("shap_probability") - F.col("probability")))
            .withColumn("additivity_broken", F.col("difference") > threshold))


def long_attribution(df: DataFrame, key: str = "prediction_id") -> DataFrame:
    """(key, feature, value, phi); narrow, no shuffle."""
    cells = F.array(*[F.struct(F.lit(TECHNICAL[c]).alias("feature"), F.col(c).alias("value"),
                               F.col(f"phi_{c}").alias("phi")) for c in FEATURE_COLUMNS])
    return df.select(key, F.inline(cells))


def ranked_features(keep=None) -> F.Column:
    """Array of (size, feature, phi), largest absolute value first, ties by name."""
    cells = F.array(*[F.struct((-F.abs(F.col(f"phi_{c}"))).alias("size"), F.lit(TECHNICAL[c]).alias("feature"),
                               F.col(f"phi_{c}").alias("phi")) for c in FEATURE_COLUMNS])
    return F.sort_array(F.filter(cells, keep) if keep is not None else cells)


def top_features(df: DataFrame, n: int = 5, key: str = "prediction_id") -> DataFrame:
    """Top n per row among positive, negative and all attributions; sorted inside the row."""
    kinds = {"positive": lambda s: s["phi"] > 0, "negative": lambda s: s["phi"] < 0, "overall": None}
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.slice(ranked_features(f), 1, n).alias("top"))
                      for k, f in kinds.items()])
    return (df.select(key, F.inline(parts)).select(key, "kind", F.posexplode("top").alias("pos", "s"))
            .select(key, "kind", (F.col("pos") + 1).alias("position"), F.col("s.feature").alias("feature"),
                    F.col("s.phi").alias("phi")))


def global_importance(df: DataFrame, n: int = 10) -> DataFrame:
    row = df.agg(*[F.avg(F.abs(F.col(f"phi_{c}"))).alias(c) for c in FEATURE_COLUMNS])
    cells = F.array(*[F.struct(F.lit(TECHNICAL[c]).alias("feature"), F.col(c).alias("mean_abs_phi"))
                      for c in FEATURE_COLUMNS])
    return row.select(F.inline(cells)).orderBy(F.desc("mean_abs_phi"), "feature").limit(n)


def permutation_attribution(df: DataFrame, model: PipelineModel, means: dict, features: list[str],
                            key: str = "row_id", permutations: int = 4) -> DataFrame:
    """Sampled-order Shapley values of any fitted pipeline against the background means.

    Each row is expanded into its own feature orders (seeded by the key). Along an order the
    features switch from background to actual value one by one; the change of the logit at a
    step belongs to the feature switched there. The expansion is narrow; only sums per
    (row, feature) are shuffled.
    """
    d = len(features)
    orders = df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    tickets = F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(f), F.col(key).cast("string"),
                                                   F.col("perm").cast("string"))).alias("h"),
                                 F.lit(i).alias("i")) for i, f in enumerate(features)])
    order = F.transform(F.sort_array(tickets), lambda t: t["i"])
    steps = orders.withColumn("_order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = steps.select(key, "perm", "step", "_order", *[
        F.when(F.array_position("_order", F.lit(i)) <= F.col("step"), F.coalesce(F.col(f), F.lit(0.0)))
        .otherwise(F.lit(float(means[f]))).alias(f) for i, f in enumerate(features)])
    scored = score_model(mixed, model, [key, "perm", "step", "_order"]).withColumn(
        "_z", logit(F.col("probability")))
    # every step's logit counts + for the feature switched there and - for the next one
    shares = F.array(
        F.struct(F.try_element_at("_order", F.when(F.col("step") > 0, F.col("step"))).alias("i"),
                 F.col("_z").alias("part")),
        F.struct(F.try_element_at("_order", F.when(F.col("step") < d, F.col("step") + 1)).alias("i"),
                 (-F.col("_z")).alias("part")))
    names = F.array(*[F.lit(TECHNICAL.get(f, f)) for f in features])
    return (scored.select(key, F.inline(shares)).filter("i is not null").groupBy(key, "i")
            .agg((F.sum("part") / permutations).alias("phi"))
            .select(key, F.element_at(names, F.col("i") + 1).alias("feature"), "phi",
                    F.lit(f"permutation x{permutations}").alias("estimator")))
