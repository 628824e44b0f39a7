"""K-means sweep, assignment and cluster profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vectors; a missing value is 0, as in scoring (C11)."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.na.fill(0.0, subset=features))


def kmeans_sweep(df: DataFrame, features: list[str], ks=range(2, 7), seed: int = 42) -> DataFrame:
    """Inertia and squared-Euclidean silhouette per k, over all rows."""
    rows = assembled(df, features).select("features").persist()
    judge = ClusteringEvaluator(distanceMeasure="squaredEuclidean")
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
        out.append((k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(rows)))))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, inertia double, silhouette_sq_euclidean double")


def fit_centroids(df: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> list[list[float]]:
    model = KMeans(k=k, seed=seed).fit(assembled(df, features).select("features"))
    return [list(map(float, c)) for c in model.clusterCenters()]


def assign(df: DataFrame, features: list[str], centroids: list[list[float]]) -> DataFrame:
    """Nearest centroid as plain columns; the lower cluster number wins a tie."""
    def distance(c):
        return reduce(lambda a, b: a + b, [(F.col(f) - v) * (F.col(f) - v) for f, v in zip(features, c)])
    nearest = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i"))
                                    for i, c in enumerate(centroids)]))
    return df.withColumn("_near", nearest).withColumn("cluster_id", F.col("_near.i")).withColumn(
        "cluster_distance", F.col("_near.d")).drop("_near")


def sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    counts = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def profile(df: DataFrame, features: list[str], cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in features])
