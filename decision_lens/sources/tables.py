"""Keyed tables and writers."""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from decision_lens.operators.metrics import last_per_key
from decision_lens.session import freeze, join_small

ORDER = "_seq"
BUCKET = "_bucket"
BUCKETS = 64


def latest(df: DataFrame, key: str) -> DataFrame:
    """One row per key: of the last put, and in it the one that comes last."""
    return last_per_key(df, key, ORDER)


class KeyedTable:
    """Parquet table with one visible row per key, in folders by the key's hash.

    A put appends one file a bucket, a read keeps the latest row of each key: a failed put leaves the old rows visible. ``get`` reads one
    bucket, with the key pushed into its scan. ``compact`` rewrites each bucket to the visible rows, so that the cost of a read does
    not grow with the number of puts; a bucket is replaced by one partition overwrite, and whatever of it a lost job leaves is rewritten
    by the next one. Compact while nothing else writes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = schema
        self.order = T.StructField(ORDER, T.StructType([T.StructField("at", T.LongType()), T.StructField("place", T.StringType())]))
        self.stored = T.StructType([*schema.fields, T.StructField("stored_at", T.TimestampType()), self.order, T.StructField(BUCKET, T.IntegerType())])

    def create(self) -> "KeyedTable":
        """Create the table if its path is missing; a path that holds something else is an error."""
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                self.clear()
            elif exc.getCondition() != "UNABLE_TO_INFER_SCHEMA" or not self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path).select("path").isEmpty():
                raise  # a table without rows has no files
        else:
            if not set(self.schema.fieldNames()) <= set(found.columns):
                raise ValueError(f"{self.path} holds something else")
        return self

    def _bucket_of(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """One task writes a bucket, so a put adds one file to each bucket that it touches."""
        rows.select(self.stored.fieldNames()).repartition(self.buckets, BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" else "static").partitionBy(BUCKET).parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.stored).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def put(self, rows: DataFrame, overwrite: bool = True, order: str | Column | None = None) -> int:
        """Store rows; of equal keys in one put the one with the largest ``order`` stays, of equal order the one that is
        greatest as JSON, so that the result never depends on how rows are spread.

        Returns the number of rows that cannot be stored because they have no key. They are counted apart: an Observation would
        leave an object in the session that keeps fitted linear models from being sent to tasks.
        """
        failed = rows.filter(F.col(self.key).isNull()).count()
        rows = rows.filter(F.col(self.key).isNotNull())
        first = (F.col(order) if isinstance(order, str) else order) if order is not None else F.lit(0)
        rows = last_per_key(rows.withColumn("_o", F.struct(first.alias("first"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.schema.fieldNames()])).alias("text"))), self.key, "_o")
        if not overwrite:
            rows = insert_if_absent(self.keys(), rows, self.key)
        at = F.struct(F.lit(time.time_ns()).alias("at"), F.col("_o.text").alias("place"))
        self._write(rows.withColumn("stored_at", F.current_timestamp()).withColumn(ORDER, at).withColumn(BUCKET, self._bucket_of(F.col(self.key))), "append")
        return failed

    def read(self, limit: int | None = None, order: list | None = None) -> DataFrame:
        """Visible rows; the first ``limit`` of them by ``order``, or any where no order is given."""
        rows = latest(self._raw(), self.key).select(self.schema.fieldNames())
        rows = rows if order is None else rows.orderBy(*order)
        return rows if limit is None else rows.limit(limit)

    def keys(self) -> DataFrame:
        """Only the key column reaches the scan."""
        return self._raw().select(self.key).distinct()

    def get(self, value) -> DataFrame:
        """Row of one key: one bucket is read, and the comparison is pushed into its scan."""
        bucket = self.spark.range(1).select(self._bucket_of(F.lit(value)).alias("b")).first()["b"]
        return latest(self._raw().filter((F.col(BUCKET) == bucket) & (F.col(self.key) == F.lit(value))), self.key).select(self.schema.fieldNames())

    def compact(self) -> None:
        """Rewrite every bucket to its visible rows, over a staged copy."""
        from decision_lens.session import stage
        others = [c for c in self.stored.fieldNames() if c not in (self.key, BUCKET)]
        newest = self._raw().groupBy(self.key, BUCKET).agg(F.max_by(F.struct(*others), ORDER).alias("_v")).select(self.key, "_v.*", BUCKET)
        self._write(stage(newest), "overwrite")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key over both frames."""
    return last_per_key(existing.unionByName(incoming), key, order)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return incoming.join(existing.select(key), key, "left_anti")


def grouped_store(items: DataFrame, group: str, item_key: str, part_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rows (group, part, items), counts): items gathered per group, those without a group counted failed.

    A group beyond ``part_rows`` is spread over parts by the hash of the item key, so no single
    list grows with the data; the parts together hold every item.
    """
    known = items.filter(F.col(group).isNotNull())
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    big = freeze(sizes.filter(F.col("_n") > part_rows))
    parts = F.coalesce(F.pmod(F.xxhash64(item_key), F.ceil(2 * F.col("_n") / part_rows)), F.lit(0))
    placed = join_small(known, big, group, "left").withColumn("part", parts.cast("int")).drop("_n")
    fields = [c for c in items.columns if c != group]
    rows = placed.groupBy(group, "part").agg(F.sort_array(F.collect_list(F.struct(item_key, *[
        c for c in fields if c != item_key]))).alias("items"))
    counts = items.agg(F.sum(F.col(group).isNotNull().cast("long")).alias("stored"),
                       F.sum(F.col(group).isNull().cast("long")).alias("failed"))
    return rows, counts


def storable(df: DataFrame) -> DataFrame:
    """Doubles as text where they are NaN or infinite, so that JSON can hold them; also inside structs, arrays and maps."""
    def text(c):
        return (F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity")
                .when(c == float("-inf"), "-Infinity").otherwise(c.cast("string")))

    def holds(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(holds(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return holds(kind.elementType)
        return holds(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (T.DoubleType, T.FloatType))

    def walk(c: Column, kind: T.DataType) -> Column:
        if not holds(kind):
            return c
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        return F.transform_values(c, lambda _, v: walk(v, kind.valueType)) if isinstance(kind, T.MapType) else text(c)

    return df.withColumns({f.name: walk(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if holds(f.dataType)})


def prediction_records(df: DataFrame) -> DataFrame:
    """(prediction_id, record JSON) in the shape of the prediction documents."""
    from decision_lens.operators.attribution import additivity, contributions
    from decision_lens.operators.cleaning import input_map
    from decision_lens.operators.counterfactual import change_map
    from decision_lens.schemas import FEATURE_COLUMNS, TECHNICAL
    df = additivity(df)
    none = F.array(F.create_map(F.lit("info"), F.lit("No counterfactuals found")))
    cfs = F.transform("counterfactuals", lambda cf: change_map(cf))
    record = F.struct(
        F.struct("prediction_id", "prediction", "probability", input_map(FEATURE_COLUMNS, TECHNICAL).alias("input_data"),
                 F.lit(None).cast("string").alias("timestamp")).alias("prediction"),
        (F.col("cluster_id") if "cluster_id" in df.columns else F.lit(None)).cast("int").alias("cluster_id"),
        F.struct("baseline", contributions().alias("contributions"), F.col("probability").alias("model_probability"),
                 "shap_sum_logit", "shap_probability", "difference").alias("shap_explanation"))
    head = F.to_json(record)
    tail = F.when(F.size("counterfactuals") > 0, F.to_json(cfs)).otherwise(F.to_json(none))
    return df.withColumn("_h", head).withColumn("_t", tail).select("prediction_id", F.concat(
        F.expr("left(_h, length(_h) - 1)"), F.lit(',"counterfactuals":'), F.col("_t"), F.lit("}")).alias("value"))


def write_predictions(df: DataFrame, path: str, metadata: dict) -> None:
    """JSON lines of prediction records plus a metadata row."""
    prediction_records(df).select("value").write.mode("overwrite").text(f"{path}/predictions")
    write_metadata(df.sparkSession, f"{path}/metadata", metadata)


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    spark.createDataFrame([(json.dumps(metadata),)], "value string").write.mode("overwrite").text(path)


def export_sample(full: DataFrame, sample: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Rows of the full predictions whose id was sampled."""
    return full.join(sample.select(key), key, "left_semi")


def write_requests(requests: DataFrame, path: str) -> None:
    """Judge requests as JSON lines."""
    requests.select(F.to_json(F.struct(*requests.columns)).alias("value")).write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    if form not in ("json", "csv"):
        raise ValueError(f"unsupported format: {form}")
    writer = df.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def write_evaluations(rows: DataFrame, summary: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def write_training_set(df: DataFrame, features: list[str], label: str, path: str, key: str = "row_id") -> None:
    df.select(key, *features).write.mode("overwrite").option("header", True).csv(f"{path}/x")
    df.select(key, label).write.mode("overwrite").option("header", True).csv(f"{path}/y")


def write_clusters(df: DataFrame, path: str) -> None:
    from decision_lens.operators.clustering import sizes
    df.select("row_id", "cluster_id").write.mode("overwrite").parquet(f"{path}/assignments")
    sizes(df).write.mode("overwrite").parquet(f"{path}/distribution")


def write_model(spark: SparkSession, model: PipelineModel, path: str, metadata: dict) -> None:
    model.write().overwrite().save(f"{path}/pipeline")
    write_metadata(spark, f"{path}/metadata", metadata)


def read_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return PipelineModel.load(f"{path}/pipeline"), meta
