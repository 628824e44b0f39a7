"""Readers of applicant files, prediction documents, explanations and judge results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from decision_lens.schemas import (APPLICANT_CSV, COLUMN_OF, EXPLANATION_RECORD, JUDGE_RECORD, PREDICTION_RECORD,
                                   Frozen)
from decision_lens.sources.documents import elements, entry_record

METADATA = "struct<prediction_id:string,llm_name:string,explanation_id:string>"
RESULT = f"struct<evaluation_result:{JUDGE_RECORD},metadata:{METADATA},batch_index:int>"


def applicants_csv(spark: SparkSession, path: str, schema: T.StructType = APPLICANT_CSV) -> DataFrame:
    """Applicant CSV under library column names; the index column becomes row_id, the target label."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    names = {**COLUMN_OF, "Unnamed: 0": "row_id", "SeriousDlqin2yrs": "label"}
    return df.select([F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def processed_csv(spark: SparkSession, x_path: str, y_path: str, key: str = "row_id") -> DataFrame:
    """Feature file and target file that share a key column."""
    def read(p):
        return spark.read.option("header", True).option("inferSchema", True).csv(p)
    return read(x_path).join(read(y_path), key)


def frozen_parameters(text: str, **model) -> Frozen:
    """Frozen parameters from the metadata JSON text; median income falls back to 5400."""
    meta = json.loads(text)
    stats = meta.get("descriptive_statistics", {})
    return Frozen(
        caps={COLUMN_OF.get(k, k): tuple(map(float, v)) for k, v in meta.get("trimmed_values", {}).items()},
        median_income=float(stats.get("MonthlyIncome", {}).get("median", 5400.0)),
        log_columns=tuple(COLUMN_OF.get(c, c) for c in meta.get("log_scale_features", [])),
        dropped_columns=tuple(meta.get("dropped_columns", ())), **model)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents, one per file; for documents that are one record."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("path"))


def later(df: DataFrame, key: str, order: str = "source_order") -> DataFrame:
    """Of repeated keys the row that comes last: in a later file, or later in the same one."""
    others = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_v")).select(key, "_v.*")


def predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(prediction_id, record): JSON lines, or documents whose ``predictions`` is a map or a list, of any size.

    Keyed by the id inside the record; of repeated ids the later one wins, by file path and place in the file.
    """
    if lines:
        order = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
        rows = spark.read.text(path).select(F.from_json("value", PREDICTION_RECORD).alias("record"), F.lit(None).cast("string").alias("outer"), order.alias("source_order"))
    else:
        e = entry_record(F.col("value"), PREDICTION_RECORD)
        rows = elements(spark, path, keep="predictions").select(e.alias("e"), "source_order").select(
            F.col("e.value").alias("record"), F.col("e.key").alias("outer"), "source_order")
    rows = rows.withColumn("prediction_id", F.coalesce("record.prediction.prediction_id", "outer"))
    return later(rows.filter(F.col("prediction_id").isNotNull()).drop("outer"), "prediction_id")


CHANGE = "struct<`from`:double,`to`:double,diff:double,from_percentile:double,to_percentile:double,percentile_change:double>"


def is_placeholder(cf: Column) -> Column:
    return F.map_contains_key(cf, "info") | F.map_contains_key(cf, "error")


def first_change(cf: Column) -> Column:
    """Absolute percentile change of the first changed feature of a counterfactual."""
    value = F.get(F.map_values(cf), F.lit(0))
    return F.abs(F.from_json(value, CHANGE)["percentile_change"])


def flat_predictions(records: DataFrame) -> DataFrame:
    """One flat row per prediction: input_*, shap_* and counterfactual counts.

    ``cf_count`` leaves placeholders out, ``cf_count_raw`` counts every entry.
    """
    r = F.col("record")
    found = F.filter(r["counterfactuals"], lambda c: ~is_placeholder(c))
    changes = F.filter(F.transform(found, first_change), lambda x: x.isNotNull())
    total = F.aggregate(changes, F.lit(0.0), lambda a, x: a + x)
    return records.select(
        "prediction_id", r["prediction"]["prediction"].alias("prediction"), r["prediction"]["probability"].alias("probability"),
        r["cluster_id"].alias("cluster_id"),
        *[r["prediction"]["input_data"][t].alias(f"input_{t}") for t in COLUMN_OF],
        *[r["shap_explanation"]["contributions"][t].alias(f"shap_{t}") for t in COLUMN_OF],
        r["shap_explanation"]["baseline"].alias("shap_baseline"),
        F.coalesce(F.size(found), F.lit(0)).alias("cf_count"),
        F.coalesce(F.size(r["counterfactuals"]), F.lit(0)).alias("cf_count_raw"),
        changes.alias("cf_percentile_changes"),
        F.when(F.size(changes) > 0, total / F.size(changes)).otherwise(0.0).alias("cf_avg_percentile_change"))


def explanations(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Explanation records from an object with ``explanations`` or a bare list; documents of any size.

    ``ordered`` adds source_order, the place of a record among all files.
    """
    rows = elements(spark, path, keep="explanations").select(F.from_json("value", EXPLANATION_RECORD).alias("r"), "source_order")
    return rows.select("r.*", *(["source_order"] if ordered else []))


def batch_results(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Judge results from {results: [...]}, a list (both of any size), or a single object per file."""
    found = elements(spark, path)
    single = found.groupBy(F.col("source_order.path").alias("path")).agg(
        F.max(F.col("member") == "results").alias("many"), F.max(F.col("member") == "").alias("bare")).where("not many and not bare").select("path")
    alone = _whole(spark, path).join(single, "path", "left_semi").select(
        F.from_json("doc", RESULT).alias("r"), F.struct("path", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("place")).alias("source_order"))
    rows = found.where(F.col("member").isin("results", "")).select(F.from_json("value", RESULT).alias("r"), "source_order").unionByName(alone)
    return rows.select("r.*", *(["source_order"] if ordered else []))


def judge_responses(spark: SparkSession, path: str) -> DataFrame:
    """Raw judge text and its keys from JSON lines of batch responses."""
    raw = spark.read.text(path)
    return raw.select(
        F.get_json_object("value", "$.response.candidates[0].content.parts[0].text").alias("judge_text"),
        F.from_json(F.get_json_object("value", "$.custom_metadata"), METADATA).alias("m")).select("judge_text", "m.*")


def results_by_priority(*sources: DataFrame, key: str = "explanation_id") -> DataFrame:
    """One result per key; an earlier source beats a later one. All sources are read once."""
    tagged = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    others = [c for c in every.columns if c not in (key, "_priority")]
    return every.groupBy(key).agg(F.min_by(F.struct(*others), "_priority").alias("_v")).select(key, "_v.*")


def cluster_assignments(spark: SparkSession, path: str | None) -> DataFrame:
    """(row_id, cluster_id) from the assignment document; no path gives no assignments."""
    if path is None:
        return spark.createDataFrame([], "row_id long, cluster_id int")
    entry = F.get(F.map_entries(F.from_json(F.concat(F.lit("{"), F.col("value"), F.lit("}")), "map<string,int>")), F.lit(0))
    rows = elements(spark, path, cut=",", keep="index_to_cluster").select(entry.alias("e"), "source_order")
    return later(rows.select(F.col("e.key").try_cast("long").alias("row_id"), F.col("e.value").alias("cluster_id"), "source_order"), "row_id")


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary source unless it is empty."""
    return secondary if primary.isEmpty() else primary


def flatten(df: DataFrame, renames: dict | None = None, separator: str = "_") -> DataFrame:
    """Nested structs to flat columns joined by a separator, with optional renames."""
    def walk(field: T.StructField, path: str, name: str):
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                yield from walk(f, f"{path}.`{f.name}`", f"{name}{separator}{f.name}")
        else:
            yield F.col(path).alias((renames or {}).get(name, name))
    return df.select([c for f in df.schema.fields for c in walk(f, f"`{f.name}`", f.name)])
