"""Queries that write the tables as the files of the domain and read them back."""

from pyspark.sql import DataFrame, functions as F

from decision_lens.operators import clustering, salvage
from decision_lens.operators.metrics import match
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.explanation_data import EXPLANATIONS, explanations
from decision_lens.plans.models import ATTRIBUTED, CENTROIDS, CLUSTER_FEATURES, CLUSTERED, attributed, scaled_inputs
from decision_lens.plans.registry import query
from decision_lens.plans.tables import EVENT, _events, _new_path
from decision_lens.schemas import COLUMN_OF, FEATURE_COLUMNS, TECHNICAL
from decision_lens.session import stage
from decision_lens.sources import documents, readers, tables


@query("applicant_csv", f"""WITH {A.APPLICANTS}
SELECT row_id, label, {", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLUMNS if c not in ("income", "imputed_income", "debt_ratio"))},
  CASE WHEN isfinite(debt_ratio) THEN round(debt_ratio, 6) END AS debt_ratio, TRY_CAST(income AS DOUBLE) IS NULL AS income_is_text, round(TRY_CAST(income AS DOUBLE), 6) AS income FROM applicants""")
def applicant_csv(spark, sf_dir):
    """Applicants written under their technical names and read again."""
    raw = A.applicants(spark, sf_dir).withColumn("debt_ratio", F.when(F.abs("debt_ratio") != float("inf"), F.col("debt_ratio")))
    names = {"row_id": "Unnamed: 0", "label": "SeriousDlqin2yrs", **TECHNICAL}
    path = _new_path(spark)
    order = [f.name for f in readers.APPLICANT_CSV.fields]
    raw.select([F.col({v: k for k, v in names.items()}[n]).alias(n) for n in order]).write.option("header", True).csv(path)
    back = readers.applicants_csv(spark, path)
    plain = [c for c in FEATURE_COLUMNS if c not in ("income", "imputed_income")]
    value = F.col("income").try_cast("double")
    return back.select("row_id", "label", *rounded(plain), value.isNull().alias("income_is_text"), F.round(value, 6).alias("income"))


@query("training_set_files", f"""WITH {A.CLEAN} SELECT row_id, {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in FEATURE_COLUMNS)}, label FROM clean""")
def training_set_files(spark, sf_dir):
    path = _new_path(spark)
    tables.write_training_set(stage(A.model_inputs(spark, sf_dir)), FEATURE_COLUMNS, "label", path)
    return readers.processed_csv(spark, f"{path}/x", f"{path}/y").select(F.col("row_id").cast("long").alias("row_id"), *rounded(FEATURE_COLUMNS), F.col("label").cast("int").alias("label"))


def _twice(rows: DataFrame, path: str, member: str | None, key: str | None, stale) -> str:
    """Every record twice: a stale form in an earlier folder, the present one in a later folder; the path of both."""
    documents.write_documents(rows.withColumn("value", stale), f"{path}/1", member, key=key)
    documents.write_documents(rows, f"{path}/2", member, key=key)
    return f"{path}/*"


@query("predictions_documents", f"""WITH {ATTRIBUTED}
SELECT prediction_id, prediction, round(probability, 9) AS probability, round(income, 6) AS input_income, round(phi_income, 6) AS shap_income, row_id % 2 = 0 AS keyed FROM attributed""")
def predictions_documents(spark, sf_dir):
    """Prediction documents, keyed and listed, of which the later duplicate counts."""
    df = attributed(spark, sf_dir).withColumn("counterfactuals", F.array().cast(
        "array<struct<changes:array<struct<feature:string,`from`:double,`to`:double,diff:double,from_percentile:double,to_percentile:double,percentile_change:double>>>>"))
    records = stage(tables.prediction_records(df))
    stale = F.regexp_replace("value", r'"prediction":\d', '"prediction":7')
    keyed = F.substring_index("prediction_id", "-", -1).cast("long") % 2 == 0
    path, parts = _new_path(spark), []
    for name, rows, key in (("map", records.where(keyed), "prediction_id"), ("list", records.where(~keyed), None)):
        at = _twice(rows, f"{path}/{name}", "predictions", key, stale)
        parts.append(readers.flat_predictions(readers.predictions(spark, at)).withColumn("keyed", F.lit(key is not None)))
    return parts[0].unionByName(parts[1]).select("prediction_id", "prediction", F.round("probability", 9).alias("probability"), F.round("input_MonthlyIncome", 6).alias("input_income"),
                                                 F.round("shap_MonthlyIncome", 6).alias("shap_income"), "keyed")


@query("explanations_documents", f"""WITH {EXPLANATIONS}
SELECT explanation_id, prediction_id, llm_name, regeneration_number, processing_time, parse_stage FROM explanations""")
def explanations_documents(spark, sf_dir):
    """Explanation documents, bare lists and members of an object, salvaged after reading."""
    rows = explanations(spark, sf_dir)
    records = stage(rows.select("doc_id", F.to_json(F.struct("prediction_id", "explanation_id", "llm_name", "regeneration_number", "explanation_text", "processing_time")).alias("value")))
    path = _new_path(spark)
    documents.write_documents(records.where("doc_id % 2 = 0"), f"{path}/a", "explanations")
    documents.write_documents(records.where("doc_id % 2 = 1"), f"{path}/b", None)
    return salvage.salvage_responses(readers.explanations(spark, f"{path}/*")).select(
        "explanation_id", "prediction_id", "llm_name", "regeneration_number", "processing_time", "parse_stage")


@query("results_documents", """SELECT 'c-' || conv_id || '-' || turn AS explanation_id, turn::INTEGER AS batch_index, CASE WHEN length(role) % 2 = 0 THEN '1' ELSE 'N/A' END AS item_1,
  CASE WHEN conv_id % 10 = 0 THEN 'no_judgement' ELSE 'matched' END AS match_status FROM conversations""")
def results_documents(spark, sf_dir):
    """Judge results in documents, each stored twice; the last one is matched to its explanation."""
    rows = A.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("explanation_id"),
        F.when(F.length("role") % 2 == 0, "1").otherwise("N/A").alias("item"))
    result = F.struct(F.struct(F.struct(F.create_map(F.lit("item_1"), F.col("item")).alias("understandability_items")).alias("cemat_evaluation")).alias("evaluation_result"),
                      F.struct("explanation_id").alias("metadata"), F.col("turn").alias("batch_index"))
    records = stage(rows.where("conv_id % 10 <> 0").select("conv_id", F.to_json(result).alias("value")))
    path, stale = _new_path(spark), F.regexp_replace("value", r'"batch_index":\d+', '"batch_index":-1')
    found = [readers.batch_results(spark, _twice(records.where(f"conv_id % 2 = {i}"), f"{path}/{i}", member, None, stale), ordered=True)
             for i, member in enumerate(["results", None])]
    judged = found[0].unionByName(found[1]).select(F.col("metadata.explanation_id").alias("explanation_id"), "batch_index",
                                                   F.element_at("evaluation_result.cemat_evaluation.understandability_items", "item_1").alias("item_1"), F.col("source_order").alias("seq"))
    known = rows.select("explanation_id", F.col("explanation_id").alias("prediction_id"), "turn", "item")
    out = match(known, known.select("prediction_id"), judged)
    return out.select("explanation_id", F.coalesce("batch_index", F.col("turn").cast("int")).alias("batch_index"), F.coalesce("item_1", "item").alias("item_1"), "match_status")


@query("cluster_documents", f"WITH {CLUSTERED} SELECT row_id, cluster_id::INTEGER AS cluster_id, round(income, 6) AS income FROM clustered")
def cluster_documents(spark, sf_dir):
    """The cluster map as documents of names and numbers, read by many tasks and attached to the applicants."""
    from decision_lens.operators.scoring import attach_clusters
    inputs = stage(scaled_inputs(spark, sf_dir))
    given = clustering.assign(inputs, CLUSTER_FEATURES, CENTROIDS)
    path = _new_path(spark)
    documents.write_documents(given.select(F.col("row_id").cast("string").alias("k"), F.col("cluster_id").cast("string").alias("value")), path, "index_to_cluster", key="k")
    return attach_clusters(inputs, readers.cluster_assignments(spark, path)).select("row_id", "cluster_id", *rounded(["income"]))


@query("cluster_files", f"""WITH {CLUSTERED} SELECT cluster_id::INTEGER AS cluster_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) AS assigned FROM clustered GROUP BY 1""")
def cluster_files(spark, sf_dir):
    path = _new_path(spark)
    tables.write_clusters(stage(clustering.assign(scaled_inputs(spark, sf_dir), CLUSTER_FEATURES, CENTROIDS)), path)
    counted = spark.read.parquet(f"{path}/assignments").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("assigned"))
    return spark.read.parquet(f"{path}/distribution").join(counted, "cluster_id").select(F.col("cluster_id").cast("int").alias("cluster_id"), "n", *rounded(["share"]), "assigned")


@query("judge_lines", """SELECT 'c-' || conv_id || '-' || turn AS explanation_id, role AS llm_name, text AS judge_text FROM conversations""")
def judge_lines(spark, sf_dir):
    """Batch responses as JSON lines."""
    rows = A.table(spark, sf_dir, "conversations")
    part = F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content")))
    keys = F.struct(F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("explanation_id"), F.col("role").alias("llm_name"))
    path = _new_path(spark)
    rows.select(F.to_json(F.struct(F.struct(part.alias("candidates")).alias("response"), keys.alias("custom_metadata"))).alias("value")).write.text(path)
    return readers.judge_responses(spark, path).select("explanation_id", "llm_name", "judge_text")


@query("result_files", """SELECT row_id, round(value, 6) AS value, kind FROM (SELECT event_id AS row_id, value, 'csv' AS kind FROM events UNION ALL SELECT event_id, value, 'json' FROM events)""")
def result_files(spark, sf_dir):
    """Result rows as CSV and as JSON lines."""
    rows, path, parts = _events(spark, sf_dir).select(F.col("event_id").alias("row_id"), "value"), _new_path(spark), []
    for kind in ("csv", "json"):
        tables.write_results(rows, f"{path}/{kind}", kind)
        reader = spark.read.schema("row_id long, value double")
        parts.append((reader.option("header", True).csv if kind == "csv" else reader.json)(f"{path}/{kind}").withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1]).select("row_id", *rounded(["value"]), "kind")


@query("keyed_lifecycle", """WITH last AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1),
t AS (SELECT user_id, event_id, event_type, value FROM events JOIN last USING (user_id, event_id))
SELECT 'kept' AS state, * FROM t UNION ALL SELECT 'one', * FROM t WHERE user_id = (SELECT max(user_id) FROM events)
UNION ALL SELECT 'first', * FROM (SELECT * FROM t ORDER BY value DESC, user_id LIMIT 10)""")
def keyed_lifecycle(spark, sf_dir):
    """Cleared, filled by several puts, compacted, then read whole, by one key and by an ordered limit."""
    events = _events(spark, sf_dir)
    table = tables.KeyedTable(spark, _new_path(spark), EVENT, "user_id", buckets=8).create()
    table.put(events.withColumn("event_type", F.lit("stale")))
    table.clear()
    for i in range(3):
        table.put(events.where(F.col("event_id") % 3 <= i), order="event_id")
    table.compact()
    one = table.get(events.agg(F.max("user_id")).first()[0])
    first = table.read(limit=10, order=[F.desc("value"), "user_id"])
    return (table.read().withColumn("state", F.lit("kept")).unionByName(one.withColumn("state", F.lit("one"))).unionByName(first.withColumn("state", F.lit("first"))))


@query("fields_flattened", """SELECT conv_id AS key_conv, turn AS key_turn, role AS "said by", length(text)::INTEGER AS body_size_chars FROM conversations""")
def fields_flattened(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").select(
        F.struct(F.col("conv_id").alias("conv"), "turn").alias("key"), F.struct("role", F.struct(F.length("text").alias("chars")).alias("size")).alias("body"))
    return readers.flatten(rows, {"body_role": "said by"})
