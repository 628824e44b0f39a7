"""Queries over readers, keyed tables and exports."""

import uuid

from pyspark.sql import functions as F, types as T

from decision_lens.operators.sampling import category_sample
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.models import COUNTERFACTUALS, explained
from decision_lens.plans.registry import query
from decision_lens.plans.sampling import CATEGORY, population
from decision_lens.schemas import FEATURE_COLUMNS, TECHNICAL
from decision_lens.session import scratch_dir
from decision_lens.sources import readers, tables

EVENT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
                      T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _events(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")


def _new_path(spark) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


@query("keyed_upsert", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY 1""")
def keyed_upsert(spark, sf_dir):
    events = _events(spark, sf_dir)
    table = tables.KeyedTable(spark, _new_path(spark), EVENT, "user_id").create()
    half = events.agg(F.max("event_id")).first()[0] // 2
    table.put(events.filter(F.col("event_id") <= half), order="event_id")
    table.put(events.filter(F.col("event_id") > half), order="event_id")
    return table.read()


@query("insert_if_absent", """WITH s AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE (user_id + event_id) % 5 = 0 GROUP BY 1),
c AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE (user_id + event_id) % 5 <> 0 GROUP BY 1)
SELECT user_id, event_id, event_type, value FROM events JOIN (FROM s UNION ALL FROM c ANTI JOIN s USING (user_id)) USING (user_id, event_id)""")
def insert_if_absent(spark, sf_dir):
    events = _events(spark, sf_dir)
    table = tables.KeyedTable(spark, _new_path(spark), EVENT, "user_id").create()
    table.put(events.filter("(user_id + event_id) % 5 = 0"), order="event_id")
    table.put(events.filter("(user_id + event_id) % 5 <> 0"), overwrite=False, order="event_id")
    return table.read()


@query("grouped_store", """SELECT conv_id, count(*) AS n_items, string_agg(turn, '|' ORDER BY turn) AS turns, sum(length(text))::BIGINT AS n_chars
FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1""")
def grouped_store(spark, sf_dir):
    items = A.table(spark, sf_dir, "conversations").select(
        F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("conv_id"), "turn", "text")
    rows, _ = tables.grouped_store(items, "conv_id", "turn")
    return rows.groupBy("conv_id").agg(
        F.sum(F.size("items")).alias("n_items"),
        F.array_join(F.array_sort(F.flatten(F.collect_list(F.transform("items", lambda i: i["turn"])))), "|").alias("turns"),
        F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + F.length(i["text"]))).alias("n_chars"))


@query("grouped_store_counts", """SELECT count(*) FILTER (conv_id % 7 <> 0) AS stored, count(*) FILTER (conv_id % 7 = 0) AS failed FROM conversations""")
def grouped_store_counts(spark, sf_dir):
    items = A.table(spark, sf_dir, "conversations").select(
        F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("conv_id"), "turn", "text")
    return tables.grouped_store(items, "conv_id", "turn")[1]


@query("semi_export", f"WITH {CATEGORY} SELECT prediction_id, round(probability, 6) AS probability FROM sample")
def semi_export(spark, sf_dir):
    pop = population(spark, sf_dir).withColumn("prediction_id", F.concat(F.lit("app-"), F.col("row_id").cast("string")))
    return tables.export_sample(pop, category_sample(pop, "row_id")).select("prediction_id", *rounded(["probability"]))


@query("source_fallback", "SELECT user_id, event_id, event_type, value FROM events")
def source_fallback(spark, sf_dir):
    events = _events(spark, sf_dir)
    return readers.with_fallback(events.filter("event_id < 0"), events)


@query("results_by_priority", """SELECT user_id, arg_min(value, source) AS value, min(source)::INTEGER AS source
FROM (SELECT user_id, (user_id + event_id) % 3 AS source, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1""")
def results_by_priority(spark, sf_dir):
    def best(source):
        return _events(spark, sf_dir).filter((F.col("user_id") + F.col("event_id")) % 3 == source).groupBy("user_id").agg(
            F.max("value").alias("value")).withColumn("source", F.lit(source))
    return readers.results_by_priority(best(0), best(1), best(2), key="user_id").select("user_id", "value", "source")


_ODD = {"utilisation": (13, "nan"), "age": (17, "-inf"), "late_90": (19, "inf")}
_DOUBLES = [c for c in FEATURE_COLUMNS if c not in ("income", "imputed_income")]


def _kind_sql(c):
    m, v = _ODD.get(c, (1, None))
    text = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}
    odd = f"WHEN row_id % {m} = 0 THEN '{text[v]}' " if v else ""
    return f"CASE {odd}WHEN {c} IS NULL THEN NULL WHEN isinf({c}) THEN 'Infinity' ELSE 'finite' END AS {c}"


@query("storable_values", f"""WITH {A.APPLICANTS} SELECT row_id, {", ".join(_kind_sql(c) for c in _DOUBLES)}, {_kind_sql("late_90").replace("AS late_90", "AS nested")} FROM applicants""")
def storable_values(spark, sf_dir):
    """Every number column as storable text, by kind; one also inside a struct of an array."""
    df = A.applicants(spark, sf_dir)
    for c, (m, v) in _ODD.items():
        df = df.withColumn(c, F.when(F.col("row_id") % m == 0, float(v)).otherwise(F.col(c)))
    out = tables.storable(df.select("row_id", *_DOUBLES, F.struct(F.array("late_90").alias("values")).alias("nested")))
    kind = lambda c: F.when(c.isin("NaN", "Infinity", "-Infinity"), c).when(c.try_cast("double").isNotNull(), "finite")
    return out.select("row_id", *[kind(F.col(c)).alias(c) for c in _DOUBLES], kind(F.get("nested.values", F.lit(0))).alias("nested"))


@query("predictions_flat", f"""WITH {COUNTERFACTUALS},
firsts AS (SELECT prediction_id, cf_index, arg_min(chg, j) AS chg FROM
            (SELECT c.*, list_position(['age', 'NumberOfDependents', 'MonthlyIncome', 'DebtRatio', 'NumberOfOpenCreditLinesAndLoans', 'NumberRealEstateLoansOrLines',
              'RevolvingUtilizationOfUnsecuredLines', 'NumberOfTime30-59DaysPastDueNotWorse', 'NumberOfTime60-89DaysPastDueNotWorse', 'NumberOfTimes90DaysLate'], feature) AS j
             FROM changes c) GROUP BY 1, 2),
f AS (SELECT prediction_id, count(*) AS k, avg(chg) AS m FROM firsts GROUP BY 1)
SELECT prediction_id, a.prediction, coalesce(k, 0) AS cf_count, greatest(coalesce(k, 0), 1) AS cf_count_raw,
       {", ".join(f"round(coalesce({c}, 0), 6) AS input_{c}, round(phi_{c}, 6) AS shap_{c}" for c in FEATURE_COLUMNS)}, round(baseline, 6) AS shap_baseline, round(coalesce(m, 0), 6) AS cf_avg_percentile_change
FROM attributed a LEFT JOIN f USING (prediction_id)""")
def predictions_flat(spark, sf_dir):
    path = _new_path(spark)
    tables.write_predictions(explained(spark, sf_dir), path, {"source": "applicants"})
    flat = readers.flat_predictions(readers.predictions(spark, f"{path}/predictions", lines=True))
    return flat.select("prediction_id", "prediction", F.col("cf_count").cast("long").alias("cf_count"),
                       F.col("cf_count_raw").cast("long").alias("cf_count_raw"),
                       *[F.round(f"`{kind}_{TECHNICAL[c]}`", 6).alias(f"{kind}_{c}") for c in FEATURE_COLUMNS for kind in ("input", "shap")],
                       *rounded(["shap_baseline", "cf_avg_percentile_change"]))


@query("explanation_keys", """SELECT DISTINCT user_id FROM events""")
def explanation_keys(spark, sf_dir):
    table = tables.KeyedTable(spark, _new_path(spark), EVENT, "user_id").create()
    table.put(_events(spark, sf_dir), order="event_id")
    return table.keys()


