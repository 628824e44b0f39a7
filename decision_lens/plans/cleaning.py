"""Queries over cleaning steps and the flagship summary."""

from pyspark.sql import functions as F

from decision_lens.functions.columns import probability_band
from decision_lens.operators import cleaning as ops
from decision_lens.plans import adapters as A
from decision_lens.plans.registry import query
from decision_lens.schemas import FEATURE_COLUMNS, LATE_COLUMNS
from decision_lens.session import stage


def rounded(columns, digits=6):
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def sql_rounded(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("band_summary", f"""WITH {A.SCORED}
SELECT {A.BAND} AS band, count(*) AS n, round(avg(probability), 6) AS mean_probability,
       round(avg(prediction), 6) AS declined_share, round(avg(label), 6) AS default_share
FROM scored GROUP BY 1""")
def band_summary(spark, sf_dir):
    scored = A.scored_applicants(spark, sf_dir)
    return scored.groupBy(probability_band(F.col("probability")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability"),
        F.round(F.avg("prediction"), 6).alias("declined_share"),
        F.round(F.avg("label"), 6).alias("default_share"))


@query("clean_applicants", f"""WITH {A.CLEAN}
SELECT row_id, {sql_rounded(FEATURE_COLUMNS)}, label FROM clean""")
def clean_applicants(spark, sf_dir):
    return A.clean_applicants(spark, sf_dir).select("row_id", *rounded(FEATURE_COLUMNS), "label")


@query("scored_applicants", f"""WITH {A.SCORED}
SELECT prediction_id, prediction, round(probability, 6) AS probability, round(logit, 6) AS logit FROM scored""")
def scored_applicants(spark, sf_dir):
    return A.scored_applicants(spark, sf_dir).select(
        "prediction_id", "prediction", *rounded(["probability", "logit"]))


@query("sentinel_repair", f"""WITH {A.APPLICANTS}
SELECT row_id, {", ".join(A._late(c) for c in LATE_COLUMNS)} FROM applicants""")
def sentinel_repair(spark, sf_dir):
    raw = stage(A.applicants(spark, sf_dir).select("row_id", *LATE_COLUMNS))
    return ops.repair_sentinels(raw)


@query("own_median_income", f"""WITH {A.APPLICANTS},
known AS (SELECT row_id, nullif(TRY_CAST(CASE WHEN income NOT IN ('NA', 'N/A', 'n/a') THEN income END AS DOUBLE), 0) AS income
          FROM applicants)
SELECT row_id, round(coalesce(income, (SELECT median(income) FROM known), 3000), 6) AS income,
       CASE WHEN income IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS imputed_income FROM known""")
def own_median_income(spark, sf_dir):
    raw = stage(A.applicants(spark, sf_dir).select("row_id", "income"))
    return ops.impute_income(raw).select("row_id", *rounded(["income"]), "imputed_income")


@query("log_features", f"""WITH {A.CLEAN}
SELECT row_id, round(CASE WHEN income > 0 THEN ln(1 + income) END, 6) AS income_log,
       round(CASE WHEN utilisation > 0 THEN ln(1 + utilisation) END, 6) AS utilisation_log FROM clean""")
def log_features(spark, sf_dir):
    df = A.clean_applicants(spark, sf_dir).select("row_id", "income", "utilisation")
    logged = ops.add_logs(df, ["income", "utilisation", "absent"], drop=True)
    return logged.select("row_id", *rounded(["income_log", "utilisation_log"]))


@query("unlogged_features", f"""WITH {A.CLEAN}
SELECT row_id, round(CASE WHEN income > 0 THEN income END, 6) AS income,
       round(CASE WHEN utilisation > 0 THEN utilisation END, 6) AS utilisation FROM clean""")
def unlogged_features(spark, sf_dir):
    df = A.clean_applicants(spark, sf_dir).select("row_id", "income", "utilisation")
    back = ops.unlog(ops.add_logs(df, ["income", "utilisation"], drop=True), ["income", "utilisation"])
    return back.select("row_id", *rounded(["income", "utilisation"]))


_Q = "(SELECT quantile_cont(coalesce({c}, 0), {p}) FROM clean)"


@query("robust_scaled", f"""WITH {A.CLEAN}
SELECT row_id, """ + ", ".join(
    f"round((coalesce({c}, 0) - {_Q.format(c=c, p=0.5)}) / coalesce(nullif({_Q.format(c=c, p=0.75)} - "
    f"{_Q.format(c=c, p=0.25)}, 0), 1), 6) AS {c}" for c in FEATURE_COLUMNS) + " FROM clean")
def robust_scaled(spark, sf_dir):
    df = stage(A.model_inputs(spark, sf_dir))
    return ops.scale(df, *ops.fit_scaling(df, FEATURE_COLUMNS)).select("row_id", *rounded(FEATURE_COLUMNS))


@query("aligned_features", f"""WITH {A.APPLICANTS}
SELECT row_id, {", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in FEATURE_COLUMNS if c not in ("income", "imputed_income", "debt_ratio"))},
  (c_rich)::INTEGER::DOUBLE AS imputed_income, NULL::DOUBLE AS income, CASE WHEN isfinite(debt_ratio) THEN round(debt_ratio, 6) END AS debt_ratio,
  'age, c_number, debt_ratio, dependents, imputed_income, label, late_30_59, late_60_89, late_90, open_lines, real_estate, row_id, utilisation' AS numeric_columns
FROM (SELECT *, row_id % 3 = 0 AS c_rich FROM applicants)""")
def aligned_features(spark, sf_dir):
    """Configured columns dropped, booleans as numbers, numeric columns found, features in the model's order, absent ones null."""
    raw = A.applicants(spark, sf_dir).drop("income").withColumn("imputed_income", F.col("row_id") % 3 == 0).withColumn("Unnamed: 0", F.lit(1)).withColumn(
        "SeriousDlqin2yrs", F.col("label")).withColumn("c_number", F.lit(1.5).cast("decimal(4,1)"))
    df = ops.bools_to_int(ops.finite_only(raw.drop(*A.FROZEN.dropped_columns)))
    numeric = ", ".join(sorted(ops.numeric_columns(df)))
    return ops.align(df, keep=["row_id"]).select("row_id", *rounded([c for c in FEATURE_COLUMNS if c != "income"]), "income", F.lit(numeric).alias("numeric_columns"))
