"""Queries over column profiles."""

from pyspark.sql import functions as F

from decision_lens.operators import cleaning, profiling as ops
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.registry import query
from decision_lens.schemas import FEATURE_COLUMNS
from decision_lens.session import stage

RAW_COLUMNS = ["income_value" if c == "income" else c for c in FEATURE_COLUMNS if c != "imputed_income"]
SHAPES = FEATURE_COLUMNS


def raw_numeric(spark, sf_dir):
    raw = A.applicants(spark, sf_dir)
    value = cleaning.income_value(F.col("income"), raw.schema["income"].dataType)
    return cleaning.finite_only(raw).withColumn("income_value", value)


RAW_NUMERIC = A.APPLICANTS + """,
raw AS (SELECT * REPLACE (CASE WHEN isfinite(debt_ratio) THEN debt_ratio END AS debt_ratio),
               nullif(TRY_CAST(CASE WHEN income NOT IN ('NA', 'N/A', 'n/a') THEN income END AS DOUBLE), 0) AS income_value
        FROM applicants)"""


def union_all(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("missing_share", f"WITH {RAW_NUMERIC} " + union_all(
    "SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_share FROM raw",
    RAW_COLUMNS))
def missing_share(spark, sf_dir):
    return ops.missing_share(raw_numeric(spark, sf_dir), RAW_COLUMNS).select(
        "feature", *rounded(["missing_share"]))


@query("column_overview", f"WITH {RAW_NUMERIC} " + union_all(
    "SELECT '{c}' AS feature, 'double' AS data_type, count({c}) AS non_null, count(*) AS n_rows FROM raw", RAW_COLUMNS))
def column_overview(spark, sf_dir):
    return ops.column_overview(raw_numeric(spark, sf_dir), RAW_COLUMNS)


_STATS = ("count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
          "round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, "
          "round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max")


def _stats(df, *keys):
    return df.select(*keys, "feature", "count", *rounded(["mean", "std"]), "min",
                     *rounded(["q25", "median", "q75"]), "max")


@query("feature_stats", f"WITH {A.CLEAN} " + union_all(
    "SELECT '{c}' AS feature, " + _STATS + " FROM clean", FEATURE_COLUMNS))
def feature_stats(spark, sf_dir):
    return _stats(ops.describe(stage(A.clean_applicants(spark, sf_dir)), FEATURE_COLUMNS))


@query("conditional_debt_stats", f"WITH {RAW_NUMERIC} SELECT income_value IS NULL AS income_missing, 'debt_ratio' AS feature, "
       + _STATS.format(c="debt_ratio") + " FROM raw GROUP BY 1")
def conditional_debt_stats(spark, sf_dir):
    df = stage(raw_numeric(spark, sf_dir).select(F.col("income_value").isNull().alias("income_missing"), "debt_ratio"))
    return _stats(ops.describe(df, ["debt_ratio"], by=("income_missing",)), "income_missing")


@query("quantile_caps", f"WITH {RAW_NUMERIC} " + union_all(
    "SELECT '{c}' AS feature, round(quantile_cont({c}, 0.99), 6) AS cap FROM raw",
    ["utilisation", "debt_ratio", "income_value"]))
def quantile_caps(spark, sf_dir):
    df = stage(raw_numeric(spark, sf_dir).select("utilisation", "debt_ratio", "income_value"))
    return ops.upper_caps(df, df.columns).select("feature", *rounded(["cap"]))


@query("column_maxima", f"WITH {RAW_NUMERIC} " + union_all(
    "SELECT '{c}' AS feature, max({c}) AS maximum FROM raw", RAW_COLUMNS))
def column_maxima(spark, sf_dir):
    return ops.column_maxima(raw_numeric(spark, sf_dir), RAW_COLUMNS)


@query("class_balance", f"""WITH {A.APPLICANTS}
SELECT count(*) AS n, round(avg(label), 6) AS positive_share, round(1 - avg(label), 6) AS negative_share,
       round(avg(label) / nullif(1 - avg(label), 0), 6) AS positive_to_negative FROM applicants""")
def class_balance(spark, sf_dir):
    return ops.class_balance(A.applicants(spark, sf_dir), "label").select(
        "n", *rounded(["positive_share", "negative_share", "positive_to_negative"]))


@query("value_shares", f"""WITH {A.APPLICANTS}
SELECT dependents AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM applicants WHERE dependents IS NOT NULL GROUP BY 1""")
def value_shares(spark, sf_dir):
    return ops.value_shares(A.applicants(spark, sf_dir), "dependents").select("value", "n", *rounded(["share"]))


@query("distinct_counts", f"WITH {A.CLEAN} " + union_all(
    "SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM clean", FEATURE_COLUMNS))
def distinct_counts(spark, sf_dir):
    return ops.distinct_counts(A.clean_applicants(spark, sf_dir), FEATURE_COLUMNS)


_CORR = FEATURE_COLUMNS


@query("corr_long", f"WITH {A.CLEAN} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM clean"
    for a in _CORR for b in _CORR))
def corr_long(spark, sf_dir):
    return ops.correlations(A.clean_applicants(spark, sf_dir), _CORR).select(
        "feature_a", "feature_b", *rounded(["correlation"]))


@query("histogram", f"WITH {A.CLEAN}, " + "long AS (" + union_all(
    "SELECT '{c}' AS feature, {c} AS value FROM clean WHERE {c} IS NOT NULL", SHAPES) + """),
ends AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS total FROM long GROUP BY 1),
counted AS (SELECT feature, lo, hi, total,
                   least(floor((value - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n
            FROM long JOIN ends USING (feature) GROUP BY ALL)
SELECT feature, bin, round(lo + bin * ((hi - lo) / 30), 6) AS left_edge, n,
       round(n / (total * ((hi - lo) / 30)), 6) AS density FROM counted""")
def histogram(spark, sf_dir):
    df = stage(A.clean_applicants(spark, sf_dir).select(*SHAPES))
    return ops.histogram(df, SHAPES, 30).select("feature", "bin", *rounded(["left_edge"]), "n", *rounded(["density"]))


@query("box_numbers", f"WITH {A.CLEAN}, " + "long AS (" + union_all(
    "SELECT '{c}' AS feature, {c} AS value FROM clean WHERE {c} IS NOT NULL", SHAPES) + """),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75
      FROM long GROUP BY 1),
m AS (SELECT *, value BETWEEN q25 - 1.5::DOUBLE * (q75 - q25) AND q75 + 1.5::DOUBLE * (q75 - q25) AS inside FROM long JOIN q USING (feature))
SELECT feature, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75,
       min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
       count(*) FILTER (NOT inside) AS outliers FROM m GROUP BY feature, q25, median, q75""")
def box_numbers(spark, sf_dir):
    df = stage(A.clean_applicants(spark, sf_dir).select(*SHAPES))
    return ops.box_numbers(df, SHAPES).select(
        "feature", *rounded(["q25", "median", "q75"]), "whisker_low", "whisker_high", "outliers")
