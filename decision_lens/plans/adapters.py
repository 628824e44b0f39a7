"""Domain frames derived from the given tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from decision_lens.operators.cleaning import fill_constant, late_medians, prepare
from decision_lens.operators.scoring import score_linear
from decision_lens.schemas import FEATURE_COLUMNS, LATE_COLUMNS, Frozen
from decision_lens.session import stage

FROZEN = Frozen(
    median_income=5400.0,
    center={"age": 50.0, "dependents": 2.0, "income": 4800.0, "debt_ratio": 0.4, "open_lines": 3.0,
            "real_estate": 2.0, "utilisation": 0.5, "late_30_59": 1.0, "late_60_89": 1.0,
            "late_90": 1.0, "imputed_income": 0.0},
    scale={"age": 30.0, "dependents": 2.0, "income": 5000.0, "debt_ratio": 0.6, "open_lines": 2.0,
           "real_estate": 2.0, "utilisation": 0.3, "late_30_59": 2.0, "late_60_89": 2.0,
           "late_90": 2.0, "imputed_income": 1.0},
    weights={"age": -0.35, "dependents": 0.1, "income": -0.7, "debt_ratio": 0.6, "open_lines": -0.15,
             "real_estate": 0.2, "utilisation": 1.1, "late_30_59": 0.9, "late_60_89": 0.8,
             "late_90": 1.4, "imputed_income": 0.3},
    intercept=-0.9,
)


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is inferred once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw applicants. Lines are summed per order, orders per customer, before any join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("price"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"),
        *[F.sum((F.col("l_returnflag") == f).cast("long")).alias(f"n_{f}") for f in "RAN"])
    is_open = F.col("o_orderstatus") == "O"
    history = (table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
               .groupBy("o_custkey").agg(
        F.sum(is_open.cast("long")).alias("n_open"),
        F.sum((F.col("o_orderpriority") == "1-URGENT").cast("long")).alias("n_urgent"),
        F.sum(F.when(is_open, F.col("o_totalprice")).otherwise(0.0)).alias("open_total"),
        F.sum("price").alias("price"), F.sum("rebate").alias("rebate"),
        *[F.sum(f"n_{f}").alias(f"n_{f}") for f in "RAN"]))
    c = F.col("c_custkey")
    earned = F.when((c % 40).isin(3, 7) | (F.col("c_acctbal") <= 0), 0.0).otherwise(F.col("c_acctbal"))

    def late(flag: str, limit: int) -> F.Column:
        return (F.when(c % 50 == 0, 96.0).when(c % 50 == 1, 98.0)
                .otherwise(F.coalesce(F.col(f"n_{flag}") % limit, F.lit(0)).cast("double")))

    monthly = F.coalesce(F.col("open_total"), F.lit(0.0)) / 360.0
    rows = table(spark, sf_dir, "customer").join(history, c == F.col("o_custkey"), "left").select(
        c.alias("row_id"),
        F.when(c % 97 != 0, (21 + c % 60).cast("double")).alias("age"),
        F.when(F.col("c_nationkey") % 7 != 0, (F.col("c_nationkey") % 5).cast("double")).alias("dependents"),
        F.when(c % 40 == 3, "N/A").when(c % 40 == 7, "NA").otherwise(earned.cast("string")).alias("income"),
        F.when(c % 211 == 5, float("inf")).otherwise(
            F.round(F.when(earned > 0, monthly / earned).otherwise(monthly), 6)).alias("debt_ratio"),
        F.coalesce("n_open", F.lit(0)).cast("double").alias("open_lines"),
        F.coalesce("n_urgent", F.lit(0)).cast("double").alias("real_estate"),
        F.round(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("rebate"), F.col("price")), F.lit(0.0))
                           * 40 - 1.5), 6).alias("utilisation"),
        late("R", 4).alias("late_30_59"), late("A", 3).alias("late_60_89"), late("N", 4).alias("late_90"),
        F.when((F.coalesce("n_R", F.lit(0)) % 4 + F.coalesce("n_N", F.lit(0)) % 4 >= 5) | (c % 17 == 0), 1)
        .otherwise(0).alias("label"))
    return rows


APPLICANTS = """
lines AS (SELECT l_orderkey, sum(l_extendedprice) AS price, sum(l_extendedprice * l_discount) AS rebate,
                 count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) FILTER (l_returnflag = 'A') AS n_a,
                 count(*) FILTER (l_returnflag = 'N') AS n_n
          FROM lineitem GROUP BY l_orderkey),
history AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_open,
                   count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent,
                   sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS open_total,
                   sum(price) AS price, sum(rebate) AS rebate,
                   sum(n_r)::BIGINT AS n_r, sum(n_a)::BIGINT AS n_a, sum(n_n)::BIGINT AS n_n
            FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY o_custkey),
earning AS (SELECT *, CASE WHEN c_custkey % 40 IN (3, 7) OR c_acctbal <= 0 THEN 0 ELSE c_acctbal END AS earned,
                   coalesce(open_total, 0) / 360.0::DOUBLE AS monthly
            FROM customer LEFT JOIN history ON o_custkey = c_custkey),
applicants AS MATERIALIZED (
  SELECT c_custkey AS row_id,
         CASE WHEN c_custkey % 97 <> 0 THEN (21 + c_custkey % 60)::DOUBLE END AS age,
         CASE WHEN c_nationkey % 7 <> 0 THEN (c_nationkey % 5)::DOUBLE END AS dependents,
         CASE c_custkey % 40 WHEN 3 THEN 'N/A' WHEN 7 THEN 'NA' ELSE earned::VARCHAR END AS income,
         CASE WHEN c_custkey % 211 = 5 THEN 'Infinity'::DOUBLE
              ELSE round(CASE WHEN earned > 0 THEN monthly / earned ELSE monthly END, 6) END AS debt_ratio,
         coalesce(n_open, 0)::DOUBLE AS open_lines, coalesce(n_urgent, 0)::DOUBLE AS real_estate,
         round(greatest(0.0::DOUBLE, coalesce(rebate / nullif(price, 0), 0) * 40 - 1.5::DOUBLE), 6) AS utilisation,
         CASE c_custkey % 50 WHEN 0 THEN 96 WHEN 1 THEN 98 ELSE coalesce(n_r % 4, 0) END::DOUBLE AS late_30_59,
         CASE c_custkey % 50 WHEN 0 THEN 96 WHEN 1 THEN 98 ELSE coalesce(n_a % 3, 0) END::DOUBLE AS late_60_89,
         CASE c_custkey % 50 WHEN 0 THEN 96 WHEN 1 THEN 98 ELSE coalesce(n_n % 4, 0) END::DOUBLE AS late_90,
         CASE WHEN coalesce(n_r, 0) % 4 + coalesce(n_n, 0) % 4 >= 5 OR c_custkey % 17 = 0 THEN 1 ELSE 0 END AS label
  FROM earning)"""


def clean_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stage(applicants(spark, sf_dir))
    return prepare(raw, FROZEN, late_fill=late_medians(raw)).select("row_id", *FEATURE_COLUMNS, "label")


def _late(c: str) -> str:
    return (f"CASE WHEN {c} IN (96, 98) THEN (SELECT median({c}) FROM applicants WHERE {c} NOT IN (96, 98)) "
            f"ELSE {c} END AS {c}")


def _clip(c: str) -> str:
    lo, hi = FROZEN.caps[c]
    return (f"CASE WHEN isfinite({c}) THEN least(greatest({c}, {lo!r}::DOUBLE), {hi!r}::DOUBLE) END AS {c}")


CLEAN = APPLICANTS + f""",
known AS (SELECT * EXCLUDE (income),
                 nullif(TRY_CAST(CASE WHEN income NOT IN ('NA', 'N/A', 'n/a') THEN income END AS DOUBLE), 0) AS income
          FROM applicants),
filled AS (SELECT * REPLACE (coalesce(income, {FROZEN.median_income!r}::DOUBLE) AS income,
                             {", ".join(_late(c) for c in LATE_COLUMNS)}),
                  CASE WHEN income IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS imputed_income
           FROM known),
ratio AS (SELECT * REPLACE (CASE WHEN imputed_income = 1 THEN debt_ratio / income ELSE debt_ratio END AS debt_ratio)
          FROM filled),
clean AS MATERIALIZED (SELECT * REPLACE ({_clip("utilisation")}, {_clip("debt_ratio")}, {_clip("income")}) FROM ratio)"""


def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean applicants with missing values filled by 0, as the model sees them."""
    return fill_constant(clean_applicants(spark, sf_dir))


def scored_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_linear(clean_applicants(spark, sf_dir), FROZEN)


Z = " + ".join(f"{FROZEN.weights[c]!r}::DOUBLE * ((coalesce({c}, 0) - {FROZEN.center[c]!r}::DOUBLE) / {FROZEN.scale[c]!r}::DOUBLE)"
               for c in FEATURE_COLUMNS)
SCORED = CLEAN + f""",
logits AS (SELECT *, {FROZEN.intercept!r}::DOUBLE + {Z} AS logit FROM clean),
probs AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS probability FROM logits),
scored AS MATERIALIZED (SELECT *, 'app-' || row_id AS prediction_id, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction
           FROM probs)"""
BAND = """CASE WHEN probability < 0 THEN NULL WHEN probability <= 0.3 THEN 'CLEAR_ACCEPT' WHEN probability <= 0.45 THEN 'LEAN_ACCEPT'
     WHEN probability <= 0.55 THEN 'BOUNDARY' WHEN probability <= 0.7 THEN 'LEAN_REJECT'
     WHEN probability <= 1 THEN 'CLEAR_REJECT' END"""
AGE_BAND = """CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 36 THEN '18-35' WHEN age < 51 THEN '36-50'
     WHEN age < 66 THEN '51-65' ELSE '65+' END"""
