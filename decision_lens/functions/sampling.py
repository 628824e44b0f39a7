"""Exact reproducible selection and numbering by hashed key.

Rows are ordered by a seeded hash. The first three hex digits put every stratum into
4096 buckets; only bucket counts are aggregated, and a row is ranked only against the
rows of its own bucket. A stratum that holds most of the table is therefore spread over
thousands of small groups, and a selection sorts nothing but the one bucket it cuts. If that
bucket itself is large, its rows are split by the next digits in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.functions.columns import seeded_hash
from decision_lens.session import freeze, join_small

DIGITS = 3
BUCKET_ROWS = 1_000_000


def _hashed(df: DataFrame, key: str, seed, digits: int) -> DataFrame:
    h = seeded_hash(F.col(key), seed)
    return df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))


def split_by_hash(df: DataFrame, key: str, quotas: dict | DataFrame, stratum: Column | None = None,
                  seed=42, digits: int = DIGITS, bucket_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(taken, rest): the first ``quotas[s]`` rows of each stratum s in hash order, and all others.

    Strata without a quota go to the rest. ``quotas`` is a small dict (strata are categories), or a
    frame (stratum, quota) where there may be many.
    """
    columns = df.columns
    stratum = F.lit("all") if stratum is None else F.coalesce(stratum.cast("string"), F.lit("null"))
    rows = _hashed(df.withColumn("_s", stratum), key, seed, digits)
    if isinstance(quotas, DataFrame):
        s, n = quotas.columns
        wanted = quotas.select(F.col(s).cast("string").alias("_s"), F.col(n).cast("long").alias("_n")).filter("_n > 0")
    elif any(n > 0 for n in quotas.values()):
        wanted = F.broadcast(df.sparkSession.createDataFrame([(str(s), int(n)) for s, n in quotas.items() if n > 0], "_s string, _n long"))
    else:
        return df.limit(0), df
    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(
        Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    cut = freeze(
        counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        .join(wanted, "_s")
        .filter(F.col("_before") < F.col("_n"))
        .groupBy("_s")
        .agg(F.max("_b").alias("_cut"), F.max(F.struct("_before", "_n", "_c")).alias("_last"))
        .select("_s", "_cut", (F.col("_last._n") - F.col("_last._before")).alias("_need"), F.col("_last._c").alias("_size")))
    placed = join_small(rows, (cut[0].drop("_size"), cut[1]), "_s", "left")
    below, above = placed.filter(F.col("_b") < F.col("_cut")).select(columns), placed.filter(F.col("_cut").isNull() | (F.col("_b") > F.col("_cut"))).select(columns)
    largest = cut[0].agg(F.max("_size")).first()[0] or 0
    if largest > (BUCKET_ROWS if bucket_rows is None else bucket_rows) and digits < 30:
        inside = placed.filter(F.col("_b") == F.col("_cut")).select(columns)
        taken, rest = split_by_hash(inside, key, cut[0].select("_s", "_need"), stratum, seed, digits + DIGITS, bucket_rows)
        return below.unionByName(taken), above.unionByName(rest)
    at_cut = placed.filter(F.col("_b") == F.col("_cut")).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)))
    taken = below.unionByName(at_cut.filter("_r <= _need").select(columns))
    rest = above.unionByName(at_cut.filter("_r > _need").select(columns))
    return taken, rest


def take_by_hash(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """Exactly n rows (or all) in hash order."""
    return split_by_hash(df, key, {"all": n}, seed=seed)[0]


def number_by_hash(df: DataFrame, key: str, by: tuple[str, ...] = (), seed=42,
                   name: str = "row_no", digits: int = DIGITS) -> DataFrame:
    """Dense row numbers 1..n per group in hash order, without one global sort."""
    columns = df.columns
    rows = _hashed(df, key, seed, digits)
    groups = list(by)
    counts = rows.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(
        Window.partitionBy(*groups, F.lit(0)).orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, -1))
    base = freeze(counts.select(*groups, "_b", F.coalesce(before, F.lit(0)).alias("_before")),
                  limit=200_000)
    inside = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", key))
    numbered = join_small(rows.withColumn("_r", inside), base, [*groups, "_b"])
    return numbered.select(*columns, (F.col("_before") + F.col("_r")).cast("long").alias(name))
