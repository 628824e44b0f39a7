"""Column profiles (D1-D11). Every figure comes from partial aggregates or exact quantiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.functions.quantiles import exact_quantiles, melt, quantile_dict
from decision_lens.session import freeze, join_small


def _one_row_per_column(df: DataFrame, columns: list[str], **figures) -> DataFrame:
    """One pass over the wide frame; figures are functions column name -> aggregate."""
    structs = [F.struct(F.lit(c).alias("feature"), *[f(c).alias(n) for n, f in figures.items()])
               for c in columns]
    return df.agg(F.array(*structs).alias("_s")).select(F.inline("_s"))


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    return _one_row_per_column(df, columns, missing_share=lambda c: F.avg(F.col(c).isNull().cast("double")))


def column_overview(df: DataFrame, columns: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    return _one_row_per_column(df, columns, data_type=lambda c: F.lit(types[c]),
                               non_null=lambda c: F.count(F.col(c)),
                               n_rows=lambda c: F.count(F.lit(1)))


def describe(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (and group)."""
    keys = [*by, "feature"]
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by=by).groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
          for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    small = freeze(quartiles)
    figures = dict(count=F.count("value"), mean=F.avg("value"), std=F.stddev_samp("value"),
                   min=F.min("value"), max=F.max("value"))
    moments = melt(df, columns, list(by)).groupBy(*keys).agg(*[f.alias(n) for n, f in figures.items()])
    return join_small(moments, small, keys, "left").select(
        *keys, "count", "mean", "std", "min", "q25", "median", "q75", "max")


def upper_caps(df: DataFrame, columns: list[str], prob: float = 0.99) -> DataFrame:
    return exact_quantiles(df, columns, [prob]).select("feature", F.col("quantile").alias("cap"))


def column_maxima(df: DataFrame, columns: list[str]) -> DataFrame:
    return _one_row_per_column(df, columns, maximum=lambda c: F.max(c))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    y = F.avg(F.col(label).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), y.alias("positive_share"), (1 - y).alias("negative_share"),
                  F.try_divide(y, 1 - y).alias("positive_to_negative"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares per value; the total is one row that joins the counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"), F.lit(1).alias("_one"))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("value", "n", (F.col("n") / F.col("_total")).alias("share"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct values per column: a grouped count, not one big set."""
    long = melt(df, columns).filter(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.lit(1)).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Full Pearson matrix in long form, each pair over the rows where both are present."""
    pairs = list(combinations(columns, 2))
    def pearson(a: str, b: str) -> Column:
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        # corr() raises on a constant column in ANSI mode
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = df.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
                 *[F.when(F.stddev_pop(c) > 0, 1.0).alias(f"d{i}") for i, c in enumerate(columns)])

    def cell(a: str, b: str, c: Column) -> Column:
        return F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                        F.when(~F.isnan(c), c).alias("correlation"))

    cells = [cell(x, y, F.col(f"c{i}")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    cells += [cell(c, c, F.col(f"d{i}")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins, the last one closed on the right; density = n / (N * width)."""
    long = melt(df, columns).filter(F.col("value").isNotNull())
    ends = freeze(long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                              F.count(F.lit(1)).alias("total")))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"),
                   F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counted = (join_small(long, ends, "feature")
               .groupBy("feature", "lo", "hi", "total", place.cast("int").alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    return counted.select("feature", "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), "n",
                          F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def box_numbers(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Quartiles, whiskers (extremes within 1.5 IQR) and outliers per column (and group)."""
    keys = [*by, "feature"]
    quartiles = freeze(exact_quantiles(df, columns, [0.25, 0.5, 0.75], by=by).groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
          for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("value").between(F.col("q25") - reach, F.col("q75") + reach)
    long = melt(df, columns, list(by)).filter(F.col("value").isNotNull())
    return join_small(long, quartiles, keys).groupBy(*keys, "q25", "median", "q75").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"))


__all__ = ["missing_share", "column_overview", "describe", "upper_caps", "column_maxima", "class_balance",
           "value_shares", "distinct_counts", "correlations", "histogram", "box_numbers", "quantile_dict"]
