"""How well a sample stands for its population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.functions.columns import risk_level
from decision_lens.functions.ranks import running_totals
from decision_lens.schemas import AGE_BANDS

KS_TERMS = 100


def tagged(population: DataFrame, sample: DataFrame, *columns: Column) -> DataFrame:
    """Both sides in one frame: in_sample is 1 for sample rows, 0 for population rows."""
    return (population.select(*columns, F.lit(0).alias("in_sample"))
            .unionAll(sample.select(*columns, F.lit(1).alias("in_sample"))))


def ks_two_sample(population: DataFrame, sample: DataFrame, columns: list[str],
                  rows_per_bin: int = 1_000_000) -> DataFrame:
    """Largest gap between the two distribution functions, with the asymptotic p-value."""
    from decision_lens.functions.quantiles import melt
    long = melt(tagged(population, sample, *[F.col(c) for c in columns]), columns, ["in_sample"])
    totals = running_totals(
        long, "value", {"pop": (1 - F.col("in_sample")).cast("long"), "smp": F.col("in_sample").cast("long")},
        by=("feature",), rows_per_bin=rows_per_bin)
    gap = F.abs((F.col("pop_before") + F.col("pop")) / F.col("pop_total")
                - (F.col("smp_before") + F.col("smp")) / F.col("smp_total"))
    stat = totals.groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.max("pop_total").alias("n_population"), F.max("smp_total").alias("n_sample"))
    n, m = F.col("n_population").cast("double"), F.col("n_sample").cast("double")
    reach = F.col("statistic") * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * reach * reach))
    p = F.when(reach < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return stat.withColumn("p_value", p).withColumn("similar", F.col("p_value") > 0.05)


def representation(population: DataFrame, sample: DataFrame, group: Column, name: str) -> DataFrame:
    """Counts and shares of both sides per group, sampling rate and share difference."""
    both = tagged(population, sample, F.coalesce(group.cast("string"), F.lit("null")).alias(name))
    counts = both.groupBy(name).agg(
        F.sum(1 - F.col("in_sample")).alias("n_population"), F.sum("in_sample").alias("n_sample"))
    whole = Window.partitionBy(F.lit(0))  # over grouped counts only
    p = 100.0 * F.col("n_population") / F.sum("n_population").over(whole)
    s = 100.0 * F.try_divide(F.col("n_sample"), F.sum("n_sample").over(whole))
    return counts.select(name, "n_population", "n_sample", p.alias("population_pct"), s.alias("sample_pct"),
                         F.try_divide(100.0 * F.col("n_sample"), F.col("n_population")).alias("sampling_rate_pct"),
                         F.abs(p - s).alias("abs_difference"))


def risk_levels(population: DataFrame, sample: DataFrame) -> DataFrame:
    return representation(population, sample, risk_level(F.col("probability")), "risk_level")


def preservation(population: DataFrame, sample: DataFrame) -> DataFrame:
    """Mean prediction and mean probability of both sides with their differences."""
    both = tagged(population, sample, F.col("prediction"), F.col("probability"))
    pop, smp = F.col("in_sample") == 0, F.col("in_sample") == 1
    row = both.agg(
        F.sum((pop).cast("long")).alias("n_population"), F.sum((smp).cast("long")).alias("n_sample"),
        *[F.avg(F.when(side, F.col(c))).alias(f"{n}_{c}")
          for n, side in (("population", pop), ("sample", smp)) for c in ("prediction", "probability")])
    out = row.withColumn("sampling_ratio", F.try_divide(F.col("n_sample"), F.col("n_population")))
    for c in ("prediction", "probability"):
        diff = F.abs(F.col(f"population_{c}") - F.col(f"sample_{c}"))
        out = out.withColumn(f"{c}_abs_diff", diff).withColumn(
            f"{c}_rel_diff", F.try_divide(diff, F.col(f"population_{c}")))
    return out


def age_band_means(population: DataFrame, sample: DataFrame, band: Column) -> DataFrame:
    """Mean probability and prediction per age band that occurs, in fixed order with unknown ages last; a side without the band gives 0."""
    both = tagged(population, sample, band.alias("age_band"), F.col("prediction"), F.col("probability"))
    pop, smp = F.col("in_sample") == 0, F.col("in_sample") == 1
    means = both.groupBy("age_band").agg(
        *[F.avg(F.when(side, F.col(c))).alias(f"{n}_{c}")
          for n, side in (("population", pop), ("sample", smp)) for c in ("prediction", "probability")])
    order = population.sparkSession.createDataFrame(
        [(i, name) for i, name in enumerate([*(name for _, name in AGE_BANDS), "Unknown"])], "position int, age_band string")
    return means.join(F.broadcast(order), "age_band").fillna(0.0)


def stacked(*tables: DataFrame) -> DataFrame:
    """Tables one below the other; columns absent from one are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
