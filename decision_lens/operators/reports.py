"""Report tables per generator (K1-K13). Pivots have a column for every generator of a given order
and, after those, for every other one in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.functions.quantiles import exact_quantiles
from decision_lens.operators.worklist import fixed_point
from decision_lens.schemas import CHECKLIST_ITEMS, FIRST_ACTION_ITEM, PAIR_CLASSES
from decision_lens.session import freeze, join_small


def generators(df: DataFrame, order: list[str]) -> list[str]:
    """The given order, then the names that it lacks; a pivot's columns, so few by nature."""
    found = [r[0] for r in df.filter(F.col("llm_name").isNotNull()).select("llm_name").distinct().collect()]
    return [*order, *sorted(set(found) - set(order))]


def metric_table(long: DataFrame, order: list[str]) -> DataFrame:
    """metric x generator means; null where a generator has no value."""
    return long.groupBy("metric").pivot("llm_name", generators(long, order)).agg(F.avg("value"))


def relative_flip_rate(df: DataFrame, baseline: Column, by: str = "llm_name") -> DataFrame:
    """Share of suggestions that flip, relative to ``baseline``, an aggregate: the rate of counterfactuals at position 1."""
    rate = F.avg(F.col("cf_flipped").cast("double"))
    return df.groupBy(by).agg(rate.alias("flip_rate"), baseline.alias("_base")).withColumn(
        "relative_flip_rate", F.try_divide(F.col("flip_rate"), F.col("_base"))).drop("_base")


def suggestion_totals(df: DataFrame, by: str = "llm_name") -> DataFrame:
    """Evaluated, skipped, flipped, success rate and mean change, per generator and overall (null)."""
    flipped = F.col("cf_flipped")
    return df.rollup(by).agg(
        F.count("cf_flipped").alias("evaluated"), F.sum(F.col("cf_skipped").cast("long")).alias("skipped"),
        F.coalesce(F.sum(flipped.cast("long")), F.lit(0)).alias("flipped"),
        F.avg(flipped.cast("double")).alias("success_rate"), F.avg("cf_probability_change").alias("mean_change"))


def by_generator(df: DataFrame, value: Column, by: str = "llm_name") -> DataFrame:
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).cast("double")).alias("mean")) for c in columns])
    return df.agg(cells.alias("_c")).select(F.inline("_c"))


def score_means(df: DataFrame) -> DataFrame:
    return column_means(df, [c for c in df.columns if c.endswith("_score")])


def checklist_table(df: DataFrame, order: list[str]) -> DataFrame:
    """Item x generator means as text, overall scores first; 'N/A' where an item never applied."""
    overall = F.array(*[F.struct(F.lit(i).alias("position"), F.lit("Overall").alias("item"), F.lit(name).alias("description"),
                                 F.lit("Overall Score").alias("category"), F.col(f"checklist.{c}").alias("value"))
                        for i, (name, c) in enumerate((("Overall CEMAT Score", "overall_score"),
                                                       ("Overall Understandability", "understandability_score"),
                                                       ("Overall Actionability", "actionability_score")), -2)])
    items = []
    for n, text in CHECKLIST_ITEMS:
        part = "understandability" if n < FIRST_ACTION_ITEM else "actionability"
        value = F.col(f"{part}_items")[f"item_{n}"].try_cast("double")
        items.append(F.struct(F.lit(n).alias("position"), F.lit(f"Item {n}").alias("item"), F.lit(text).alias("description"),
                              F.lit(part.capitalize()).alias("category"), value.alias("value")))
    long = df.select("llm_name", F.inline(F.concat(overall, F.array(*items))))
    order = generators(df, order)
    table = long.groupBy("position", "item", "description", "category").pivot("llm_name", order).agg(F.avg("value"))
    return table.select("position", "item", "description", "category", *[
        F.coalesce(fixed_point(F.col(f"`{g}`"), 3), F.lit("N/A")).alias(g) for g in order])


def mention_counts(df: DataFrame, mentions: Column, by: str = "llm_name") -> DataFrame:
    return df.select(by, F.explode(mentions).alias("feature")).groupBy(by, "feature").agg(F.count(F.lit(1)).alias("n"))


def mention_pivot(df: DataFrame, mentions: Column, order: list[str]) -> DataFrame:
    """feature x generator: share of that generator's texts that mention the feature, in percent."""
    totals = freeze(df.groupBy("llm_name").agg(F.count(F.lit(1)).alias("texts")))
    counts = join_small(mention_counts(df, mentions), totals, "llm_name")
    share = counts.withColumn("share", F.round(100.0 * F.col("n") / F.col("texts"), 1))
    order = generators(df, order)
    return share.groupBy("feature").pivot("llm_name", order).agg(F.max("share")).fillna(0.0, order)


def many_mentions(df: DataFrame, mentions: str, k: int = 3) -> DataFrame:
    """First k declined texts per generator that mention more than one immutable feature."""
    w = Window.partitionBy("llm_name").orderBy("explanation_id")
    rows = df.filter((F.col("prediction") == 1) & (F.size(mentions) > 1))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def similarity_table(stats: DataFrame, order: list[str]) -> DataFrame:
    """outcome x class rows with generator columns, from the finest grouping; 'N/A' without pairs."""
    fine = stats.filter("grouping = 'by_llm_outcome'")
    position = F.array_position(F.array(*[F.lit(c) for c in PAIR_CLASSES]), F.col("pair_class"))
    order = generators(fine, order)
    table = fine.groupBy("outcome", "pair_class").pivot("llm_name", order).agg(
        F.max(F.when(F.col("count") > 0, fixed_point(F.col("mean"), 3))))
    return table.withColumn("position", position.cast("int")).select(
        "outcome", "pair_class", "position", *[F.coalesce(F.col(f"`{g}`"), F.lit("N/A")).alias(g) for g in order])


def time_table(df: DataFrame, value: str = "processing_time", by: str = "llm_name") -> DataFrame:
    """count, mean, sample std, min, max, median, total seconds and hours per generator."""
    median = freeze(exact_quantiles(df, [value], [0.5], by=(by,)).select(by, F.col("quantile").alias("median")))
    rows = df.groupBy(by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                              F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total_seconds"))
    return join_small(rows, median, by, "left").withColumn("total_hours", F.col("total_seconds") / 3600)


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows sorted by a given order of categories; unlisted ones come last."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)
