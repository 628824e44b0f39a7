"""Running totals over ordered distinct values, spread over value ranges.

Rows are first summed per distinct value. Cut points from a sketch split the value range
of every group into bins; totals of the bins are accumulated in a small table, and the
running total inside a bin adds to the bin's start. No task orders a whole column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from decision_lens.session import freeze, join_small

ROWS_PER_BIN = 1_000_000
MAX_BINS = 1024
_PROBS = ", ".join(f"{i / MAX_BINS!r}D" for i in range(1, MAX_BINS))


def running_totals(df: DataFrame, value: str, weights: dict[str, Column],
                   by: tuple[str, ...] = (), rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Rows (by..., value, w..., w_before..., w_total...) per distinct non-null value.

    ``w_before`` is the sum over smaller values, ``w_total`` the sum of the group.
    Group columns must not be null.
    """
    keys = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    df = df.filter(F.col(value).isNotNull())
    names = list(weights)
    counts = df.groupBy(*keys, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])

    sketch = freeze(df.groupBy(*keys).agg(
        F.approx_count_distinct(value).alias("_d"),
        F.expr(f"percentile_approx(`{value}`, array({_PROBS}), 10000)").alias("_q")))
    step = F.greatest(F.lit(1), (F.col("_d") / rows_per_bin + 1).cast("int"))
    wide = F.greatest(F.lit(1), (F.lit(MAX_BINS) / step).cast("int"))
    cuts = sketch[0].select(*keys, F.array_distinct(
        F.filter("_q", lambda x, i: (i + 1) % wide == 0)).alias("_cuts"))
    binned = (join_small(counts, (cuts, sketch[1]), keys)
              .withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts"))

    bins = binned.groupBy(*keys, "_bin").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = bins.select(
        *keys, "_bin",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_start") for n in names],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in names])
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = (binned.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_{n}_in")
                                for n in names])
           .join(starts, [*keys, "_bin"]))
    return out.select(
        *by, value, *names,
        *[(F.col(f"_{n}_start") + F.col(f"_{n}_in")).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names])


BROADCAST_ROWS = 500_000


def percentile_table(train: DataFrame, columns: list[str], extra: DataFrame | None = None,
                     rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """(feature, value, n, percentile) for every distinct training value and every extra value.

    Percentile rank = (values below + values up to + 1 if any equal) * 50 / n. ``extra`` holds
    (feature, value) rows to be ranked without counting as training values.
    """
    from decision_lens.functions.quantiles import melt
    long = melt(train, columns).withColumn("_w", F.lit(1))
    if extra is not None:
        long = long.unionByName(extra.select("feature", F.col("value").cast("double"), F.lit(0).alias("_w")))
    totals = running_totals(long, "value", {"n": F.col("_w")}, by=("feature",), rows_per_bin=rows_per_bin)
    below, upto = F.col("n_before"), F.col("n_before") + F.col("n")
    return totals.select("feature", "value", "n", "n_total",
                         ((below + upto + F.when(below < upto, 1).otherwise(0)) * 50.0
                          / F.col("n_total")).alias("percentile"))


def lookup_percentiles(long: DataFrame, table: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add the percentile to (.., feature, value) rows; ``table`` should be staged.

    A table of checked size is broadcast. Otherwise values that hold more than a thousandth of
    a column (at most a thousand per feature) are broadcast and only the rest is shuffled, so
    a value shared by a third of the rows never lands in one task.
    """
    slim = table.select("feature", "value", "percentile")
    if table.count() <= broadcast_rows:
        return long.join(F.broadcast(slim), ["feature", "value"], "left")
    hot = table.filter(F.col("n") * 1000 > F.col("n_total")).select("feature", "value", "percentile")
    common = long.join(F.broadcast(hot), ["feature", "value"])
    rare = long.join(F.broadcast(hot.select("feature", "value")), ["feature", "value"], "left_anti")
    return common.unionByName(rare.join(slim, ["feature", "value"], "left"))


def rank_column(table: DataFrame, columns: list[str], values: Column) -> Column:
    """Percentile ranks of an array of the columns' values, by binary search in the sorted training values; null stays null.

    ``table`` must be of checked size: its values and running counts travel to the tasks. Values that it lacks are ranked too.
    """
    rows = table.select("feature", "value", "n").orderBy("feature", "value").toArrow()
    feature, value, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("feature", "value", "n"))
    sorted_values = [value[feature == c] for c in columns]
    upto = [np.concatenate([[0], np.cumsum(n[feature == c])]) for c in columns]

    def rank(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        wide = np.array([[np.nan if v is None else v for v in row] for row in x], dtype=float)
        out = np.full(wide.shape, np.nan)
        for i, (known, total) in enumerate(zip(sorted_values, upto)):
            below, equal = (total[np.searchsorted(known, wide[:, i], side=side)] for side in ("left", "right"))
            if total[-1]:
                out[:, i] = (below + equal + (below < equal)) * 50.0 / total[-1]
        out[np.isnan(wide)] = np.nan
        return pd.Series(list(out), index=x.index, dtype=object)

    ranks = F.pandas_udf(rank, T.ArrayType(T.DoubleType()))(values)
    return F.transform(ranks, lambda r: F.when(~F.isnan(r), r))


def percentile_map(df: DataFrame, key: str, columns: list[str], table: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a map column ``percentiles`` feature -> percentile rank of the row's value.

    A table of checked size is searched inside each row, without a shuffle; a larger one is joined by value.
    """
    if table.count() <= broadcast_rows:
        found = rank_column(table, columns, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
        return df.withColumn("_ranks", found).withColumn("percentiles", F.map_from_arrays(F.array(*map(F.lit, columns)), F.col("_ranks"))).drop("_ranks")
    from decision_lens.functions.quantiles import melt
    ranked = lookup_percentiles(melt(df, columns, [key]), table, broadcast_rows)
    maps = ranked.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "percentile"))).alias("percentiles"))
    return df.join(maps, key, "left")
