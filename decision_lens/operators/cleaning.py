"""Cleaning steps over applicant frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from decision_lens.functions.columns import clip, finite
from decision_lens.functions.quantiles import medians, quantile_dict
from decision_lens.schemas import (FEATURE_COLUMNS, LATE_COLUMNS, LATE_SENTINELS,
                                   MISSING_INCOME_TEXT, Frozen)

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def _floating(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float")]


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c in _floating(df)})


def trim_extremes(df: DataFrame, caps: dict) -> DataFrame:
    df = finite_only(df)
    return df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in caps.items()
                           if c in df.columns})


def late_medians(df: DataFrame, columns: list[str] | None = None) -> dict:
    """Median of the ordinary values of each late-payment column of this frame."""
    columns = columns or [c for c in LATE_COLUMNS if c in df.columns]
    ordinary = df.select([F.when(~F.col(c).isin(*LATE_SENTINELS), F.col(c)).alias(c)
                          for c in columns])
    return medians(ordinary, columns)


def repair_sentinels(df: DataFrame, columns: list[str] | None = None,
                     frozen_medians: dict | None = None) -> DataFrame:
    """96 and 98 become the median of the frame, or a frozen median when one is given."""
    columns = columns or [c for c in LATE_COLUMNS if c in df.columns]
    fill = frozen_medians if frozen_medians is not None else late_medians(df, columns)
    return df.withColumns({
        c: F.when(F.col(c).isin(*LATE_SENTINELS), F.lit(fill[c]).cast("double"))
        .otherwise(F.col(c).cast("double")) for c in columns})


def add_logs(df: DataFrame, columns: list[str], drop: bool = False) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    df = df.withColumns({f"{c}_log": F.when(F.col(c) > 0, F.log1p(c)) for c in columns})
    return df.drop(*columns) if drop else df


def income_value(c: Column, data_type: T.DataType, zero_is_missing: bool = True) -> Column:
    """Number behind an income column that may hold text for missing."""
    if isinstance(data_type, T.StringType):
        c = F.when(~c.isin(*MISSING_INCOME_TEXT), c).try_cast("double")
    c = finite(c.cast("double"))
    return F.when(c != 0, c) if zero_is_missing else c


def impute_income(df: DataFrame, median: float | None = None, column: str = "income",
                  flag: bool = True, zero_is_missing: bool = True) -> DataFrame:
    """Fill missing income by a given or the frame's own median; the flag is set before filling."""
    known = df.withColumn(column, income_value(F.col(column), df.schema[column].dataType,
                                               zero_is_missing))
    if median is None:
        median = medians(known, [column])[column]
    median = 3000.0 if median is None else float(median)
    if flag:
        known = known.withColumn("imputed_income", F.col(column).isNull().cast("double"))
    return known.withColumn(column, F.coalesce(F.col(column), F.lit(median)))


def recompute_debt_ratio(df: DataFrame, debt: str = "debt_ratio", income: str = "income") -> DataFrame:
    """Where income was filled in the ratio is still an absolute debt: divide it."""
    if "imputed_income" in df.columns:
        df = df.withColumn(debt, F.when(F.col("imputed_income") == 1.0,
                                        F.try_divide(F.col(debt), F.col(income)))
                           .otherwise(F.col(debt)))
    return finite_only(df)


def prepare(df: DataFrame, frozen: Frozen, late_fill: dict | None = None,
            keep_target: bool = False) -> DataFrame:
    """The scoring chain: drop, repair sentinels, fill income, debt ratio, caps, logs."""
    drop = [c for c in frozen.dropped_columns if not (keep_target and c == "SeriousDlqin2yrs")]
    df = repair_sentinels(df.drop(*drop), frozen_medians=late_fill)
    df = impute_income(df, median=frozen.median_income)
    df = trim_extremes(recompute_debt_ratio(df), frozen.caps)
    return add_logs(df, list(frozen.log_columns), drop=True)


def bools_to_int(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"})


def align(df: DataFrame, features: list[str] = FEATURE_COLUMNS, keep: list[str] = ()) -> DataFrame:
    """Feature columns in model order; absent ones become null."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) if c in df.columns
                              else F.lit(None).cast("double").alias(c) for c in features])


def fill_constant(df: DataFrame, columns: list[str] = FEATURE_COLUMNS, value: float = 0.0) -> DataFrame:
    return df.fillna(value, [c for c in columns if c in df.columns])


def fit_scaling(df: DataFrame, columns: list[str]) -> tuple[dict, dict]:
    """(center, scale): median and interquartile range; a zero range scales by 1."""
    q = quantile_dict(df, columns, [0.25, 0.5, 0.75])
    return ({c: q[c][0.5] for c in columns},
            {c: (q[c][0.75] - q[c][0.25]) or 1.0 for c in columns})


def scale(df: DataFrame, center: dict, spread: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - center[c]) / spread[c] for c in center})


def unlog(df: DataFrame, columns: list[str]) -> DataFrame:
    """Restore logged columns; a negative log value has no original."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(f"{c}_log") >= 0, F.expm1(f"{c}_log"))).drop(f"{c}_log")
    return df


def input_map(columns: list[str], names: dict | None = None) -> Column:
    """Clean map feature -> value with NaN as null."""
    names = names or {}
    pairs = [x for c in columns for x in (F.lit(names.get(c, c)), finite(F.col(c).cast("double")))]
    return F.create_map(*pairs)
