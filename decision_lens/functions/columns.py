"""Column expressions shared by the operators; all stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from decision_lens.schemas import AGE_BANDS, AGE_UNKNOWN, PROBABILITY_BANDS


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once, however often later ones use them: projections are not merged across a generated row."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null although least/greatest skip nulls."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def logistic(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def logit(p: Column) -> Column:
    q = clip(p, 1e-12, 1 - 1e-12)
    return F.log(q / (1.0 - q))


def probability_band(p: Column) -> Column:
    """Right-closed bands; values outside [0, 1] give null."""
    band = F.when(p < 0, None)
    for upper, name in PROBABILITY_BANDS:
        band = band.when(p <= upper, name)
    return band


def age_band(age: Column) -> Column:
    band = F.when(age.isNull(), AGE_UNKNOWN)
    for upper, name in AGE_BANDS:
        band = band.otherwise(name) if upper is None else band.when(age < upper, name)
    return band


def risk_level(p: Column) -> Column:
    """Low below 0.3, high above 0.7; p is the probability of default."""
    return F.when(p < 0.3, "low").when(p <= 0.7, "medium").otherwise("high")


def outcome(prediction: Column) -> Column:
    return F.when(prediction == 1, "declined").when(prediction == 0, "approved").otherwise("unknown")


def seeded_hash(key: Column, seed: int | str) -> Column:
    """Pseudo-random but reproducible text key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
