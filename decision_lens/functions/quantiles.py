"""Exact quantiles without gathering a column in one task.

A sketch brackets every wanted rank; one more pass counts the values below the bracket
and ranks only the distinct values inside it. Where a bracket would hold many rows, a further sketch of
what is inside narrows it, again and again, until it holds a bounded number. Nothing but sketches and brackets is
shuffled. A bracket that misses its rank is widened and tried again, so the answer is
exact whatever the sketch returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.session import freeze


def melt(df: DataFrame, columns: list[str], ids: list[str] | tuple = (),
         name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long over columns cast to double."""
    return df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value)


BRACKET_ROWS = 500_000
CUTS = 64


def _matching(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def _narrowed(long: DataFrame, small: DataFrame, fits: bool, keys: list[str], accuracy: int, bracket_rows: int) -> tuple[DataFrame, bool]:
    """Brackets (_k.., n, prob, lo, hi) cut down until none is expected to hold more than ``bracket_rows`` rows or a single value.

    Each pass counts what lies below a bracket and sketches what lies inside; the cuts next to the wanted rank, with one to spare on
    either side, are the new ends. A cut that is off is noticed by the exact count that follows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    cuts = [i / CUTS for i in range(CUTS + 1)]
    for _ in range(8):
        inside = long.join(F.broadcast(small) if fits else small, _matching(keys) & (F.col("value") <= F.col("hi")))
        here = F.when(F.col("value") >= F.col("lo"), F.col("value"))
        seen = inside.groupBy(*names, "n", "prob", "lo", "hi").agg(
            F.sum((F.col("value") < F.col("lo")).cast("long")).alias("below"), F.count(here).alias("rows"), F.percentile_approx(here, cuts, accuracy).alias("cuts"))
        seen, fits = freeze(seen)
        if seen.filter((F.col("rows") > bracket_rows) & (F.col("lo") < F.col("hi"))).isEmpty():
            return small, fits
        rank = F.col("prob") * (F.col("n") - 1) - F.col("below")
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rank / F.greatest(F.col("rows") - 1, F.lit(1))))
        low, high = (F.greatest(F.lit(0), F.floor(share * CUTS) - 1).cast("int"), F.least(F.lit(CUTS), F.ceil(share * CUTS) + 1).cast("int"))
        wide = (F.col("rows") > bracket_rows) & (F.col("lo") < F.col("hi"))
        small, fits = freeze(seen.select(*names, "n", "prob", F.when(wide, F.get("cuts", low)).otherwise(F.col("lo")).alias("lo"),
                                         F.when(wide, F.get("cuts", high)).otherwise(F.col("hi")).alias("hi")))
    return small, fits


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    by: tuple[str, ...] = (), accuracy: int = 10_000,
                    margin: float | None = None, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Rows (by..., feature, prob, n, quantile), linear interpolation, nulls and NaN skipped."""
    keys = [*by, "feature"]
    long = melt(df, columns, list(by))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    margin = 5.0 / accuracy if margin is None else margin
    while True:
        bounds = [b for p in probs for b in (max(0.0, p - margin), min(1.0, p + margin))]
        probes = F.array(*[
            F.struct(F.lit(float(p)).alias("prob"),
                     F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi"))
            for i, p in enumerate(probs)])
        sketch = long.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("value", bounds, accuracy).alias("_q"))
        brackets, fits = freeze(sketch.select(*keys, "n", F.inline(probes)))
        small = brackets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                "n", "prob", "lo", "hi")
        most = brackets.agg(F.max("n")).first()[0] or 0
        if most * min(1.0, 4 * margin) > bracket_rows:
            small, fits = _narrowed(long, small, fits, keys, accuracy, bracket_rows)
        probed = long.join(F.broadcast(small) if fits else small, _matching(keys) & (F.col("value") <= F.col("hi")))
        counted = probed.groupBy(*keys, "prob", "n",
                                 F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("v")
                                 ).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "prob").orderBy(F.asc_nulls_first("v"))
                               .rowsBetween(Window.unboundedPreceding, 0))
        position = F.col("prob") * (F.col("n") - 1)

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_upto") - F.col("c") <= rank) & (rank < F.col("_upto")),
                                F.col("v")))

        picked = (counted.withColumn("_upto", upto).groupBy(*keys, "prob", "n")
                  .agg(at(F.floor(position)).alias("v0"), at(F.ceil(position)).alias("v1"))
                  .select(*keys, "prob", "n",
                          (F.col("v0") + (F.col("v1") - F.col("v0")) * (position - F.floor(position)))
                          .alias("quantile")))
        result, _ = freeze(picked)
        if margin >= 1.0 or result.filter("quantile is null").isEmpty():
            return result
        margin = min(1.0, max(margin, 1e-4) * 10)


def quantile_dict(df: DataFrame, columns: list[str], probs: list[float], **kw) -> dict:
    """{column: {prob: value}} for use as literals; one row per column and prob."""
    out: dict = {c: {p: None for p in probs} for c in columns}
    for r in exact_quantiles(df, columns, probs, **kw).collect():
        out[r["feature"]][r["prob"]] = r["quantile"]
    return out


def medians(df: DataFrame, columns: list[str]) -> dict:
    return {c: q[0.5] for c, q in quantile_dict(df, columns, [0.5]).items()}
