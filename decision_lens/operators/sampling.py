"""Splits and stratified samples (E1-E11). Quotas are worked out from grouped counts on the
driver (strata are a handful of categories); rows are only ever filtered on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.functions.columns import age_band, probability_band, seeded_hash
from decision_lens.functions.sampling import split_by_hash, take_by_hash
from decision_lens.schemas import BAND_PRIORITY, SAMPLING_TARGETS
from decision_lens.session import SMALL_ROWS, freeze, stage


def strata_counts(df: DataFrame, *columns: Column) -> dict:
    """Rows per stratum as a dict; strata are categories, so their number is checked."""
    named = [F.coalesce(c.cast("string"), F.lit("null")).alias(f"s{i}") for i, c in enumerate(columns)]
    rows = df.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError("strata must be categories, found more than %d" % SMALL_ROWS)
    return {(r[0] if len(columns) == 1 else tuple(r[:-1])): r["n"] for r in rows}


def fraction_sample(df: DataFrame, key: str, fraction: float, seed=42) -> DataFrame:
    return take_by_hash(df, key, round(df.count() * fraction), seed)


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2,
                     seed=42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the label shares of the whole."""
    counts = strata_counts(df, F.col(label))
    quotas = {s: n - round(n * test_share) for s, n in counts.items()}
    return split_by_hash(df, key, quotas, F.col(label), seed)


def undersample(df: DataFrame, key: str, label: str, ratio: float = 0.3, seed=42) -> DataFrame:
    """All minority rows; majority rows cut so that minority / majority = ratio."""
    counts = strata_counts(df, F.col(label))
    minority = min(counts, key=lambda s: (counts[s], s))
    limit = math.floor(counts[minority] / ratio)
    quotas = {s: n if s == minority else min(n, limit) for s, n in counts.items()}
    return split_by_hash(df, key, quotas, F.col(label), seed)[0]


def cluster_sample(df: DataFrame, key: str, size: int, cluster: str = "cluster_id", seed=42) -> DataFrame:
    """At least one row per cluster, proportional quotas, then trimmed or topped up to ``size``."""
    stratum = F.coalesce(F.col(cluster), F.lit(0))
    total = df.count()
    if size >= total:
        return df
    share = F.greatest(F.lit(1), F.floor(F.lit(float(size)) * F.col("n") / F.lit(float(total))))
    quotas = stage(df.groupBy(F.coalesce(stratum.cast("string"), F.lit("null")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
                   .select("s", F.least(F.col("n"), share).cast("long").alias("quota")))
    taken, rest = split_by_hash(df, key, quotas, stratum, seed)
    count = quotas.agg(F.sum("quota")).first()[0]
    if count > size:
        return take_by_hash(taken, key, size, seed)
    if count < size:
        return taken.unionByName(take_by_hash(rest, key, size - count, seed))
    return taken


def sample_or_all(df: DataFrame, key: str, size: int | None, has_clusters: bool, seed=42) -> DataFrame:
    """Cluster-stratified when clusters are known, else random, else everything."""
    if size is None:
        return df
    return cluster_sample(df, key, size, seed=seed) if has_clusters else take_by_hash(df, key, size, seed)


def category_quotas(available: dict, targets: dict) -> dict:
    return {c: min(n, available.get(c, 0)) for c, n in targets.items()}


def category_sample(df: DataFrame, key: str, total: int = 100, targets: dict | None = None,
                    band: Column | None = None, seed=42) -> DataFrame:
    """Targets per probability band (or all available), topped up to ``total`` from the rest."""
    band = probability_band(F.col("probability")) if band is None else band
    quotas = category_quotas(strata_counts(df, band), targets or SAMPLING_TARGETS)
    taken, rest = split_by_hash(df, key, quotas, band, seed)
    missing = total - sum(quotas.values())
    return taken.unionByName(take_by_hash(rest, key, missing, seed)) if missing > 0 else taken


def age_first_quotas(counts: DataFrame, total: int, targets: dict) -> tuple[DataFrame, DataFrame]:
    """((age, band, quota), (age, fill)) from counts (age, band, n) of at most a few dozen cells.

    An age band's goal is its share of ``total``, rounded down but at least 1; the smallest band gets what the others leave. In it
    a cell wishes for its band's share of the goal (at least 1, at most what it holds). Wishes are met in the order of
    BAND_PRIORITY as far as the goal reaches, which a running sum of wishes tells; what is left over may come from any cell.
    """
    ages = counts.groupBy("age").agg(F.sum("n").alias("size"))
    by_size, everyone = Window.orderBy(F.desc("size"), "age"), Window.partitionBy()
    share = F.greatest(F.lit(1), F.floor(total * (F.col("size") / F.sum("size").over(everyone))))
    ages = ages.withColumn("share", share).withColumn("earlier", F.coalesce(F.sum("share").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.row_number().over(by_size) == F.count(F.lit(1)).over(everyone)
    ages = ages.select("age", "size", F.when(last, F.lit(total) - F.col("earlier")).otherwise(F.col("share")).alias("goal"))
    weight = F.create_map(*[F.lit(x) for band, t in targets.items() for x in (band, t / sum(targets.values()))])
    place = F.array_position(F.array(*map(F.lit, BAND_PRIORITY)), F.col("band"))
    cells = counts.filter(F.col("band").isin(*targets) & (place > 0)).join(ages, "age").withColumn("place", place)
    wish = F.least(F.col("n"), F.greatest(F.lit(1), F.floor(F.col("goal") * F.element_at(weight, F.col("band")))))
    before = F.coalesce(F.sum("wish").over(Window.partitionBy("age").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("wish", wish).withColumn("quota", F.greatest(F.lit(0), F.least(F.col("wish"), F.col("goal") - before)))
    met = cells.groupBy("age").agg(F.sum("quota").alias("met"))
    over = F.least(F.col("goal"), F.col("size")) - F.coalesce("met", F.lit(0))
    return (cells.filter("quota > 0").select("age", "band", F.col("quota").cast("long").alias("quota")),
            ages.join(met, "age", "left").select("age", F.greatest(F.lit(0), over).cast("long").alias("fill")))


def age_first_sample(df: DataFrame, key: str, total: int = 100, targets: dict | None = None,
                     seed=42) -> DataFrame:
    """Age bands keep their share; inside each, probability bands are met in priority order."""
    age, band = age_band(F.col("age")), probability_band(F.col("probability"))
    counts = freeze(df.groupBy(age.alias("age"), band.alias("band")).agg(F.count(F.lit(1)).alias("n")))[0]
    quotas, fill = age_first_quotas(counts, total, targets or SAMPLING_TARGETS)
    pair = F.concat_ws("|", age, F.coalesce(band, F.lit("null")))
    taken, rest = split_by_hash(df, key, quotas.select(F.concat_ws("|", "age", "band").alias("pair"), "quota"), pair, seed)
    return taken.unionByName(split_by_hash(rest, key, fill, age, seed)[0])


def shuffled(df: DataFrame, key: str, seed=42) -> DataFrame:
    """Reproducible random order (a range-partitioned sort on the hash)."""
    return df.orderBy(seeded_hash(F.col(key), seed), key)
