"""Shared primitives against brute force, with skew and forced multi-bin paths."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from decision_lens.functions.columns import age_band, clip, finite, probability_band, risk_level
from decision_lens.functions.quantiles import exact_quantiles
from decision_lens.functions.ranks import lookup_percentiles, percentile_table, running_totals
from decision_lens.functions.sampling import number_by_hash, split_by_hash, take_by_hash
from decision_lens.session import freeze, stage


def skewed(n=3000, seed=1):
    rnd = random.Random(seed)
    return [7.0 if rnd.random() < 0.35 else round(rnd.lognormvariate(0, 2), 3) for _ in range(n)]


def test_finite_and_clip_keep_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (5.0,), (-5.0,)], "x double")
    got = [tuple(r) for r in df.select(finite(F.col("x")), clip(finite(F.col("x")), 0, 2)).collect()]
    assert got == [(None, None)] * 4 + [(5.0, 2.0), (-5.0, 0.0)]


def test_probability_bands_are_right_closed(spark):
    p = [0.0, 0.3, 0.300001, 0.45, 0.55, 0.7, 1.0, 1.1, -0.1, None]
    df = spark.createDataFrame([(x,) for x in p], "p double").coalesce(1)
    got = [r[0] for r in df.select(probability_band(F.col("p"))).collect()]
    assert got == ["CLEAR_ACCEPT", "CLEAR_ACCEPT", "LEAN_ACCEPT", "LEAN_ACCEPT", "BOUNDARY", "LEAN_REJECT",
                   "CLEAR_REJECT", None, None, None]


def test_age_bands_and_risk(spark):
    df = spark.createDataFrame([(None,), (35.0,), (36.0,), (50.0,), (51.0,), (65.0,), (66.0,)], "a double").coalesce(1)
    assert [r[0] for r in df.select(age_band(F.col("a"))).collect()] == [
        "Unknown", "18-35", "36-50", "36-50", "51-65", "51-65", "65+"]
    df = spark.createDataFrame([(0.29,), (0.3,), (0.7,), (0.71,)], "p double").coalesce(1)
    assert [r[0] for r in df.select(risk_level(F.col("p"))).collect()] == ["low", "medium", "medium", "high"]


@pytest.mark.parametrize("kw", [{}, {"accuracy": 2, "margin": 0.0}, {"accuracy": 10, "margin": 0.01}])
def test_exact_quantiles_whatever_the_sketch_says(spark, kw):
    x = skewed()
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(x)] + [(None, 1), (float("nan"), 1)], "x double, g int")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["x"], probs, **kw).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(x, p), abs=1e-12)
    by = {(r["g"], r["prob"]): (r["quantile"], r["n"]) for r in exact_quantiles(df, ["x"], probs, by=("g",), **kw).collect()}
    for g in range(3):
        part = [v for i, v in enumerate(x) if i % 3 == g]
        assert by[(g, 0.75)] == (pytest.approx(np.quantile(part, 0.75), abs=1e-12), len(part))


@pytest.mark.parametrize("rows_per_bin", [10, 1_000_000])
def test_running_totals_across_bins(spark, rows_per_bin):
    x = skewed(1000)
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(x)], "x double, side int")
    out = running_totals(df, "x", {"a": (1 - F.col("side")).cast("long"), "b": F.col("side").cast("long")},
                         rows_per_bin=rows_per_bin).collect()
    assert len(out) == len(set(x))
    for r in out:
        assert r["a_before"] == sum(v < r["x"] for i, v in enumerate(x) if i % 2 == 0)
        assert r["b"] == sum(v == r["x"] for i, v in enumerate(x) if i % 2 == 1)
        assert r["b_total"] == 500


@pytest.mark.parametrize("limit", [500_000, 0])
def test_percentiles_of_seen_and_unseen_values(spark, limit):
    train, asked = [1.0, 2.0, 2.0, 3.0] * 300, [0.0, 1.0, 2.0, 2.5, 3.0, 9.0]
    df = spark.createDataFrame([(v,) for v in train], "f double")
    extra = spark.createDataFrame([("f", v) for v in asked], "feature string, value double")
    table = stage(percentile_table(df, ["f"], extra, rows_per_bin=2))
    got = {r["value"]: r["percentile"] for r in lookup_percentiles(extra, table, broadcast_rows=limit).collect()}
    n = len(train)
    for v in asked:
        below, upto = sum(t < v for t in train), sum(t <= v for t in train)
        assert got[v] == pytest.approx((below + upto + (below < upto)) * 50 / n)


def order(key):
    return hashlib.md5(f"42:{key}".encode()).hexdigest()


def test_split_by_hash_is_exact_under_skew(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(2000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    taken, rest = split_by_hash(df, "id", {"hot": 700, "cold": 10_000, "absent": 3}, F.col("s"))
    hot = sorted((i for i, s in rows if s == "hot"), key=order)
    want = set(hot[:700]) | {i for i, s in rows if s == "cold"}
    assert {r["id"] for r in taken.collect()} == want
    assert {r["id"] for r in rest.collect()} == {i for i, _ in rows} - want


def test_take_and_number_by_hash(spark):
    df = spark.range(500)
    ids = sorted(range(500), key=order)
    assert {r["id"] for r in take_by_hash(df, "id", 37).collect()} == set(ids[:37])
    assert take_by_hash(df, "id", 0).count() == 0 and take_by_hash(df, "id", 9999).count() == 500
    numbers = {r["id"]: r["row_no"] for r in number_by_hash(df, "id").collect()}
    assert numbers == {i: n for n, i in enumerate(ids, 1)}


def test_freeze_checks_the_size(spark):
    assert freeze(spark.range(5), limit=5)[1] is True
    frame, fits = freeze(spark.range(6), limit=5)
    assert fits is False and frame.count() == 6
