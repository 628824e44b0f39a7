import pytest
from pyspark.sql import functions as F

from decision_lens.operators import cleaning as C, profiling as P
from decision_lens.schemas import Frozen


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_income_text_zero_and_flag(spark):
    df = spark.createDataFrame([(1, "NA"), (2, "N/A"), (3, "n/a"), (4, "0"), (5, "100"), (6, "300"), (7, None)], "i int, income string").coalesce(1)
    assert rows(C.impute_income(df), "income", "imputed_income") == [
        (200.0, 1.0)] * 4 + [(100.0, 0.0), (300.0, 0.0), (200.0, 1.0)]
    assert rows(C.impute_income(df, median=5.0), "income")[0] == (5.0,)
    assert C.impute_income(df, zero_is_missing=False).filter("income = 0").count() == 1


def test_all_missing_income_uses_fixed_fallback(spark):
    df = spark.createDataFrame([(None,), (0.0,)], "income double")
    assert {r[0] for r in rows(C.impute_income(df), "income")} == {3000.0}


def test_sentinels_use_the_frames_own_median(spark):
    df = spark.createDataFrame([(96.0,), (98.0,), (1.0,), (2.0,), (2.0,), (None,)], "late_90 double").coalesce(1)
    assert rows(C.repair_sentinels(df), "late_90") == [(2.0,), (2.0,), (1.0,), (2.0,), (2.0,), (None,)]
    assert rows(C.repair_sentinels(df, frozen_medians={"late_90": 0.0}), "late_90")[0] == (0.0,)
    alone = spark.createDataFrame([(96.0,)], "late_90 double")
    assert rows(C.fill_constant(C.repair_sentinels(alone)), "late_90") == [(0.0,)]


def test_debt_ratio_only_where_income_was_filled(spark):
    df = spark.createDataFrame([(100.0, 50.0, 1.0), (0.5, 50.0, 0.0), (float("inf"), 50.0, 0.0), (5.0, 0.0, 1.0)],
                               "debt_ratio double, income double, imputed_income double").coalesce(1)
    assert rows(C.recompute_debt_ratio(df), "debt_ratio") == [(2.0,), (0.5,), (None,), (None,)]


def test_caps_logs_and_back(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (3.0,), (None,), (float("nan"),)], "income double").coalesce(1)
    assert rows(C.trim_extremes(df, {"income": (0, 2), "absent": (0, 1)}), "income") == [(0.0,), (0.0,), (2.0,), (None,), (None,)]
    logged = C.add_logs(C.finite_only(df), ["income", "absent"], drop=True)
    assert logged.columns == ["income_log"]
    assert [v is None for (v,) in rows(logged, "income_log")] == [True, True, False, True, True]
    assert rows(C.unlog(logged, ["income"]), "income")[2][0] == pytest.approx(3.0)


def test_scaling_with_zero_range(spark):
    df = spark.createDataFrame([(1.0, 0.0)] * 9 + [(5.0, 1.0)], "a double, b double")
    center, spread = C.fit_scaling(df, ["a", "b"])
    assert spread == {"a": 1.0, "b": 1.0} and center == {"a": 1.0, "b": 0.0}


def test_prepare_flags_once_and_keeps_target_on_request(spark):
    df = spark.createDataFrame([(1, 0, 5.0, "N/A", 10.0, 0.5, 96.0, 0.0, 0.0)],
                               "`Unnamed: 0` int, SeriousDlqin2yrs int, age double, income string, debt_ratio double, "
                               "utilisation double, late_30_59 double, late_60_89 double, late_90 double")
    out = C.prepare(df, Frozen(median_income=10.0), late_fill={"late_30_59": 1.0, "late_60_89": 0.0, "late_90": 0.0})
    r = out.first()
    assert "SeriousDlqin2yrs" not in out.columns and (r["imputed_income"], r["debt_ratio"], r["late_30_59"]) == (1.0, 1.0, 1.0)
    assert "SeriousDlqin2yrs" in C.prepare(df, Frozen(), keep_target=True).columns
    assert C.align(out, ["age", "missing"]).first().asDict() == {"age": 5.0, "missing": None}
    assert C.numeric_columns(df)[0] == "Unnamed: 0"
    flags = spark.createDataFrame([(True,)], "b boolean")
    assert C.bools_to_int(flags).first()[0] == 1


def test_correlation_of_constant_is_null_and_pairs_are_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in P.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "a")] == 1.0
    assert got[("a", "c")] is None and got[("c", "c")] is None


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    got = {r["bin"]: r["n"] for r in P.histogram(df, ["x"], 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    constant = spark.createDataFrame([(4.0,)] * 3, "x double")
    assert [(r["bin"], r["n"], r["density"]) for r in P.histogram(constant, ["x"]).collect()] == [(0, 3, None)]


def test_box_and_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "x double")
    r = P.box_numbers(df, ["x"]).first()
    assert (r["whisker_low"], r["whisker_high"], r["outliers"]) == (1.0, 5.0, 1)
    assert P.distinct_counts(df, ["x"]).first()["n_distinct"] == 6
    assert P.value_shares(df.withColumn("y", F.lit(1)), "y").first()["share"] == 1.0
