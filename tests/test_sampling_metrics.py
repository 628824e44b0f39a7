import math

import pytest
from pyspark.sql import functions as F

from decision_lens.operators import evaluation as E, representativeness as R, sampling as S


@pytest.fixture(scope="module")
def population(spark):
    return spark.createDataFrame([(i, float(20 + i % 60) if i % 50 else None, (i * 37 % 1000) / 1000.0, int(i % 5 == 0),
                                   i % 4 if i % 9 else None) for i in range(1200)],
                                 "row_id long, age double, probability double, label int, cluster_id int").withColumn(
        "prediction", (F.col("probability") > 0.5).cast("int")).cache()


def test_split_keeps_label_shares(population):
    train, test = S.stratified_split(population, "row_id", "label")
    assert test.filter("label = 1").count() == 48 and test.count() == 240 and train.count() == 960
    assert train.join(test, "row_id", "left_semi").count() == 0


def test_undersample_ratio(population):
    counts = {r["label"]: r["count"] for r in S.undersample(population, "row_id", "label").groupBy("label").count().collect()}
    assert counts == {1: 240, 0: math.floor(240 / 0.3)}


def test_cluster_sample_sizes(population):
    for size in (1, 3, 50, 777):
        assert S.cluster_sample(population, "row_id", size).count() == size
    assert S.cluster_sample(population, "row_id", 5000).count() == 1200
    assert S.sample_or_all(population, "row_id", None, True).count() == 1200


def test_category_sample_tops_up_and_short_strata(population):
    sample = S.category_sample(population, "row_id", total=100)
    assert sample.count() == 100 and sample.select("row_id").distinct().count() == 100
    scarce = population.filter("probability < 0.3")
    assert S.category_sample(scarce, "row_id", total=60).count() == 60


def test_age_first_quotas(spark):
    counts = spark.createDataFrame([("a", "BOUNDARY", 2), ("a", "CLEAR_REJECT", 50), ("b", "CLEAR_ACCEPT", 10), ("b", None, 4)], "age string, band string, n long")
    picked, fill = S.age_first_quotas(counts, 20, S.SAMPLING_TARGETS)
    # goals: a 15 of 66 rows' share, b the rest
    assert {tuple(r) for r in picked.collect()} == {("a", "BOUNDARY", 2), ("a", "CLEAR_REJECT", 3), ("b", "CLEAR_ACCEPT", 1)}
    assert {r["age"]: r["fill"] for r in fill.collect()} == {"a": 10, "b": 4}


def test_age_first_total(population):
    sample = S.age_first_sample(population, "row_id")
    assert sample.count() == 100 and sample.select("row_id").distinct().count() == 100


def brute_ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


@pytest.mark.parametrize("rows_per_bin", [20, 1_000_000])
def test_ks_statistic(population, rows_per_bin):
    sample = population.filter("row_id % 7 = 0 and probability > 0.2")
    got = {r["feature"]: r for r in R.ks_two_sample(population, sample, ["probability"], rows_per_bin).collect()}
    a = [r[0] for r in population.select("probability").collect()]
    b = [r[0] for r in sample.select("probability").collect()]
    assert got["probability"]["statistic"] == pytest.approx(brute_ks(a, b))
    same = R.ks_two_sample(population, population, ["age"]).first()
    assert same["statistic"] == 0.0 and same["p_value"] == 1.0 and same["similar"]


def test_representation_counts_empty_side(population):
    rows = R.representation(population, population.filter("cluster_id = 1"), F.col("cluster_id"), "c").collect()
    assert {r["c"]: r["n_sample"] for r in rows}["0"] == 0 and sum(r["population_pct"] for r in rows) == pytest.approx(100)


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_single_class(spark):
    rows = [(i % 3 == 0, (i * 7 % 11) / 11) for i in range(200)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "label int, score double")
    assert E.auc(df, "label", "score").first()[0] == pytest.approx(brute_auc(rows))
    assert E.auc(df.filter("label = 1"), "label", "score").first()[0] is None
    points = E.roc_points(df, "label", "score").orderBy("fpr", "tpr").collect()
    assert (points[0]["fpr"], points[-1]["tpr"]) == (0.0, 1.0)


def test_rates_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    r = E.with_rates(E.confusion(df, "label", F.lit(0))).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["accuracy"]) == (2, 0.0, 0.0, 0.0, 1.0)
