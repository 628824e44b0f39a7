"""Compiled ensembles against the fitted models and brute force; leaf-wise boosting; ranks without a shuffle."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from decision_lens.functions.ranks import percentile_map, percentile_table
from decision_lens.operators import boosting, counterfactual as cfs, ensembles, training
from decision_lens.operators.boosting import LeafwiseClassifier
from decision_lens.operators.scoring import score_linear
from decision_lens.plans import adapters as A, trees
from decision_lens.schemas import FEATURE_COLUMNS, MUTABLE_COLUMNS
from decision_lens.session import stage
from oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return stage(A.model_inputs(spark, SF).select("row_id", *FEATURE_COLUMNS, "label"))


def matrix(rows):
    return np.array([[r[c] for c in FEATURE_COLUMNS] for r in rows.orderBy("row_id").collect()], dtype=float)


def families():
    return [GBTClassifier(labelCol="label", maxIter=4, maxDepth=3, seed=1), RandomForestClassifier(labelCol="label", numTrees=8, maxDepth=4, seed=1),
            DecisionTreeClassifier(labelCol="label", maxDepth=4), LeafwiseClassifier(labelCol="label", maxIter=3, numLeaves=6)]


@pytest.mark.parametrize("kind", range(4))
def test_compiled_models_score_like_transform(spark, rows, kind):
    model = training.fit_pipeline(rows, FEATURE_COLUMNS, families()[kind])
    e = ensembles.ensemble_of(model)
    want = training.score_model(rows, model, ["row_id"]).withColumnsRenamed({"probability": "p", "prediction": "c"})
    got = ensembles.score(rows, e).join(want, "row_id")
    worst, wrong = got.agg(F.max(F.abs(F.col("probability") - F.col("p"))), F.sum((F.col("prediction") != F.col("c")).cast("int"))).first()
    assert worst < 1e-12 and wrong == 0
    x = matrix(rows)
    every = (1 << len(FEATURE_COLUMNS)) - 1
    low, high, value = e.boxes
    assert np.allclose((e.agreeing(e.cells(x)) == every) @ value + e.bias, e.margins(x), atol=1e-12)
    phi = ensembles.Explainer(e, x[:30])
    assert np.abs(phi.values(x[:60]).sum(axis=1) + phi.base - e.margins(x[:60])).max() < 1e-9


def test_attribution_equals_all_subsets():
    r = np.random.default_rng(5)
    names = [f"f{i}" for i in range(6)]

    def grown(depth):
        if depth == 0 or r.random() < 0.1:
            return float(r.normal())
        return (names[r.integers(6)], float(r.normal()), grown(depth - 1), grown(depth - 1))

    e = ensembles.Ensemble.from_trees(names, [grown(4) for _ in range(5)], 0.3)
    x, z = r.normal(size=(5, 6)), r.normal(size=(9, 6))
    got = ensembles.Explainer(e, z).values(x)
    for k, row in enumerate(x):
        worth = {}
        for n in range(7):
            for s in itertools.combinations(range(6), n):
                mixed = z.copy()
                mixed[:, list(s)] = row[list(s)]
                worth[s] = e.margins(mixed).mean()
        for f in range(6):
            others = [i for i in range(6) if i != f]
            want = sum(factorial(len(s)) * factorial(5 - len(s)) / factorial(6) * (worth[tuple(sorted((*s, f)))] - worth[s])
                       for n in range(6) for s in itertools.combinations(others, n))
            assert abs(got[k, f] - want) < 1e-9


def test_search_finds_the_nearest_flip(spark, rows):
    """Against all one- and two-feature moves to cell targets, scored one by one."""
    e = trees.BOOSTED
    scored = ensembles.score(rows.limit(12), e)
    train = stage(rows)
    found = {r["row_id"]: r for r in cfs.with_ensemble_counterfactuals(stage(scored), train, e).collect()}
    levels = ensembles.cell_levels(train, e, MUTABLE_COLUMNS)
    for r in found.values():
        x = np.array([r[c] for c in FEATURE_COLUMNS], dtype=float)
        own = e.cells(x[None, :])[0]
        moves = [(FEATURE_COLUMNS.index(v["feature"]), v["low"] if v["cell"] > own[FEATURE_COLUMNS.index(v["feature"])] else v["high"])
                 for v in levels if v["cell"] != own[FEATURE_COLUMNS.index(v["feature"])]]
        flips = 0
        for chosen in [(m,) for m in moves] + [p for p in itertools.combinations(moves, 2) if p[0][0] != p[1][0]]:
            y = x.copy()
            for f, t in chosen:
                y[f] = t
            flips += (e.margins(y[None, :])[0] > e.cut) != (r["prediction"] == 1)
        assert len(r["counterfactuals"]) == min(3, flips)
        distances = [c["distance"] for c in r["counterfactuals"]]
        assert distances == sorted(distances)
        for c in r["counterfactuals"]:
            y = x.copy()
            for m in c["changes"]:
                y[[FEATURE_COLUMNS.index(k) for k in FEATURE_COLUMNS if trees.TECHNICAL[k] == m["feature"]][0]] = m["to"]
            assert (e.margins(y[None, :])[0] > e.cut) != (r["prediction"] == 1)


def test_fitted_model_agrees_on_its_counterfactuals(spark):
    out = entry_module.queries()["fitted_counterfactuals"](spark, "/root/testdata/sf0.001")
    n, flipped, worst = out.agg(F.count(F.lit(1)), F.sum(F.col("flipped").cast("int")), F.max(F.abs(F.col("new_probability") - F.col("model_probability")))).first()
    assert n > 0 and flipped == n and worst < 1e-12


@pytest.mark.parametrize("name", ["ensemble_counterfactuals", "ensemble_attribution", "ensemble_suggestions"])
def test_ensemble_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), name, sf)[0] is None


def test_linear_pipelines_become_frozen(spark, rows):
    model = training.fit_pipeline(rows, FEATURE_COLUMNS, LogisticRegression(labelCol="label", maxIter=5))
    both = score_linear(rows, ensembles.frozen_of(model)).select("row_id", F.col("probability").alias("p")).join(training.score_model(rows, model, ["row_id"]), "row_id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("probability")))).first()[0] < 1e-12
    with pytest.raises(ValueError):
        ensembles.ensemble_of(model)


def test_background_is_bounded(spark, rows):
    assert ensembles.background(rows, FEATURE_COLUMNS, 25).shape == (25, 11)
    with pytest.raises(ValueError):
        ensembles.background(rows, FEATURE_COLUMNS, None)
    with pytest.raises(ValueError):
        ensembles.Explainer(trees.BOOSTED, np.zeros((0, 11)))


def test_split_gains_equal_brute_force():
    r = np.random.default_rng(2)
    x, y, w = r.integers(0, 9, (200, 3)).astype(np.uint8), r.integers(0, 2, 200).astype(float), r.uniform(0.5, 2, 200)
    m = r.normal(size=200)
    sums = boosting.sums_of(None, [0], x, y, w, m, 9)[0]
    gain, feature, cut = boosting.best_split(sums, 1e-3, 1.0)
    p = 1 / (1 + np.exp(-m))
    g, h = w * (p - y), w * p * (1 - p)

    def worth(at):
        return g[at].sum() ** 2 / (h[at].sum() + 1.0)

    every = {(f, b): worth(x[:, f] <= b) + worth(x[:, f] > b) - worth(np.ones(200, dtype=bool)) for f in range(3) for b in range(8)}
    assert abs(gain - max(every.values())) < 1e-9 and abs(every[feature, cut] - gain) < 1e-9


def test_trees_grow_best_leaf_first(spark, rows):
    """A tree equals one grown leaf by leaf on the driver; its leaves keep the bound."""
    model = training.fit_pipeline(rows, FEATURE_COLUMNS, LeafwiseClassifier(labelCol="label", maxIter=1, numLeaves=5, stepSize=1.0))
    e = ensembles.ensemble_of(model)
    x, y = matrix(rows), np.array([r["label"] for r in rows.orderBy("row_id").collect()], dtype=float)
    import json
    said = json.loads(model.stages[1].getOrDefault("trees"))
    bins = boosting.as_bins(x, said["edges"])
    m = np.full(len(x), said["bias"])
    p = 1 / (1 + np.exp(-m))
    leaves = {0: np.ones(len(x), dtype=bool)}
    split = lambda at: boosting.best_split(boosting.sums_of(None, [0], bins[at], y[at], np.ones(at.sum()), m[at], 64)[0], 1e-3, 1.0)
    while len(leaves) < 5:
        best = max(leaves, key=lambda k: split(leaves[k])[0])
        at = leaves.pop(best)
        _, f, b = split(at)
        for low in (True, False):
            leaves[max([*leaves, best, 0]) + 1] = at & ((bins[:, f] <= b) == low)
    want = m.copy()
    for at in leaves.values():
        want[at] += -(p - y)[at].sum() / ((p * (1 - p))[at].sum() + 1.0)
    assert len(e.boxes[2]) == 5 and np.allclose(e.margins(x), want, atol=1e-9)


def test_leafwise_weights_and_persistence(spark, rows, tmp_path):
    weighted = training.balanced_weights(rows)
    model = training.fit_pipeline(weighted, FEATURE_COLUMNS, LeafwiseClassifier(labelCol="label", weightCol="weight", maxIter=2, numLeaves=4))
    plain = training.fit_pipeline(rows, FEATURE_COLUMNS, LeafwiseClassifier(labelCol="label", maxIter=2, numLeaves=4))
    p = [training.score_model(rows, m, ["row_id"]).agg(F.avg("probability")).first()[0] for m in (model, plain)]
    assert p[0] > p[1] + 0.1  # the rare class counts more
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    both = training.score_model(rows, again, ["row_id"]).withColumnRenamed("probability", "p").join(training.score_model(rows, model, ["row_id"]), "row_id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("probability")))).first()[0] == 0.0
    with pytest.raises(ValueError):
        training.fit_pipeline(rows.limit(0), FEATURE_COLUMNS, LeafwiseClassifier(labelCol="label"))


def test_ranks_need_no_shuffle(spark, rows):
    table = stage(percentile_table(rows, MUTABLE_COLUMNS))
    ranked = percentile_map(rows, "row_id", MUTABLE_COLUMNS, table)
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    joined = percentile_map(rows, "row_id", MUTABLE_COLUMNS, table, broadcast_rows=0)
    key = lambda df: sorted((r["row_id"], *[r["percentiles"][c] for c in MUTABLE_COLUMNS]) for r in df.collect())
    assert key(ranked) == key(joined)


def test_one_count_a_feature_serves_all_leaves(monkeypatch):
    r = np.random.default_rng(8)
    bins, y, m = r.integers(0, 16, (500, 3)).astype(np.uint8), r.integers(0, 2, 500).astype(float), r.normal(size=500)
    tree = {"feature": [0, 1, -1, 2, -1, -1, -1], "bin": [7, 3, 0, 9, 0, 0, 0], "left": [1, 3, -1, 5, -1, -1, -1], "right": [2, 4, -1, 6, -1, -1, -1]}
    x, z, v = bins.T.astype(int)
    leaf = np.where(x > 7, 2, np.where(z > 3, 4, np.where(v <= 9, 5, 6)))
    assert np.array_equal(boosting.descended(tree, bins), leaf) and len(boosting.descended(tree, bins[:0])) == 0
    assert not boosting.descended({"feature": [-1], "bin": [0], "left": [-1], "right": [-1]}, bins).any()
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    out = boosting.sums_of(tree, [6, 2, 5], bins, y, np.ones(500), m, 16)
    assert len(calls) == 9
    p = 1 / (1 + np.exp(-m))
    for i, n in enumerate((6, 2, 5)):
        for f in range(3):
            for j, w in enumerate((p - y, p * (1 - p), np.ones(500))):
                assert np.array_equal(out[i, f, :, j], count(bins[leaf == n, f], w[leaf == n], minlength=16))
    assert boosting.sums_of(tree, [6, 2], bins[:0], y[:0], y[:0], m[:0], 16).shape == (2, 3, 16, 3)
