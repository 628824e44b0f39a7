"""Queries over metrics, clusters, training, attribution and counterfactuals."""

import numpy as np
from pyspark.sql import functions as F

from decision_lens.operators import attribution as att, clustering, counterfactual as cfs, evaluation as ev
from decision_lens.operators import cleaning, training
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.registry import query
from decision_lens.schemas import COUNT_COLUMNS, FEATURE_COLUMNS, MUTABLE_COLUMNS, SHOWN, TECHNICAL
from decision_lens.session import stage

FZ = A.FROZEN


# --- classifier metrics ----------------------------------------------------------------
def labelled_scores(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = A.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(docs, "doc_id").withColumn("score", F.col("n_chars") / (F.col("n_chars") + 1500.0))


LABELLED = """labelled AS (SELECT quality AS label, n_chars / (n_chars + 1500.0::DOUBLE) AS score
              FROM labels JOIN documents USING (doc_id))"""


@query("confusion_metrics", f"""WITH {LABELLED},
c AS (SELECT count(*) FILTER (label = 1 AND score > 0.5) AS tp, count(*) FILTER (label <> 1 AND score > 0.5) AS fp,
             count(*) FILTER (label <> 1 AND NOT score > 0.5) AS tn, count(*) FILTER (label = 1 AND NOT score > 0.5) AS fn FROM labelled),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(0.7 * r + 0.3 * p, 6) AS recall_precision FROM r""")
def confusion_metrics(spark, sf_dir):
    cells = ev.confusion(labelled_scores(spark, sf_dir), "label", (F.col("score") > 0.5).cast("int"))
    return ev.with_rates(cells).select("tp", "fp", "tn", "fn", *rounded(
        ["accuracy", "precision", "recall", "f1", "recall_precision"]))


@query("auc_exact", f"""WITH {LABELLED},
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM labelled)
SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
       / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6) AS auc FROM r""")
def auc_exact(spark, sf_dir):
    return ev.auc(labelled_scores(spark, sf_dir), "label", "score").select(*rounded(["auc"]))


_CUTS = LABELLED + """,
v AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM labelled GROUP BY 1),
cuts AS (SELECT threshold, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS p,
                (sum(neg) OVER ())::BIGINT AS n FROM v WINDOW w AS (ORDER BY threshold DESC))"""


@query("roc_points", f"""WITH {_CUTS} SELECT round(threshold, 9) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM cuts
UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""")
def roc_points(spark, sf_dir):
    return ev.roc_points(labelled_scores(spark, sf_dir), "label", "score").select(
        *rounded(["threshold"], 9), *rounded(["fpr", "tpr"]))


@query("pr_points", f"""WITH {_CUTS} SELECT round(threshold, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall
FROM cuts UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""")
def pr_points(spark, sf_dir):
    return ev.pr_points(labelled_scores(spark, sf_dir), "label", "score").select(
        *rounded(["threshold"], 9), *rounded(["precision", "recall"]))


# --- clusters ---------------------------------------------------------------------------
CLUSTER_FEATURES = ["income", "debt_ratio", "utilisation", "late_90"]
CENTROIDS = [[0.5, 0.0, -0.5, 0.0], [-0.5, 1.0, 0.0, 0.0], [0.0, 0.0, 0.5, 1.0], [-0.5, 0.0, 0.5, -0.5]]


def scaled_inputs(spark, sf_dir):
    return cleaning.scale(A.model_inputs(spark, sf_dir), FZ.center, FZ.scale)


_DIST = [" + ".join(f"({c} - {v!r}::DOUBLE) * ({c} - {v!r}::DOUBLE)" for c, v in zip(CLUSTER_FEATURES, cen)) for cen in CENTROIDS]
CLUSTERED = A.CLEAN + """,
scaled AS (SELECT row_id, """ + ", ".join(
    f"(coalesce({c}, 0) - {FZ.center[c]!r}::DOUBLE) / {FZ.scale[c]!r}::DOUBLE AS {c}" for c in FEATURE_COLUMNS) + """ FROM clean),
dist AS (SELECT *, [""" + ", ".join(_DIST) + """] AS d FROM scaled),
clustered AS (SELECT *, list_position(d, list_min(d)) - 1 AS cluster_id, list_min(d) AS cluster_distance FROM dist)"""


@query("cluster_assign", f"WITH {CLUSTERED} SELECT row_id, cluster_id, round(cluster_distance, 6) AS cluster_distance FROM clustered")
def cluster_assign(spark, sf_dir):
    return clustering.assign(scaled_inputs(spark, sf_dir), CLUSTER_FEATURES, CENTROIDS).select(
        "row_id", "cluster_id", *rounded(["cluster_distance"]))


@query("cluster_sizes", f"""WITH {CLUSTERED} SELECT cluster_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM clustered GROUP BY 1""")
def cluster_sizes(spark, sf_dir):
    return clustering.sizes(clustering.assign(scaled_inputs(spark, sf_dir), CLUSTER_FEATURES, CENTROIDS)).select(
        "cluster_id", "n", *rounded(["share"]))


@query("cluster_profile", f"WITH {CLUSTERED} SELECT cluster_id, count(*) AS n, "
       + ", ".join(f"round(avg({c}), 6) AS {c}" for c in FEATURE_COLUMNS) + " FROM clustered GROUP BY 1")
def cluster_profile(spark, sf_dir):
    df = clustering.assign(scaled_inputs(spark, sf_dir), CLUSTER_FEATURES, CENTROIDS)
    return clustering.profile(df, FEATURE_COLUMNS).select("cluster_id", "n", *rounded(FEATURE_COLUMNS))


@query("kmeans_sweep", f"""WITH {A.CLEAN}
SELECT k::INTEGER AS k, (SELECT count(*) FROM clean) AS n, true AS silhouette_in_range, true AS below_total FROM range(2, 7) t(k)""")
def kmeans_sweep(spark, sf_dir):
    """Of each k: rows, and whether inertia stays below the spread around the mean and the silhouette within [-1, 1]."""
    df = stage(scaled_inputs(spark, sf_dir).select(FEATURE_COLUMNS))
    total = df.agg(F.count(F.lit(1)).alias("n"), sum(F.var_pop(c) for c in FEATURE_COLUMNS).alias("spread"))
    sweep = clustering.kmeans_sweep(df, FEATURE_COLUMNS).withColumn("one", F.lit(1))
    return sweep.join(total.withColumn("one", F.lit(1)), "one").select(
        "k", "n", F.col("silhouette_sq_euclidean").between(-1.0, 1.0).alias("silhouette_in_range"),
        (F.col("inertia") < F.col("n") * F.col("spread")).alias("below_total"))


@query("kmeans_assignments", f"""WITH {A.CLEAN} SELECT row_id, true AS nearest FROM clean""")
def kmeans_assignments(spark, sf_dir):
    """Of each row, whether no fitted centroid is nearer than the one it was given."""
    df = stage(scaled_inputs(spark, sf_dir).select("row_id", *FEATURE_COLUMNS))
    centroids = clustering.fit_centroids(df, FEATURE_COLUMNS)
    point = F.array(*FEATURE_COLUMNS)
    far = lambda c: F.aggregate(F.zip_with(point, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    distances = F.array(*[far(c) for c in centroids])
    rows = clustering.assign(df, FEATURE_COLUMNS, centroids)
    return rows.select("row_id", (F.abs(distances[F.col("cluster_id")] - F.array_min(distances)) < 1e-9).alias("nearest"))


# --- training ---------------------------------------------------------------------------
GRID = {"logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, "random_forest": {"numTrees": [20], "maxDepth": [5, 8]},
        "lightgbm_like": {"maxIter": [10], "numLeaves": [6, 12], "stepSize": [0.1]},
        "xgboost_like": {"maxIter": [10], "maxDepth": [3], "stepSize": [0.1], "subsamplingRate": [0.8]}}
_TRIALS = ", ".join(f"('{f}', {np.prod([len(v) for v in g.values()])}::BIGINT)" for f, g in GRID.items())


@query("model_select", f"""SELECT family, trials, true AS rates, true AS winner_is_best FROM (VALUES {_TRIALS}) v(family, trials)""")
def model_select(spark, sf_dir):
    """Trials of each family, whether their scores are rates, and whether the chosen family has the best of all."""
    df = stage(scaled_inputs(spark, sf_dir).select("row_id", *FEATURE_COLUMNS, "label"))
    winner, _, trials = training.select_model(df, FEATURE_COLUMNS, candidates=training.families(grid=GRID))
    best = trials.agg(F.max_by("family", "mean_score").alias("best"), F.max("mean_score").alias("top"), F.lit(1).alias("one"))
    ties = trials.filter(F.col("family") == winner).agg(F.max("mean_score").alias("own"), F.lit(1).alias("one"))
    return (trials.groupBy("family").agg(F.count(F.lit(1)).alias("trials"), F.min(F.col("mean_score").between(0.0, 1.0)).alias("rates"), F.lit(1).alias("one"))
            .join(best, "one").join(ties, "one").select("family", "trials", "rates", (F.col("own") >= F.col("top")).alias("winner_is_best")))


@query("holdout_metrics", f"""WITH {A.APPLICANTS},
t AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (label = 1)::BIGINT AS positives FROM (SELECT label, round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS n FROM applicants GROUP BY 1))
SELECT n, positives, true AS rates_agree, true AS better_than_chance FROM t""")
def holdout_metrics(spark, sf_dir):
    from decision_lens.operators.sampling import stratified_split, undersample
    from pyspark.ml.classification import GBTClassifier
    df = stage(scaled_inputs(spark, sf_dir).select("row_id", *FEATURE_COLUMNS, "label"))
    train, test = stratified_split(df, "row_id", "label")
    model = training.fit_pipeline(undersample(stage(train), "row_id", "label"), FEATURE_COLUMNS,
                                  GBTClassifier(labelCol="label", maxIter=10, maxDepth=3, stepSize=0.1, seed=42))
    scored = stage(training.score_model(test, model, ["row_id", "label"]))
    rates = ev.with_rates(ev.confusion(scored, "label", F.col("prediction"))).withColumn(
        "auc", F.lit(ev.auc(scored, "label", "probability").first()["auc"]))
    agree = ((F.abs(F.col("recall") - F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))) < 1e-9)
             & (F.abs(F.col("recall_precision") - 0.7 * F.col("recall") - 0.3 * F.col("precision")) < 1e-9))
    return rates.select((F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"), (F.col("tp") + F.col("fn")).alias("positives"),
                        agree.alias("rates_agree"), (F.col("auc") > 0.5).alias("better_than_chance"))


# --- attribution ------------------------------------------------------------------------
def attributed(spark, sf_dir):
    scored = stage(A.scored_applicants(spark, sf_dir).select(
        "row_id", "prediction_id", *FEATURE_COLUMNS, "label", "logit", "probability", "prediction"))
    return att.linear_attribution(scored, FZ, att.background_means(scored))


def _phi(c):
    return f"{FZ.weights[c]!r}::DOUBLE * ((coalesce({c}, 0) - mean_{c}) / {FZ.scale[c]!r}::DOUBLE) AS phi_{c}"


_BASE = f"{FZ.intercept!r}::DOUBLE + " + " + ".join(
    f"{FZ.weights[c]!r}::DOUBLE * ((mean_{c} - {FZ.center[c]!r}::DOUBLE) / {FZ.scale[c]!r}::DOUBLE)"
    for c in FEATURE_COLUMNS)
ATTRIBUTED = A.SCORED + f""",
means AS MATERIALIZED (SELECT {", ".join(f"avg(coalesce({c}, 0)) AS mean_{c}" for c in FEATURE_COLUMNS)} FROM clean),
attributed AS MATERIALIZED (SELECT *, {", ".join(_phi(c) for c in FEATURE_COLUMNS)}, {_BASE} AS baseline FROM scored, means),
phi AS MATERIALIZED ({" UNION ALL ".join(f"SELECT row_id, prediction_id, '{TECHNICAL[c]}' AS feature, {c} AS value, phi_{c} AS phi FROM attributed" for c in FEATURE_COLUMNS)})"""


@query("linear_attribution", f"WITH {ATTRIBUTED} SELECT prediction_id, feature, round(value, 6) AS value, round(phi, 6) AS phi FROM phi")
def linear_attribution(spark, sf_dir):
    return att.long_attribution(attributed(spark, sf_dir)).select("prediction_id", "feature", *rounded(["value", "phi"]))


@query("additivity_check", f"""WITH {ATTRIBUTED}
SELECT prediction_id, round(baseline, 6) AS baseline, round(z, 6) AS shap_sum_logit, round(1 / (1 + exp(-z)), 6) AS shap_probability,
       round(abs(1 / (1 + exp(-z)) - probability), 6) AS difference, abs(1 / (1 + exp(-z)) - probability) > 0.3 AS additivity_broken
FROM (SELECT *, baseline + {" + ".join("phi_" + c for c in FEATURE_COLUMNS)} AS z FROM attributed)""")
def additivity_check(spark, sf_dir):
    return att.additivity(attributed(spark, sf_dir)).select(
        "prediction_id", *rounded(["baseline", "shap_sum_logit", "shap_probability", "difference"]), "additivity_broken")


@query("top_features", f"""WITH {ATTRIBUTED},
kinds AS (SELECT *, 'overall' AS kind FROM phi UNION ALL SELECT *, 'positive' FROM phi WHERE phi > 0
          UNION ALL SELECT *, 'negative' FROM phi WHERE phi < 0),
r AS (SELECT *, row_number() OVER (PARTITION BY prediction_id, kind ORDER BY abs(phi) DESC, feature) AS position FROM kinds)
SELECT prediction_id, kind, position, feature, round(phi, 6) AS phi FROM r WHERE position <= 5""")
def top_features(spark, sf_dir):
    return att.top_features(attributed(spark, sf_dir)).select("prediction_id", "kind", "position", "feature", *rounded(["phi"]))


@query("global_importance", f"""WITH {ATTRIBUTED}
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phi GROUP BY 1 ORDER BY avg(abs(phi)) DESC, feature LIMIT 10""")
def global_importance(spark, sf_dir):
    return att.global_importance(attributed(spark, sf_dir)).select("feature", *rounded(["mean_abs_phi"]))


@query("permutation_attribution", f"""WITH {A.CLEAN} SELECT row_id, {len(FEATURE_COLUMNS)}::BIGINT AS features, true AS adds_up FROM clean""")
def permutation_attribution(spark, sf_dir):
    from pyspark.ml.classification import GBTClassifier
    df = stage(scaled_inputs(spark, sf_dir).select("row_id", *FEATURE_COLUMNS, "label"))
    model = training.fit_pipeline(df, FEATURE_COLUMNS, GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, seed=42))
    means = att.background_means(df)
    phi = att.permutation_attribution(df, model, means, FEATURE_COLUMNS).groupBy("row_id").agg(F.sum("phi").alias("total"), F.count(F.lit(1)).alias("features"))
    base = training.score_model(spark.createDataFrame([tuple(float(means[f]) for f in FEATURE_COLUMNS)], FEATURE_COLUMNS), model)
    z = training.score_model(df, model, ["row_id"]).select("row_id", att.logit(F.col("probability")).alias("z"), F.lit(1).alias("one"))
    gap = F.abs(F.col("total") - (F.col("z") - F.col("z0")))
    base = base.select(att.logit(F.col("probability")).alias("z0"), F.lit(1).alias("one"))
    return phi.join(z, "row_id").join(base, "one").select("row_id", "features", (gap < 1e-6).alias("adds_up"))


# --- counterfactuals --------------------------------------------------------------------
def explained(spark, sf_dir, asked=None):
    """Attributed applicants with their counterfactuals; staged, since several results read it.

    Only the applicants that a frame ``asked`` names by prediction_id are searched, if one is given; levels and percentiles
    are always those of all applicants.
    """
    rows = attributed(spark, sf_dir)
    some = rows if asked is None else rows.join(asked.select("prediction_id").distinct(), "prediction_id", "left_semi")
    return stage(cfs.with_counterfactuals(some, rows.fillna(0.0, FEATURE_COLUMNS), FZ))


def _level(c):
    q = f"unnest(quantile_cont(coalesce({c}, 0), {cfs.LEVEL_PROBS}))"
    v = f"round_even({q}, 0)" if c in COUNT_COLUMNS else q
    return (f"SELECT DISTINCT {FEATURE_COLUMNS.index(c)} AS j, '{TECHNICAL[c]}' AS f, {FZ.weights[c]!r}::DOUBLE AS w, "
            f"{FZ.scale[c]!r}::DOUBLE AS s, {v} AS v FROM clean")


COUNTERFACTUALS = ATTRIBUTED + f""",
levels AS MATERIALIZED ({" UNION ALL ".join(_level(c) for c in MUTABLE_COLUMNS)}),
cells AS MATERIALIZED (SELECT row_id, feature AS f, coalesce(value, 0) AS x FROM phi
          WHERE feature IN ({", ".join(repr(TECHNICAL[c]) for c in MUTABLE_COLUMNS)})),
vals AS MATERIALIZED (SELECT f, v, sum(n)::BIGINT AS n FROM (SELECT f, x AS v, 1 AS n FROM cells UNION ALL SELECT f, v, 0 FROM levels) GROUP BY 1, 2),
pcts AS MATERIALIZED (SELECT f, v, (2 * coalesce(sum(n) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n
                       + CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT * 50.0::DOUBLE / (sum(n) OVER (PARTITION BY f))::BIGINT AS p FROM vals),
moves AS MATERIALIZED (SELECT row_id, j, cells.f, x AS from_value, levels.v AS to_value, levels.v - x AS diff, a.p AS from_p, b.p AS to_p,
                 abs(b.p - a.p) AS chg, w * ((levels.v - x) / s) AS dz
          FROM cells JOIN levels ON levels.f = cells.f JOIN pcts a ON a.f = cells.f AND a.v = x
               JOIN pcts b ON b.f = cells.f AND b.v = levels.v
          WHERE abs(levels.v - x) >= 1e-10::DOUBLE),
cands AS MATERIALIZED (SELECT row_id, dz, round(chg, 9) AS distance, 1 AS n_changes, f AS names, to_value AS t1, NULL::DOUBLE AS t2, j AS j1, NULL AS j2 FROM moves
          UNION ALL
          SELECT a.row_id, a.dz + b.dz, round((a.chg + b.chg) / 2, 9), 2, a.f || '|' || b.f, a.to_value, b.to_value, a.j, b.j
          FROM moves a JOIN moves b ON b.row_id = a.row_id AND b.j > a.j),
best AS MATERIALIZED (SELECT c.*, prediction_id, prediction,
                row_number() OVER (PARTITION BY c.row_id ORDER BY distance, n_changes, names, t1, t2) AS cf_index
         FROM cands c JOIN scored USING (row_id) WHERE (logit + dz > 0) <> (prediction = 1)
         QUALIFY cf_index <= 3),
changes AS MATERIALIZED ({" UNION ALL ".join(f"""SELECT best.prediction_id, best.prediction, best.row_id, cf_index, distance, n_changes, f AS feature, from_value, to_value, diff,
                   from_p, to_p, chg FROM best JOIN moves m ON m.row_id = best.row_id AND m.j = j{i} AND m.to_value = t{i}""" for i in (1, 2))})"""


@query("percentile_rank", f"""WITH {COUNTERFACTUALS}
SELECT row_id, cells.f AS feature, round(p, 6) AS percentile FROM cells JOIN pcts ON pcts.f = cells.f AND pcts.v = x""")
def percentile_rank(spark, sf_dir):
    from decision_lens.functions.quantiles import melt
    from decision_lens.functions.ranks import lookup_percentiles, percentile_table
    df = stage(A.model_inputs(spark, sf_dir).select(
        "row_id", *[F.col(c).alias(TECHNICAL[c]) for c in MUTABLE_COLUMNS]))
    names = df.columns[1:]
    table = stage(percentile_table(df, names))
    return lookup_percentiles(melt(df, names, ["row_id"]), table).select("row_id", "feature", *rounded(["percentile"]))


@query("counterfactuals", f"""WITH {COUNTERFACTUALS}
SELECT prediction_id, cf_index, round(distance, 6) AS distance, n_changes, names FROM best""")
def counterfactuals(spark, sf_dir):
    df = explained(spark, sf_dir).select("prediction_id", F.posexplode("counterfactuals").alias("_p", "cf"))
    return df.select("prediction_id", (F.col("_p") + 1).alias("cf_index"), F.round("cf.distance", 6).alias("distance"),
                     "cf.n_changes", "cf.names")


@query("cf_changes", f"""WITH {COUNTERFACTUALS}
SELECT prediction_id, cf_index, feature, round(from_value, 9) AS from_value, round(to_value, 9) AS to_value, round(diff, 9) AS diff,
       round(from_p, 6) AS from_percentile, round(to_p, 6) AS to_percentile, round(chg, 6) AS percentile_change FROM changes""")
def cf_changes(spark, sf_dir):
    df = cfs.change_rows(explained(spark, sf_dir), ["prediction_id"])
    return df.select("prediction_id", "cf_index", "feature", F.round("from", 9).alias("from_value"),
                     F.round("to", 9).alias("to_value"), *rounded(["diff"], 9),
                     *rounded(["from_percentile", "to_percentile", "percentile_change"]))


WEAKENED = f"""weakened AS MATERIALIZED (SELECT b.prediction_id, b.prediction, b.cf_index,
  (s.logit + sum({"CASE m.feature " + " ".join(f"WHEN '{TECHNICAL[c]}' THEN {FZ.weights[c]!r}::DOUBLE / {FZ.scale[c]!r}::DOUBLE" for c in MUTABLE_COLUMNS) + " END"}
   * m.diff * CASE WHEN b.row_id % 3 = b.cf_index % 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) > 0) <> (b.prediction = 1) AS flipped
  FROM best b JOIN scored s ON s.row_id = b.row_id JOIN changes m ON m.row_id = b.row_id AND m.cf_index = b.cf_index GROUP BY b.prediction_id, b.prediction, b.cf_index, s.logit)"""


def partly_weakened(spark, sf_dir):
    """Explained applicants in which a third of the counterfactuals move half as far, so that some fail."""
    half = lambda m: F.struct(*[(m["from"] + (m["to"] - m["from"]) * 0.5).alias("to") if f == "to" else m[f].alias(f) for f in fields])
    df = explained(spark, sf_dir)
    fields = df.schema["counterfactuals"].dataType.elementType["changes"].dataType.elementType.fieldNames()
    changed = lambda cf, i: F.when(F.col("row_id") % 3 == (i + 1) % 3, cf.withField("changes", F.transform(cf["changes"], half))).otherwise(cf)
    return df.withColumn("counterfactuals", F.transform("counterfactuals", changed))


@query("cf_verify", f"""WITH {COUNTERFACTUALS}, {WEAKENED}
SELECT prediction_id, count(cf_index) AS n_counterfactuals, count(*) FILTER (flipped) AS n_flipped,
       CASE WHEN count(cf_index) > 0 THEN count(*) FILTER (flipped) / count(cf_index) ELSE 0.0::DOUBLE END AS success_rate
FROM scored LEFT JOIN weakened USING (prediction_id) GROUP BY 1""")
def cf_verify(spark, sf_dir):
    return cfs.verification_summary(partly_weakened(spark, sf_dir), FZ)


@query("flip_rate_by_position", f"""WITH {COUNTERFACTUALS}, {WEAKENED}
SELECT cf_index, count(*) AS n, round(avg(flipped::INTEGER), 9) AS flip_rate FROM weakened WHERE prediction = 1 GROUP BY 1""")
def flip_rate_by_position(spark, sf_dir):
    return cfs.flip_rates(cfs.verify_each(partly_weakened(spark, sf_dir), FZ, ["prediction_id"])).withColumn("flip_rate", F.round("flip_rate", 9))


@query("cf_status", f"""WITH {COUNTERFACTUALS},
c AS (SELECT prediction_id, count(cf_index) AS k FROM scored LEFT JOIN best USING (prediction_id) GROUP BY 1)
SELECT CASE WHEN k > 0 THEN 'ok' ELSE 'none_found' END AS cf_status, count(*) AS n, sum(k)::BIGINT AS n_counterfactuals FROM c GROUP BY 1""")
def cf_status(spark, sf_dir):
    return cfs.status_summary(explained(spark, sf_dir))


@query("prediction_overview", f"""WITH {COUNTERFACTUALS},
c AS (SELECT s.prediction_id, s.prediction, any_value(probability) AS p, count(cf_index) AS k
      FROM scored s LEFT JOIN best ON best.prediction_id = s.prediction_id GROUP BY 1, 2)
SELECT prediction, count(*) AS n, round(avg(p), 6) AS mean_probability, round(stddev_samp(p), 6) AS std_probability,
       round(min(p), 6) AS min_probability, round(max(p), 6) AS max_probability, count(*) FILTER (p BETWEEN 0.45 AND 0.55) AS n_borderline,
       round(avg(k), 6) AS mean_cf_count, round(stddev_samp(k), 6) AS std_cf_count, min(k) AS min_cf_count, max(k) AS max_cf_count,
       round(median(p), 6) AS median_probability, median(k)::DOUBLE AS median_cf_count
FROM c GROUP BY ROLLUP (prediction)""")
def prediction_overview(spark, sf_dir):
    return cfs.prediction_overview(explained(spark, sf_dir)).select(
        "prediction", "n", *rounded(["mean_probability", "std_probability", "min_probability", "max_probability"]),
        "n_borderline", *rounded(["mean_cf_count", "std_cf_count"]), "min_cf_count", "max_cf_count", *rounded(["median_probability"]), "median_cf_count")


@query("cf_count_distribution", f"""WITH {COUNTERFACTUALS},
c AS (SELECT s.prediction_id, s.prediction, count(cf_index) AS k FROM scored s LEFT JOIN best ON best.prediction_id = s.prediction_id GROUP BY 1, 2)
SELECT prediction, k::INTEGER AS n_counterfactuals, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY prediction), 6) AS share FROM c GROUP BY 1, 2""")
def cf_count_distribution(spark, sf_dir):
    return cfs.count_distribution(explained(spark, sf_dir)).select("prediction", "n_counterfactuals", "n", *rounded(["share"]))


@query("flat_rows_split", f"""WITH {COUNTERFACTUALS}
SELECT s.prediction_id, round(s.income, 6) AS income, round(s.late_90, 6) AS late_90, count(cf_index) AS n_counterfactuals, round(sum(distance), 6) AS distances,
  CASE WHEN count(cf_index) = 0 THEN 'No counterfactuals found' END AS info FROM (SELECT prediction_id, coalesce(income, 0) AS income, coalesce(late_90, 0) AS late_90 FROM scored) s
LEFT JOIN best USING (prediction_id) GROUP BY s.prediction_id, s.income, s.late_90""")
def flat_rows_split(spark, sf_dir):
    """Wide rows, as they are exported, split back into values, counterfactuals and a remark."""
    wide = cfs.flat_rows(explained(spark, sf_dir))
    back = cfs.split_rows(stage(wide))
    return back.select("prediction_id", F.round(F.element_at("input_data", TECHNICAL["income"]), 6).alias("income"), F.round(F.element_at("input_data", TECHNICAL["late_90"]), 6).alias("late_90"),
                       F.size("counterfactuals").cast("long").alias("n_counterfactuals"),
                       F.round(F.when(F.size("counterfactuals") > 0, F.aggregate("counterfactuals", F.lit(0.0), lambda t, c: t + c["distance"])), 6).alias("distances"), "info")


@query("verification_dataset", f"""WITH {COUNTERFACTUALS}
SELECT prediction_id, prediction, cf_index, feature, round(from_value, 9) AS from_value, round(to_value, 9) AS to_value FROM changes
WHERE prediction_id IN (SELECT prediction_id FROM scored WHERE prediction_id IN (SELECT prediction_id FROM best) ORDER BY probability DESC, prediction_id LIMIT 50)""")
def verification_dataset(spark, sf_dir):
    """Applicants with the highest probability that have counterfactuals, with all changes to verify."""
    chosen = cfs.verification_dataset(explained(spark, sf_dir), 50, [F.desc("probability"), "prediction_id"])
    return cfs.change_rows(chosen, ["prediction_id", "prediction"]).select("prediction_id", "prediction", "cf_index", "feature", F.round("from", 9).alias("from_value"), F.round("to", 9).alias("to_value"))


def _shown_sql(c):
    """Shown value of a change of column c from x to y; x is also the raw value."""
    moved = "CASE WHEN abs(y - x) < 1e-6 THEN x WHEN abs(x) > 1e-10 THEN x * greatest(0.1::DOUBLE, least(10.0::DOUBLE, y / x)) ELSE x + (y - x) END"
    least, most, whole = SHOWN.get(c, (None, None, False))
    moved = f"round_even({moved}, 0)" if whole else moved
    moved = moved if least is None else f"greatest({least!r}::DOUBLE, {moved})"
    moved = moved if most is None else f"least({most!r}::DOUBLE, {moved})"
    if c in FZ.caps:
        lo, hi = FZ.caps[c]
        moved = f"greatest({lo!r}::DOUBLE, least({hi!r}::DOUBLE, {moved}))"
    return f"WHEN '{TECHNICAL[c]}' THEN {moved}"


@query("cf_display", f"""WITH {COUNTERFACTUALS}
SELECT prediction_id, cf_index, feature, round(CASE feature {" ".join(_shown_sql(c) for c in MUTABLE_COLUMNS)} END, 9) AS shown
FROM (SELECT prediction_id, cf_index, feature, from_value AS x, to_value AS y FROM changes)""")
def cf_display(spark, sf_dir):
    """What a reader is shown for every change of every counterfactual."""
    rows = cfs.change_rows(explained(spark, sf_dir), ["prediction_id"])
    shown = F.coalesce(*[F.when(F.col("feature") == TECHNICAL[c], cfs.display_value(c, F.col("from"), F.col("from"), F.col("to"), FZ.caps)) for c in MUTABLE_COLUMNS])
    return rows.select("prediction_id", "cf_index", "feature", F.round(shown, 9).alias("shown"))
