"""Queries over tree ensembles: scores, counterfactuals, verification and attribution for a given and for a fitted one."""

from pyspark.sql import functions as F

from decision_lens.operators import attribution as att, counterfactual as cfs, ensembles, verification
from decision_lens.operators.worklist import friendly
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.registry import query
from decision_lens.schemas import FEATURE_COLUMNS, MUTABLE_COLUMNS, TECHNICAL
from decision_lens.session import stage

# --- a given ensemble: trees as (feature, threshold, at most, above), leaves in log-odds -----------------
BIAS = -0.3104417
TREES = [
    ("utilisation", 0.45, ("late_90", 0.5, -0.6217731, 0.4102947), ("late_90", 1.5, 0.2309113, 0.9688371)),
    ("late_30_59", 0.5, ("income", 5200.0, -0.1127419, -0.3691153), ("late_60_89", 0.5, 0.2938167, 0.7405529)),
    ("debt_ratio", 0.35, ("age", 40.0, -0.0811379, -0.3327121), ("open_lines", 2.5, 0.4709337, 0.1195643)),
    ("income", 3100.0, ("debt_ratio", 0.8, 0.2093191, 0.6612373), ("utilisation", 0.75, -0.2908117, 0.1730659)),
    ("late_60_89", 1.5, ("real_estate", 1.5, -0.1309217, 0.0612491), 0.5281973),
    ("dependents", 2.5, ("late_90", 0.5, -0.2713339, 0.1906271), ("utilisation", 0.6, 0.0893927, 0.4311061)),
]
BOOSTED = ensembles.Ensemble.from_trees(FEATURE_COLUMNS, TREES, BIAS)
BACKGROUND = 20


def _tree_sql(tree, columns: dict) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}::DOUBLE"
    name, cut, low, high = tree
    return f"CASE WHEN {columns[name]} <= {cut!r}::DOUBLE THEN {_tree_sql(low, columns)} ELSE {_tree_sql(high, columns)} END"


def margin_sql(columns: dict) -> str:
    return f"({BIAS!r}::DOUBLE + " + " + ".join(_tree_sql(t, columns) for t in TREES) + ")"


OWN = {c: c for c in FEATURE_COLUMNS}
FILLED = A.CLEAN + f""",
bfilled AS MATERIALIZED (SELECT row_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURE_COLUMNS)} FROM clean),
bscored AS MATERIALIZED (SELECT *, 'app-' || row_id AS prediction_id, margin > 0 AS declined FROM (SELECT *, {margin_sql(OWN)} AS margin FROM bfilled))"""


def scored(spark, sf_dir):
    return stage(ensembles.score(A.model_inputs(spark, sf_dir), BOOSTED).select(
        "row_id", "prediction_id", *FEATURE_COLUMNS, "label", "margin", "probability", "prediction"))


def explained(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return stage(cfs.with_ensemble_counterfactuals(rows, rows, BOOSTED))


@query("ensemble_scores", f"""WITH {FILLED} SELECT prediction_id, round(margin, 9) AS margin, round(1 / (1 + exp(-margin)), 9) AS probability,
  declined::INTEGER AS prediction FROM bscored""")
def ensemble_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("prediction_id", *rounded(["margin", "probability"], 9), "prediction")


def _cells(c):
    cuts = BOOSTED.cuts[FEATURE_COLUMNS.index(c)].tolist()
    cell = " + ".join(f"({c} > {t!r}::DOUBLE)::INTEGER" for t in cuts) or "0"
    return f"SELECT row_id, {FEATURE_COLUMNS.index(c)} AS j, '{TECHNICAL[c]}' AS f, {c} AS x, {cell} AS cell FROM bfilled"


def _changed(one, two):
    return {c: f"CASE WHEN {one[0]} = {i} THEN {one[1]} WHEN {two[0]} = {i} THEN {two[1]} ELSE {c} END" for i, c in enumerate(FEATURE_COLUMNS)}


ENSEMBLE_CFS = FILLED + f""",
bcells AS MATERIALIZED ({" UNION ALL ".join(_cells(c) for c in MUTABLE_COLUMNS)}),
blevels AS MATERIALIZED (SELECT j, f, cell, min(x) AS lo, max(x) AS hi FROM bcells GROUP BY ALL),
bpcts AS MATERIALIZED (SELECT f, v, (2 * (sum(n) OVER (PARTITION BY f ORDER BY v) - n) + n + 1)::BIGINT * 50.0::DOUBLE / (sum(n) OVER (PARTITION BY f))::BIGINT AS p
  FROM (SELECT f, x AS v, count(*) AS n FROM bcells GROUP BY ALL)),
bmoves AS MATERIALIZED (SELECT m.*, a.p AS from_p, b.p AS to_p, abs(b.p - a.p) AS chg FROM
  (SELECT c.row_id, c.j, c.f, c.x, l.cell, CASE WHEN l.cell > c.cell THEN lo ELSE hi END AS t FROM bcells c JOIN blevels l ON l.j = c.j AND l.cell <> c.cell) m
  JOIN bpcts a ON a.f = m.f AND a.v = x JOIN bpcts b ON b.f = m.f AND b.v = t),
bcands AS (SELECT row_id, round(chg, 9) AS distance, 1 AS n_changes, f AS names, j AS j1, t AS t1, -1 AS j2, NULL::DOUBLE AS t2 FROM bmoves
  UNION ALL SELECT a.row_id, round((a.chg + b.chg) / 2, 9), 2, a.f || '|' || b.f, a.j, a.t, b.j, b.t FROM bmoves a JOIN bmoves b ON b.row_id = a.row_id AND b.j > a.j),
bbest AS MATERIALIZED (SELECT c.*, prediction_id, declined, row_number() OVER (PARTITION BY c.row_id ORDER BY distance, n_changes, names, t1, t2) AS cf_index
  FROM bcands c JOIN bscored USING (row_id) WHERE ({margin_sql(_changed(("j1", "t1"), ("j2", "t2")))} > 0) <> declined QUALIFY cf_index <= 3)"""


@query("ensemble_counterfactuals", f"""WITH {ENSEMBLE_CFS} SELECT prediction_id, cf_index, round(distance, 6) AS distance, n_changes, names,
  round(t1, 9) AS first_target, round(t2, 9) AS second_target FROM bbest""")
def ensemble_counterfactuals(spark, sf_dir):
    df = explained(spark, sf_dir).select("prediction_id", F.posexplode("counterfactuals").alias("_p", "cf"))
    target = lambda i: F.round(F.get("cf.changes", F.lit(i))["to"], 9)
    return df.select("prediction_id", (F.col("_p") + 1).alias("cf_index"), F.round("cf.distance", 6).alias("distance"), "cf.n_changes", "cf.names",
                     target(0).alias("first_target"), target(1).alias("second_target"))


def weakened(df):
    """A third of the counterfactuals moves only nine tenths of the way, so that some fail."""
    fields = df.schema["counterfactuals"].dataType.elementType["changes"].dataType.elementType.fieldNames()
    less = lambda m: F.struct(*[(m["from"] + (m["to"] - m["from"]) * 0.9).alias("to") if f == "to" else m[f].alias(f) for f in fields])
    changed = lambda cf, i: F.when(F.col("row_id") % 3 == (i + 1) % 3, cf.withField("changes", F.transform(cf["changes"], less))).otherwise(cf)
    return df.withColumn("counterfactuals", F.transform("counterfactuals", changed))


def _moved(j, t):
    x = "CASE " + j + " " + " ".join(f"WHEN {FEATURE_COLUMNS.index(c)} THEN {c}" for c in MUTABLE_COLUMNS) + " END"
    return f"CASE WHEN b.row_id % 3 = cf_index % 3 THEN {x} + ({t} - {x}) * 0.9::DOUBLE ELSE {t} END"


WEAKER = f"""bweak AS (SELECT *, ({margin_sql(_changed(("j1", "u1"), ("j2", "u2")))} > 0) <> declined AS flipped, 1 / (1 + exp(-{margin_sql(_changed(("j1", "u1"), ("j2", "u2")))})) AS np
  FROM (SELECT b.prediction_id, b.cf_index, b.j1, b.j2, {_moved("j1", "t1")} AS u1, {_moved("j2", "t2")} AS u2, s.* EXCLUDE (prediction_id) FROM bbest b JOIN bscored s ON s.row_id = b.row_id))"""


@query("ensemble_verify", f"""WITH {ENSEMBLE_CFS}, {WEAKER}
SELECT prediction_id, count(cf_index) AS n_counterfactuals, count(*) FILTER (flipped) AS n_flipped,
       CASE WHEN count(cf_index) > 0 THEN count(*) FILTER (flipped) / count(cf_index) ELSE 0.0::DOUBLE END AS success_rate
FROM bscored LEFT JOIN bweak USING (prediction_id) GROUP BY 1""")
def ensemble_verify(spark, sf_dir):
    return cfs.verification_summary(weakened(explained(spark, sf_dir)), BOOSTED)


@query("ensemble_verify_each", f"""WITH {ENSEMBLE_CFS}, {WEAKER}
SELECT prediction_id, cf_index, round(np, 9) AS new_probability, flipped, round(np - 1 / (1 + exp(-margin)), 9) AS probability_change FROM bweak""")
def ensemble_verify_each(spark, sf_dir):
    return cfs.verify_each(weakened(explained(spark, sf_dir)), BOOSTED, ["prediction_id"]).select(
        "prediction_id", "cf_index", F.round("new_probability", 9).alias("new_probability"), "flipped", *rounded(["probability_change"], 9))


# --- suggestions in texts, verified by the ensemble --------------------------------------------------------
def suggestions(spark, sf_dir):
    """One suggestion per application, from its first counterfactual: as it is, by reader-facing names, or moved too little."""
    first = F.get("counterfactuals", F.lit(0))["changes"]
    kind = F.col("row_id") % 4
    name = lambda m: F.when(kind == 1, friendly(m["feature"])).when(kind == 2, F.concat(m["feature"], F.lit("_log"))).otherwise(m["feature"])
    entry = lambda m: F.struct(name(m).alias("feature_name"), F.when(kind == 2, m["from"]).otherwise(m["to"]).alias("target_value"))
    listed = F.when((kind != 3) & first.isNotNull(), F.transform(first, entry)).otherwise(F.array().cast("array<struct<feature_name:string,target_value:double>>"))
    return explained(spark, sf_dir).withColumn("changes", listed)


@query("ensemble_suggestions", f"""WITH {ENSEMBLE_CFS},
first_cf AS (SELECT s.*, b.j1, b.j2, row_id % 4 AS kind, CASE WHEN row_id % 4 = 2 THEN CASE j1 {" ".join(f"WHEN {FEATURE_COLUMNS.index(c)} THEN {c}" for c in MUTABLE_COLUMNS)} END ELSE t1 END AS u1,
    CASE WHEN row_id % 4 = 2 THEN CASE j2 {" ".join(f"WHEN {FEATURE_COLUMNS.index(c)} THEN {c}" for c in MUTABLE_COLUMNS)} END ELSE t2 END AS u2
  FROM bscored s LEFT JOIN (SELECT row_id, j1, j2, t1, t2 FROM bbest WHERE cf_index = 1) b USING (row_id)),
after AS (SELECT *, {margin_sql(_changed(("j1", "u1"), ("j2", "u2")))} AS z, j1 IS NOT NULL AND kind <> 3 AS usable, kind = 0 AS same_name FROM first_cf)
SELECT prediction_id, NOT declined AS cf_skipped, CASE WHEN declined AND usable THEN z <= 0 END AS cf_flipped,
  CASE WHEN declined AND usable THEN same_name END AS cf_match, CASE WHEN declined AND usable THEN round(1 / (1 + exp(-z)) - 1 / (1 + exp(-margin)), 4) END AS cf_probability_change,
  CASE WHEN declined THEN CASE WHEN usable THEN least(1.0::DOUBLE, (z <= 0)::INTEGER + CASE WHEN same_name THEN 0.2::DOUBLE ELSE 0 END) ELSE 0.0::DOUBLE END END AS cf_score FROM after""")
def ensemble_suggestions(spark, sf_dir):
    return verification.verify_suggestions(suggestions(spark, sf_dir), BOOSTED).select(
        "prediction_id", "cf_skipped", "cf_flipped", "cf_match", "cf_probability_change", "cf_score")


# --- attribution against background rows ---------------------------------------------------------------------
def _leaves():
    out = []

    def walk(tree, bounds):
        if not isinstance(tree, tuple):
            out.append((bounds, tree))
            return
        name, cut, low, high = tree
        lo, hi = bounds.get(name, (None, None))
        walk(low, {**bounds, name: (lo, cut if hi is None else min(hi, cut))})
        walk(high, {**bounds, name: (cut if lo is None else max(lo, cut), hi)})

    for t in TREES:
        walk(t, {})
    return out


_BOUND = lambda v, sign: f"'{sign}Infinity'::DOUBLE" if v is None else f"{v!r}::DOUBLE"
LEAVES = "lc(leaf, f, lo, hi, value) AS (VALUES " + ", ".join(
    f"({i}, '{TECHNICAL[f]}', {_BOUND(lo, '-')}, {_BOUND(hi, '')}, {v!r}::DOUBLE)" for i, (bounds, v) in enumerate(_leaves()) for f, (lo, hi) in bounds.items()) + ")"


@query("ensemble_attribution", f"""WITH {FILLED}, {LEAVES},
xs AS MATERIALIZED ({" UNION ALL ".join(f"SELECT row_id, '{TECHNICAL[c]}' AS f, {c} AS x FROM bfilled" for c in FEATURE_COLUMNS)}),
bg AS MATERIALIZED (SELECT row_id FROM bfilled ORDER BY md5('42:' || row_id), row_id LIMIT {BACKGROUND}),
sx AS MATERIALIZED (SELECT row_id, leaf, f, value, x > lo AND x <= hi AS ok FROM xs JOIN lc USING (f)),
sz AS MATERIALIZED (SELECT row_id AS z, leaf, f, ok FROM sx WHERE row_id IN (SELECT row_id FROM bg)),
cell AS MATERIALIZED (SELECT sx.row_id, sz.z, sx.leaf, sx.f, sx.value, sx.ok AND NOT sz.ok AS mine, sz.ok AND NOT sx.ok AS other, NOT sx.ok AND NOT sz.ok AS none
  FROM sx JOIN sz ON sz.leaf = sx.leaf AND sz.f = sx.f),
side AS (SELECT row_id, z, leaf, count(*) FILTER (mine) AS a, count(*) FILTER (other) AS b FROM cell GROUP BY ALL HAVING count(*) FILTER (none) = 0),
phi AS (SELECT row_id, f, sum(CASE WHEN mine THEN value * factorial((a - 1)::INTEGER) * factorial(b::INTEGER) / factorial((a + b)::INTEGER)
    ELSE -value * factorial(a::INTEGER) * factorial((b - 1)::INTEGER) / factorial((a + b)::INTEGER) END) / {BACKGROUND}.0::DOUBLE AS phi
  FROM cell JOIN side USING (row_id, z, leaf) WHERE mine OR other GROUP BY ALL)
SELECT 'app-' || row_id AS prediction_id, f AS feature, round(coalesce(phi, 0), 6) AS phi, round((SELECT avg(margin) FROM bscored WHERE row_id IN (SELECT row_id FROM bg)), 6) AS baseline
FROM xs LEFT JOIN phi USING (row_id, f)""")
def ensemble_attribution(spark, sf_dir):
    rows = scored(spark, sf_dir)
    explainer = ensembles.Explainer(BOOSTED, ensembles.background(rows, FEATURE_COLUMNS, BACKGROUND))
    out = ensembles.attribution(rows, explainer)
    cells = F.array(*[F.struct(F.lit(TECHNICAL[c]).alias("feature"), (F.round(f"phi_{c}", 6) + 0.0).alias("phi")) for c in FEATURE_COLUMNS])
    return out.select("prediction_id", F.inline(cells), F.lit(round(explainer.base, 6)).alias("baseline"))


# --- a fitted ensemble -----------------------------------------------------------------------------------------
@query("fitted_counterfactuals")
def fitted_counterfactuals(spark, sf_dir):
    """Counterfactuals of a fitted model; probability after the change by the flat arrays and by the model itself."""
    from decision_lens.operators import training
    from pyspark.ml.classification import GBTClassifier
    rows = stage(A.model_inputs(spark, sf_dir).select("row_id", *FEATURE_COLUMNS, "label"))
    model = training.fit_pipeline(rows, FEATURE_COLUMNS, GBTClassifier(labelCol="label", maxIter=10, maxDepth=3, seed=42))
    ensemble = ensembles.ensemble_of(model)
    found = cfs.with_ensemble_counterfactuals(ensembles.score(rows, ensemble), rows, ensemble)
    each = found.select("row_id", "prediction", *FEATURE_COLUMNS, F.posexplode("counterfactuals").alias("_p", "cf"))
    targets = F.map_from_entries(F.transform("cf.changes", lambda m: F.struct(m["feature"], m["to"])))
    each = cfs.rescored(each.withColumn("probability", F.lit(0.0)).withColumn("_t", targets), ensemble, F.col("_t"))
    # two features of a row may stand on both sides of the assignment, so the new values get names of their own first
    changed = each.select("row_id", (F.col("_p") + 1).alias("cf_index"), F.col("cf.distance").alias("distance"), F.col("cf.names").alias("names"), "flipped", "new_probability",
                          *[v.alias(c) for c, v in cfs.applied(F.col("_t")).items()])
    return training.score_model(stage(changed), model, ["row_id", "cf_index", "distance", "names", "flipped", "new_probability"]).withColumnRenamed(
        "probability", "model_probability").withColumnRenamed("prediction", "model_prediction")
