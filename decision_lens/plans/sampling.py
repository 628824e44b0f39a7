"""Queries over splits, samples and their representativeness."""

from pyspark.sql import functions as F

from decision_lens.functions.columns import age_band
from decision_lens.operators import representativeness as rep, sampling as ops
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded, sql_rounded
from decision_lens.plans.registry import query
from decision_lens.schemas import BAND_PRIORITY, SAMPLING_TARGETS
from decision_lens.session import stage

COLUMNS = ["row_id", "age", "probability", "prediction", "label", "cluster_id"]


def hash_sql(key: str, seed=42) -> str:
    return f"md5(concat('{seed}:', {key}))"


def population(spark, sf_dir):
    """Scored applicants with a cluster per row; the cluster is unknown for every 13th."""
    scored = A.scored_applicants(spark, sf_dir)
    cluster = F.when(F.col("row_id") % 13 != 0, F.col("row_id") % 4)
    return stage(scored.withColumn("cluster_id", cluster).select(COLUMNS))


POPULATION = A.SCORED + f""",
population AS (SELECT *, CASE WHEN row_id % 13 <> 0 THEN row_id % 4 END AS cluster_id,
                      {hash_sql("row_id")} AS h, {A.BAND} AS band, {A.AGE_BAND} AS age_group FROM scored)"""


@query("random_sample", f"""WITH {POPULATION}
SELECT row_id FROM population ORDER BY h, row_id LIMIT (SELECT round(count(*) * 0.1)::BIGINT FROM population)""")
def random_sample(spark, sf_dir):
    return ops.fraction_sample(population(spark, sf_dir), "row_id", 0.1).select("row_id")


@query("stratified_split", f"""WITH {POPULATION},
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY h, row_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM population)
SELECT row_id, label, CASE WHEN rn <= n - round_even(n * 0.2::DOUBLE, 0) THEN 'train' ELSE 'test' END AS part FROM r""")
def stratified_split(spark, sf_dir):
    train, test = ops.stratified_split(population(spark, sf_dir), "row_id", "label")
    return (train.select("row_id", "label", F.lit("train").alias("part"))
            .unionAll(test.select("row_id", "label", F.lit("test").alias("part"))))


@query("undersampled", f"""WITH {POPULATION},
c AS (SELECT label, count(*) AS n FROM population GROUP BY 1),
m AS (SELECT label AS minority, n FROM c ORDER BY n, label LIMIT 1),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY h, row_id) AS rn FROM population)
SELECT row_id, label FROM r, m WHERE label = minority OR rn <= floor(n / 0.3::DOUBLE)""")
def undersampled(spark, sf_dir):
    return ops.undersample(population(spark, sf_dir), "row_id", "label").select("row_id", "label")


@query("cluster_sample", f"""WITH {POPULATION},
p AS (SELECT *, coalesce(cluster_id, 0) AS c, count(*) OVER () AS total, (count(*) OVER () // 8) AS size FROM population),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY h, row_id) AS rn,
             greatest(1, floor(size * (count(*) OVER (PARTITION BY c)) / total::DOUBLE)) AS quota FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, h, row_id) AS pick FROM r)
SELECT row_id FROM o WHERE pick <= size""")
def cluster_sample(spark, sf_dir):
    pop = population(spark, sf_dir)
    return ops.cluster_sample(pop, "row_id", pop.count() // 8).select("row_id")


_TARGETS = ", ".join(f"('{b}', {n})" for b, n in SAMPLING_TARGETS.items())
CATEGORY = POPULATION + f""",
targets(b, want) AS (VALUES {_TARGETS}),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY band ORDER BY h, row_id) <= coalesce(want, 0) AS chosen
           FROM population p LEFT JOIN targets ON b = band),
picks AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, h, row_id) AS pick FROM ranked),
sample AS (SELECT * FROM picks WHERE chosen OR pick <= 100)"""


@query("category_sample", f"WITH {CATEGORY} SELECT row_id, band FROM sample")
def category_sample(spark, sf_dir):
    from decision_lens.functions.columns import probability_band
    return ops.category_sample(population(spark, sf_dir), "row_id").select(
        "row_id", probability_band(F.col("probability")).alias("band"))


_PRIORITY = "CASE band " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(BAND_PRIORITY)) + " ELSE 9 END"
_SHARE = "CASE band " + " ".join(
    f"WHEN '{b}' THEN {n / sum(SAMPLING_TARGETS.values())!r}::DOUBLE" for b, n in SAMPLING_TARGETS.items()) + " END"


@query("age_first_sample", f"""WITH RECURSIVE {POPULATION},
sizes AS (SELECT age_group, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, age_group) AS pos,
                 count(*) OVER () AS groups, sum(count(*)) OVER () AS everyone FROM population GROUP BY 1),
shares AS (SELECT *, greatest(1, floor(100 * (n / everyone::DOUBLE)))::BIGINT AS part FROM sizes),
goals AS (SELECT age_group, CASE WHEN pos < groups THEN part
                 ELSE 100 - coalesce(sum(part) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS goal
          FROM shares),
cells AS (SELECT age_group, band, {_PRIORITY} AS prio, count(*) AS available, any_value({_SHARE}) AS share
          FROM population WHERE band IS NOT NULL GROUP BY ALL),
steps AS (SELECT c.*, goal, row_number() OVER (PARTITION BY c.age_group ORDER BY prio) AS step
          FROM cells c JOIN goals USING (age_group)),
walk AS (SELECT age_group, band, step, goal,
                greatest(0, least(goal, available, greatest(1, floor(goal * share)::BIGINT))) AS n,
                goal - greatest(0, least(goal, available, greatest(1, floor(goal * share)::BIGINT))) AS remaining
         FROM steps WHERE step = 1
         UNION ALL
         SELECT s.age_group, s.band, s.step, s.goal,
                greatest(0, least(remaining, available, greatest(1, floor(s.goal * share)::BIGINT))),
                remaining - greatest(0, least(remaining, available, greatest(1, floor(s.goal * share)::BIGINT)))
         FROM walk w JOIN steps s ON s.age_group = w.age_group AND s.step = w.step + 1),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.age_group, p.band ORDER BY h, row_id) <= coalesce(w.n, 0) AS chosen
           FROM population p LEFT JOIN walk w ON w.age_group = p.age_group AND w.band = p.band),
picks AS (SELECT r.*, goal, row_number() OVER (PARTITION BY r.age_group ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, h, row_id) AS pick
          FROM ranked r JOIN goals USING (age_group))
SELECT row_id, age_group FROM picks WHERE chosen OR pick <= goal""")
def age_first_sample(spark, sf_dir):
    return ops.age_first_sample(population(spark, sf_dir), "row_id").select(
        "row_id", age_band(F.col("age")).alias("age_group"))


def _both(spark, sf_dir):
    pop = population(spark, sf_dir)
    return pop, ops.category_sample(pop, "row_id")


def _ks_sql(c: str) -> str:
    return f"""{c}_v AS (SELECT {c} AS v, sum(p)::BIGINT AS p, sum(s)::BIGINT AS s FROM
  (SELECT {c}, 1 AS p, 0 AS s FROM population UNION ALL SELECT {c}, 0, 1 FROM sample) WHERE {c} IS NOT NULL GROUP BY 1),
{c}_f AS (SELECT sum(p) OVER o / (sum(p) OVER ())::DOUBLE - sum(s) OVER o / (sum(s) OVER ())::DOUBLE AS gap,
                 (sum(p) OVER ())::BIGINT AS n, (sum(s) OVER ())::BIGINT AS m FROM {c}_v WINDOW o AS (ORDER BY v)),
{c}_d AS (SELECT '{c}' AS feature, max(abs(gap)) AS statistic, max(n) AS n_population, max(m) AS n_sample FROM {c}_f)"""


@query("ks_two_sample", f"""WITH {CATEGORY}, {_ks_sql("probability")}, {_ks_sql("age")},
d AS (SELECT *, statistic * sqrt(n_population::DOUBLE * n_sample / (n_population + n_sample)) AS reach
      FROM (FROM probability_d UNION ALL FROM age_d)),
k AS (SELECT *, CASE WHEN reach < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101),
        lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * reach * reach))))) END AS p_value FROM d)
SELECT feature, round(statistic, 6) AS statistic, n_population, n_sample, round(p_value, 6) AS p_value,
       p_value > 0.05 AS similar FROM k""")
def ks_two_sample(spark, sf_dir):
    return rep.ks_two_sample(*_both(spark, sf_dir), ["probability", "age"]).select(
        "feature", *rounded(["statistic"]), "n_population", "n_sample", *rounded(["p_value"]), "similar")


def _representation_sql(expr: str, name: str) -> str:
    return f"""(SELECT *, round(abs(pp - sp), 6) AS abs_difference, round(pp, 6) AS population_pct, round(sp, 6) AS sample_pct FROM (
  SELECT {name}, p AS n_population, s AS n_sample, 100.0::DOUBLE * p / sum(p) OVER () AS pp, 100.0::DOUBLE * s / sum(s) OVER () AS sp,
         round(100.0::DOUBLE * s / p, 6) AS sampling_rate_pct
  FROM (SELECT {name}, sum(p)::BIGINT AS p, sum(s)::BIGINT AS s FROM
         (SELECT {expr} AS {name}, 1 AS p, 0 AS s FROM population UNION ALL SELECT {expr}, 0, 1 FROM sample) GROUP BY 1)))"""


_REP = "n_population, n_sample, population_pct, sample_pct, sampling_rate_pct, abs_difference"
_RISK = "CASE WHEN probability < 0.3 THEN 'low' WHEN probability <= 0.7 THEN 'medium' ELSE 'high' END"


def _rep_columns(df, name):
    return df.select(name, "n_population", "n_sample",
                     *rounded(["population_pct", "sample_pct", "sampling_rate_pct", "abs_difference"]))


@query("representation", f"""WITH {CATEGORY}
SELECT 'cluster' AS kind, cluster_id AS level, {_REP} FROM {_representation_sql("coalesce(cluster_id::VARCHAR, 'null')", "cluster_id")}
UNION ALL SELECT 'age', age_band, {_REP} FROM {_representation_sql("age_group", "age_band")}
UNION ALL SELECT 'risk', risk_level, {_REP} FROM {_representation_sql(_RISK, "risk_level")}""")
def representation(spark, sf_dir):
    pop, smp = _both(spark, sf_dir)
    smp = stage(smp)
    parts = [("cluster", rep.representation(pop, smp, F.col("cluster_id"), "level")),
             ("age", rep.representation(pop, smp, age_band(F.col("age")), "level")),
             ("risk", rep.risk_levels(pop, smp).withColumnRenamed("risk_level", "level"))]
    return rep.stacked(*[_rep_columns(t, "level").withColumn("kind", F.lit(k)) for k, t in parts])


@query("risk_levels", f"""WITH {CATEGORY} SELECT risk_level, {_REP} FROM {_representation_sql(_RISK, "risk_level")}""")
def risk_levels(spark, sf_dir):
    return _rep_columns(rep.risk_levels(*_both(spark, sf_dir)), "risk_level")


@query("preservation", f"""WITH {CATEGORY},
p AS (SELECT count(*) AS n_population, avg(prediction) AS population_prediction, avg(probability) AS population_probability FROM population),
s AS (SELECT count(*) AS n_sample, avg(prediction) AS sample_prediction, avg(probability) AS sample_probability FROM sample)
SELECT n_population, n_sample, round(n_sample / n_population, 6) AS sampling_ratio,
       {sql_rounded([f"{a}_{b}" for a in ("population", "sample") for b in ("prediction", "probability")])},
       round(abs(population_prediction - sample_prediction), 6) AS prediction_abs_diff,
       round(abs(population_prediction - sample_prediction) / population_prediction, 6) AS prediction_rel_diff,
       round(abs(population_probability - sample_probability), 6) AS probability_abs_diff,
       round(abs(population_probability - sample_probability) / population_probability, 6) AS probability_rel_diff
FROM p, s""")
def preservation(spark, sf_dir):
    df = rep.preservation(*_both(spark, sf_dir))
    return df.select("n_population", "n_sample", *rounded([c for c in df.columns if not c.startswith("n_")]))


@query("age_band_means", f"""WITH {CATEGORY},
bands(position, age_band) AS (VALUES (0, '18-35'), (1, '36-50'), (2, '51-65'), (3, '65+'), (4, 'Unknown')),
p AS (SELECT age_group, avg(prediction) AS population_prediction, avg(probability) AS population_probability FROM population GROUP BY 1),
s AS (SELECT age_group, avg(prediction) AS sample_prediction, avg(probability) AS sample_probability FROM sample GROUP BY 1)
SELECT position, age_band, round(coalesce(population_prediction, 0), 6) AS population_prediction,
       round(coalesce(population_probability, 0), 6) AS population_probability,
       round(coalesce(sample_prediction, 0), 6) AS sample_prediction, round(coalesce(sample_probability, 0), 6) AS sample_probability
FROM bands LEFT JOIN p ON p.age_group = age_band LEFT JOIN s ON s.age_group = age_band WHERE p.age_group IS NOT NULL OR s.age_group IS NOT NULL""")
def age_band_means(spark, sf_dir):
    df = rep.age_band_means(*_both(spark, sf_dir), age_band(F.col("age")))
    return df.select("position", "age_band", *rounded([c for c in df.columns if "_pr" in c]))


@query("shuffled_rows", f"""WITH {POPULATION} SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS position FROM population""")
def shuffled_rows(spark, sf_dir):
    """Rows in reproducible random order, numbered without a global sort."""
    from decision_lens.functions.sampling import number_by_hash
    return number_by_hash(population(spark, sf_dir), "row_id", name="position").select("row_id", "position")


@query("sample_or_all", f"""WITH {POPULATION}
SELECT 'all' AS kind, row_id FROM population UNION ALL SELECT 'random', row_id FROM (SELECT row_id FROM population ORDER BY h, row_id LIMIT 40)""")
def sample_or_all(spark, sf_dir):
    """All rows where no size is asked for, a random sample where clusters are unknown."""
    rows = population(spark, sf_dir)
    return (ops.sample_or_all(rows, "row_id", None, False).select(F.lit("all").alias("kind"), "row_id")
            .unionByName(ops.sample_or_all(rows, "row_id", 40, False).select(F.lit("random").alias("kind"), "row_id")))
