"""Queries over pairwise similarity."""

from pyspark.sql import functions as F

from decision_lens.operators import similarity as ops
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.registry import query
from decision_lens.session import stage


def embedded(spark, sf_dir):
    v = F.col("vec_id")
    prediction = F.expr("vec_id div 6")
    df = A.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("app-"), prediction.cast("string")).alias("prediction_id"),
        (v % 3).cast("int").alias("regeneration_number"),
        F.concat(F.lit("gen-"), (F.expr("vec_id div 3") % 2).cast("string")).alias("llm_name"),
        F.when(prediction % 17 != 0, (prediction % 4).cast("int")).alias("cluster_id"),
        F.when(prediction % 2 == 1, "declined").otherwise("approved").alias("outcome"), "embedding")
    return stage(ops.unit(df))


EMBEDDED = """vectors AS (SELECT vec_id, vec_id // 6 AS p, vec_id % 3 AS r, 'gen-' || ((vec_id // 3) % 2) AS llm_name,
  CASE WHEN (vec_id // 6) % 17 <> 0 THEN ((vec_id // 6) % 4)::INTEGER END AS c,
  CASE WHEN (vec_id // 6) % 2 = 1 THEN 'declined' ELSE 'approved' END AS outcome, embedding::DOUBLE[] AS e FROM embeddings),
units AS (SELECT *, list_transform(e, lambda x: coalesce(x / nullif(sqrt(list_inner_product(e, e)), 0), 0)) AS u FROM vectors),
pairs AS (SELECT list_inner_product(a.u, b.u) AS v, a.llm_name AS l1, b.llm_name AS l2, a.outcome AS o1, b.outcome AS o2, a.c AS c1, b.c AS c2,
                 a.p AS p1, b.p AS p2, a.r AS r1, b.r AS r2
          FROM units a JOIN units b ON a.vec_id < b.vec_id),
classed AS (SELECT *, 'random_baseline' AS pair_class FROM pairs
            UNION ALL SELECT *, 'same_instance' FROM pairs WHERE p1 = p2 AND r1 <> r2
            UNION ALL SELECT *, 'intra_cluster' FROM pairs WHERE p1 <> p2 AND c1 = c2
            UNION ALL SELECT *, 'inter_cluster' FROM pairs WHERE p1 <> p2 AND c1 <> c2),
sided AS (SELECT 'overall' AS grouping, '*' AS llm_name, '*' AS outcome, * FROM classed
          UNION ALL SELECT 'by_llm', l1, '*', * FROM classed WHERE l1 = l2
          UNION ALL SELECT 'by_outcome', '*', o1, * FROM classed WHERE o1 = o2
          UNION ALL SELECT 'by_llm_outcome', l1, o1, * FROM classed WHERE l1 = l2 AND o1 = o2),
stats AS (SELECT grouping, llm_name, outcome, pair_class, count(*) AS count, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median,
                 min(v) AS min, max(v) AS max FROM sided GROUP BY ALL),
sizes AS (SELECT 'overall' AS grouping, '*' AS llm_name, '*' AS outcome, count(*) AS n FROM units GROUP BY ALL UNION ALL
          SELECT 'by_llm', llm_name, '*', count(*) FROM units GROUP BY ALL UNION ALL
          SELECT 'by_outcome', '*', outcome, count(*) FROM units GROUP BY ALL UNION ALL
          SELECT 'by_llm_outcome', llm_name, outcome, count(*) FROM units GROUP BY ALL),
classes(pair_class) AS (VALUES ('same_instance'), ('intra_cluster'), ('inter_cluster'), ('random_baseline')),
full_stats AS (SELECT s.grouping, s.llm_name, s.outcome, c.pair_class, coalesce(count, 0) AS count, mean, std, median, min, max
               FROM sizes s CROSS JOIN classes c LEFT JOIN stats USING (grouping, llm_name, outcome, pair_class) WHERE n >= 2)"""
_KEYS = "grouping, llm_name, outcome, pair_class, count"


@query("moment_stats", f"WITH {EMBEDDED} SELECT {_KEYS}, round(mean, 6) AS mean, round(std, 6) AS std FROM full_stats")
def moment_stats(spark, sf_dir):
    return ops.moment_stats(embedded(spark, sf_dir)).select(*ops.GROUP, "pair_class", "count", *rounded(["mean", "std"]))


@query("pair_stats_grouped", f"""WITH {EMBEDDED}
SELECT {_KEYS}, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max FROM full_stats""")
def pair_stats_grouped(spark, sf_dir):
    return ops.pair_stats(embedded(spark, sf_dir)).select(
        *ops.GROUP, "pair_class", "count", *rounded(["mean", "std", "median", "min", "max"]))


@query("per_cluster_similarity", f"""WITH {EMBEDDED}
SELECT c1 AS cluster_id, pair_class, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median,
       round(min(v), 6) AS min, round(max(v), 6) AS max FROM classed WHERE pair_class = 'intra_cluster' GROUP BY ALL""")
def per_cluster_similarity(spark, sf_dir):
    df = embedded(spark, sf_dir)
    placed = df.filter("cluster_id is not null")
    ordered = ops.order_stats(placed, ["cluster_id"], ["intra_cluster"])
    return ops.cluster_moments(df).join(ordered, ["cluster_id", "pair_class"], "left").select(
        "cluster_id", "pair_class", "count", *rounded(["mean", "std", "median", "min", "max"]))


@query("consistency", f"""WITH {EMBEDDED}
SELECT grouping, llm_name, outcome, round((max(mean) FILTER (pair_class = 'intra_cluster') - max(mean) FILTER (pair_class = 'inter_cluster'))
       / nullif(max(std) FILTER (pair_class = 'random_baseline'), 0), 6) AS consistency FROM full_stats GROUP BY ALL""")
def consistency(spark, sf_dir):
    return ops.consistency(ops.moment_stats(embedded(spark, sf_dir))).select(*ops.GROUP, *rounded(["consistency"]))


@query("hierarchy", f"""WITH {EMBEDDED}
SELECT grouping, llm_name, outcome, string_agg(pair_class, '|' ORDER BY mean DESC) AS ranking,
       string_agg(pair_class, '|' ORDER BY mean DESC) = 'same_instance|intra_cluster|inter_cluster|random_baseline' AS order_correct
FROM full_stats WHERE count > 0 GROUP BY ALL""")
def hierarchy(spark, sf_dir):
    return ops.hierarchy(ops.moment_stats(embedded(spark, sf_dir))).select(
        *ops.GROUP, F.array_join("ranking", "|").alias("ranking"), "order_correct")


@query("similarity_run", f"""WITH {EMBEDDED}
SELECT 'ok' AS status, (SELECT count(*) FROM embeddings) AS n_given, (SELECT count(*) FROM units) AS n_used, (SELECT max(len(u)) FROM units)::INTEGER AS dimension,
  (SELECT count(DISTINCT p) FROM units) AS n_predictions, (SELECT count(DISTINCT c) FROM units) AS n_clusters, grouping, llm_name, outcome, pair_class, count,
  round(mean, 6) AS mean, round(median, 6) AS median, round((SELECT (max(mean) FILTER (pair_class = 'intra_cluster') - max(mean) FILTER (pair_class = 'inter_cluster'))
    / nullif(max(std) FILTER (pair_class = 'random_baseline'), 0) FROM full_stats WHERE grouping = 'overall'), 6) AS consistency,
  (SELECT string_agg(pair_class, '|' ORDER BY mean DESC) = 'same_instance|intra_cluster|inter_cluster|random_baseline' FROM full_stats WHERE grouping = 'overall' AND count > 0) AS order_correct
FROM full_stats""")
def similarity_run(spark, sf_dir):
    """The record of a run, its figures as rows."""
    record = ops.run_record(embedded(spark, sf_dir))
    return record.select("status", "n_given", "n_used", "dimension", "n_predictions", "n_clusters", F.inline("stats"), *rounded(["consistency"]), "order_correct").select(
        "status", "n_given", "n_used", "dimension", "n_predictions", "n_clusters", "grouping", "llm_name", "outcome", "pair_class", "count", *rounded(["mean", "median"]), "consistency", "order_correct")
