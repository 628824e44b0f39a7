"""Queries over report tables."""

from pyspark.sql import functions as F

from decision_lens.operators import metrics as M, reports as R
from decision_lens.operators import similarity as sim
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.explanation_data import ACT, EXPLANATIONS, JUDGED, graded
from decision_lens.plans.explanations import (_IMM_HITS, _TECH_HITS, CHECK, GRADED, MODELS, VERIFIED, _texts, long_graded)
from decision_lens.plans.models import WEAKENED, partly_weakened
from decision_lens.plans.registry import query
from decision_lens.plans.similarity import EMBEDDED, embedded
from decision_lens.schemas import CHECKLIST_ITEMS
from decision_lens.session import stage


def _pivot(value: str, models=MODELS) -> str:
    return ", ".join(f"{value.format(m=m)} AS \"{m}\"" for m in models)


@query("metric_by_llm", f"""WITH {GRADED}
SELECT metric, {_pivot("round(avg(value) FILTER (llm_name = '{m}'), 6)")} FROM long_metrics GROUP BY 1""")
def metric_by_llm(spark, sf_dir):
    table = R.metric_table(long_graded(spark, sf_dir), MODELS)
    return table.select("metric", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in MODELS])


@query("suggestion_totals", f"""WITH {JUDGED}, {VERIFIED}
SELECT llm_name, count(cf_flipped) AS evaluated, count(*) FILTER (cf_skipped) AS skipped, count(*) FILTER (cf_flipped) AS flipped,
       round(avg(cf_flipped::INTEGER), 6) AS success_rate, round(avg(cf_probability_change), 6) AS mean_change
FROM cfv GROUP BY ROLLUP (llm_name)""")
def suggestion_totals(spark, sf_dir):
    df = graded(spark, sf_dir, []).filter("match_status = 'matched'")
    return R.suggestion_totals(df).select("llm_name", "evaluated", "skipped", "flipped", *rounded(["success_rate", "mean_change"]))


@query("relative_flip_rate", f"""WITH {JUDGED}, {VERIFIED}, {WEAKENED},
base AS (SELECT avg(flipped::INTEGER) AS rate FROM weakened WHERE prediction = 1 AND cf_index = 1)
SELECT llm_name, round(avg(cf_flipped::INTEGER), 6) AS flip_rate, round(avg(cf_flipped::INTEGER) / any_value(rate), 6) AS relative_flip_rate
FROM cfv, base GROUP BY 1""")
def relative_flip_rate(spark, sf_dir):
    """Against counterfactuals of which some fail, so that the base is not 1."""
    from decision_lens.operators import counterfactual as cfs
    df = graded(spark, sf_dir, []).filter("match_status = 'matched'")
    base = cfs.flip_rates(cfs.verify_each(partly_weakened(spark, sf_dir), A.FROZEN, ["prediction_id"])).filter("cf_index = 1")
    base = base.select(F.col("flip_rate").alias("base_rate"), F.lit(1).alias("one"))
    rows = df.withColumn("one", F.lit(1)).join(F.broadcast(base), "one", "left")
    return R.relative_flip_rate(rows, F.max("base_rate")).select("llm_name", *rounded(["flip_rate", "relative_flip_rate"]))


@query("probability_change_by_llm", f"""WITH {JUDGED}, {VERIFIED}
SELECT llm_name, count(cf_probability_change) AS n, round(avg(abs(cf_probability_change)), 6) AS mean,
       round(stddev_samp(abs(cf_probability_change)), 6) AS std FROM cfv GROUP BY 1""")
def probability_change_by_llm(spark, sf_dir):
    df = graded(spark, sf_dir, []).filter("match_status = 'matched'")
    return R.by_generator(df, F.abs("cf_probability_change")).select("llm_name", "n", *rounded(["mean", "std"]))


_DESCRIBED = ", ".join(f"({i}, '{d}')" for i, d in CHECKLIST_ITEMS)


@query("cemat_items", f"""WITH {JUDGED}, {CHECK},
names(i, description) AS (VALUES {_DESCRIBED}),
long AS (SELECT llm_name, i AS position, 'Item ' || i AS item, description, CASE WHEN i >= {ACT[0]} THEN 'Actionability' ELSE 'Understandability' END AS category,
                CASE WHEN v <> 2 THEN v::DOUBLE END AS value FROM items JOIN names USING (i)
         UNION ALL SELECT llm_name, -2, 'Overall', 'Overall CEMAT Score', 'Overall Score',
                (understandability_earned + actionability_earned) / greatest(1, understandability_applicable + actionability_applicable) FROM paired JOIN checks USING (doc_id)
         UNION ALL SELECT llm_name, -1, 'Overall', 'Overall Understandability', 'Overall Score', understandability_earned / greatest(1, understandability_applicable) FROM paired JOIN checks USING (doc_id)
         UNION ALL SELECT llm_name, 0, 'Overall', 'Overall Actionability', 'Overall Score', actionability_earned / greatest(1, actionability_applicable) FROM paired JOIN checks USING (doc_id))
SELECT position, item, description, category, {_pivot("coalesce(printf('%.3f', avg(value) FILTER (llm_name = '{m}')), 'N/A')")}
FROM long GROUP BY 1, 2, 3, 4""")
def cemat_items(spark, sf_dir):
    return R.checklist_table(graded(spark, sf_dir, ["checklist"]).filter("match_status = 'matched'"), MODELS)


@query("regulatory_means", f"""WITH {JUDGED} SELECT 'principal_reason_identification' AS "column", round(avg(principal_reason_identification), 6) AS mean FROM markers
UNION ALL SELECT 'individual_specific_content', round(avg(individual_specific_content), 6) FROM markers
UNION ALL SELECT 'technical_jargon_check', round(avg(technical_jargon_check), 6) FROM markers""")
def regulatory_means(spark, sf_dir):
    df = graded(spark, sf_dir, []).filter("match_status = 'matched'")
    return R.column_means(df, ["principal_reason_identification", "individual_specific_content", "technical_jargon_check"]).select(
        "column", *rounded(["mean"]))


@query("mention_counts", f"""WITH {EXPLANATIONS}, m AS (SELECT llm_name, unnest({_TECH_HITS}) AS feature FROM explanations)
SELECT llm_name, feature, count(*) AS n FROM m GROUP BY 1, 2""")
def mention_counts(spark, sf_dir):
    df = M.evaluate(_texts(spark, sf_dir), ["technical"])
    return R.mention_counts(df, F.col("technical_mentions"))


@query("mention_pivot", f"""WITH {EXPLANATIONS}, m AS (SELECT llm_name, split_part(unnest({_IMM_HITS}), ':', 1) AS feature FROM explanations),
t AS (SELECT llm_name, count(*) AS texts FROM explanations GROUP BY 1),
c AS (SELECT llm_name, feature, round(100.0::DOUBLE * count(*) / any_value(texts), 1) AS share FROM m JOIN t USING (llm_name) GROUP BY 1, 2)
SELECT feature, {_pivot("coalesce(max(share) FILTER (llm_name = '{m}'), 0)")} FROM c GROUP BY 1""")
def mention_pivot(spark, sf_dir):
    df = M.evaluate(_texts(spark, sf_dir), ["immutable"])
    return R.mention_pivot(df, F.transform("immutable_mentions", lambda m: m["feature"]), MODELS)


@query("many_mentions", f"""WITH {A.SCORED}, {EXPLANATIONS},
r AS (SELECT llm_name, explanation_id, len({_IMM_HITS}) AS n, row_number() OVER (PARTITION BY llm_name ORDER BY explanation_id) AS rn
      FROM explanations JOIN scored USING (prediction_id) WHERE prediction = 1 AND len({_IMM_HITS}) > 1)
SELECT llm_name, explanation_id, n FROM r WHERE rn <= 3""")
def many_mentions(spark, sf_dir):
    predictions = A.scored_applicants(spark, sf_dir).select("prediction_id", "prediction")
    df = stage(M.evaluate(M.match(_texts(spark, sf_dir), predictions), ["immutable"]).select(
        "llm_name", "explanation_id", "prediction", "immutable_mentions"))
    return R.many_mentions(df, "immutable_mentions").select(
        "llm_name", "explanation_id", F.size("immutable_mentions").cast("long").alias("n"))


@query("examples", f"""WITH {A.SCORED}, {EXPLANATIONS},
r AS (SELECT llm_name, CASE WHEN prediction = 1 THEN 'declined' WHEN prediction = 0 THEN 'approved' ELSE 'unknown' END AS outcome, explanation_id,
             row_number() OVER (PARTITION BY llm_name, prediction ORDER BY explanation_id) AS rn
      FROM explanations LEFT JOIN scored USING (prediction_id))
SELECT llm_name, outcome, explanation_id FROM r WHERE rn = 1""")
def examples(spark, sf_dir):
    from decision_lens.functions.columns import outcome
    from decision_lens.plans.explanation_data import explanations
    predictions = A.scored_applicants(spark, sf_dir).select("prediction_id", "prediction")
    df = M.match(explanations(spark, sf_dir), predictions).withColumn("outcome", outcome(F.col("prediction")))
    return M.first_examples(df, ["llm_name", "outcome"], "explanation_id").select("llm_name", "outcome", "explanation_id")


@query("similarity_table", f"""WITH {EMBEDDED}
SELECT outcome, pair_class, list_position(['same_instance', 'intra_cluster', 'inter_cluster', 'random_baseline'], pair_class) AS position,
       {_pivot("coalesce(printf('%.3f', max(mean) FILTER (llm_name = '{m}' AND count > 0)), 'N/A')", ["gen-0", "gen-1"])}
FROM full_stats WHERE grouping = 'by_llm_outcome' GROUP BY 1, 2""")
def similarity_table(spark, sf_dir):
    return R.similarity_table(sim.moment_stats(embedded(spark, sf_dir)), ["gen-0", "gen-1"])


_TIMES = ", ".join(f"round({c}, {d}) AS {c}" for c, d in (("mean", 6), ("std", 6), ("median", 6), ("total_seconds", 4), ("total_hours", 6)))


@query("time_by_llm", f"""WITH t AS (SELECT 'gen-' || event_type AS llm_name, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       max(value) AS max, median(value) AS median, sum(value) AS total_seconds, sum(value) / 3600 AS total_hours FROM events GROUP BY 1)
SELECT llm_name, count, min, max, {_TIMES} FROM t""")
def time_by_llm(spark, sf_dir):
    log = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("gen-"), "event_type").alias("llm_name"), F.col("value").alias("processing_time"))
    return R.time_table(log).select("llm_name", "count", "min", "max", *rounded(["mean", "std", "median"]),
                                    *rounded(["total_seconds"], 4), *rounded(["total_hours"]))


@query("score_means", f"""WITH {JUDGED}, {VERIFIED} SELECT 'cf_score' AS "column", round(avg(cf_score), 6) AS mean FROM cfv""")
def score_means(spark, sf_dir):
    df = graded(spark, sf_dir, []).filter("match_status = 'matched'")
    return R.score_means(df).select("column", *rounded(["mean"]))


@query("ordered_times", """SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def ordered_times(spark, sf_dir):
    counts = A.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.in_order(counts, "event_type", ["view", "click", "purchase"])


@query("time_boxes", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
m AS (SELECT *, value BETWEEN q25 - 1.5::DOUBLE * (q75 - q25) AND q75 + 1.5::DOUBLE * (q75 - q25) AS inside FROM events JOIN q USING (event_type))
SELECT event_type, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, min(value) FILTER (inside) AS whisker_low,
       max(value) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM m GROUP BY event_type, q25, median, q75""")
def time_boxes(spark, sf_dir):
    from decision_lens.operators.profiling import box_numbers
    df = A.table(spark, sf_dir, "events").select("event_type", "value")
    return box_numbers(df, ["value"], by=("event_type",)).select(
        "event_type", *rounded(["q25", "median", "q75"]), "whisker_low", "whisker_high", "outliers")


