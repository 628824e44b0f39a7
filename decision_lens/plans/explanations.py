"""Queries over work lists, salvage and explanation metrics."""

from pyspark.sql import functions as F

from decision_lens.operators import metrics as M, salvage, verification, worklist as W
from decision_lens.plans import adapters as A
from decision_lens.plans.cleaning import rounded
from decision_lens.plans.explanation_data import (EXPLANATIONS, JUDGED, explanations, graded,
                                                  judge_output, predictions_for_grading)
from decision_lens.plans.models import ATTRIBUTED, COUNTERFACTUALS, attributed, explained
from decision_lens.plans.registry import query
from decision_lens.plans.sampling import hash_sql
from decision_lens.schemas import CF_SENTENCES, FEATURE_COLUMNS, FRIENDLY, IMMUTABLE_COLUMNS, IMMUTABLE_TERMS, TARGET_ROUNDING, TECHNICAL, TECHNICAL_OF_FRIENDLY

MODELS = ["gen-de", "gen-en", "gen-es", "gen-fr"]
_LIST = ", ".join(f"'{m}'" for m in MODELS)
WORK = f"""work AS (SELECT prediction_id, llm_name, n::INTEGER AS regeneration_number, prediction_id || '_exp_' || n || '_' || llm_name AS explanation_id
         FROM (SELECT 'app-' || c_custkey AS prediction_id FROM customer), (SELECT unnest([{_LIST}]) AS llm_name), (SELECT unnest([1, 2, 3]) AS n))"""


def _work(spark, sf_dir):
    ids = A.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("app-"), F.col("c_custkey").cast("string")).alias("prediction_id"))
    return W.work_list(ids, MODELS, 3)


@query("work_list", f"WITH {WORK} SELECT * FROM work")
def work_list(spark, sf_dir):
    return _work(spark, sf_dir)


@query("work_list_resume", f"""WITH {WORK}, {EXPLANATIONS}
SELECT work.* FROM work ANTI JOIN explanations USING (explanation_id)""")
def work_list_resume(spark, sf_dir):
    return W.remaining(_work(spark, sf_dir), explanations(spark, sf_dir))


_FRIENDLY_SQL = "CASE {f} " + " ".join(f"WHEN '{TECHNICAL[c]}' THEN '{FRIENDLY[c]}'" for c in FRIENDLY) + " ELSE {f} END"
SHAP_TEXT = f"""shap AS (SELECT prediction_id, string_agg({_FRIENDLY_SQL.format(f='feature')} || ': ' || printf('%.4f', phi), chr(10)
                          ORDER BY abs(phi) DESC, feature) AS attributions FROM phi GROUP BY 1)"""
_STEP = "CASE feature " + " ".join(
    f"WHEN '{TECHNICAL[c]}' THEN {'ceil' if d == 'up' else 'floor'}(to_value / {s!r}::DOUBLE) * {s!r}::DOUBLE"
    for c, (d, s) in TARGET_ROUNDING.items()) + " ELSE to_value END"
CF_TEXT = f"""cft AS (SELECT prediction_id, 'Scenario 1:' || chr(10) || string_agg({_FRIENDLY_SQL.format(f='feature')} || ': ' ||
         printf('%.6f', from_value) || ' → ' || printf('%.2f', {_STEP}) || printf(' (change: %+.4f)', diff), chr(10)
         ORDER BY list_position([{", ".join(repr(t) for t in TECHNICAL.values())}], feature)) AS alternatives
       FROM changes WHERE cf_index = 1 GROUP BY 1)"""


@query("shap_text", f"WITH {ATTRIBUTED}, {SHAP_TEXT} SELECT * FROM shap")
def shap_text(spark, sf_dir):
    return attributed(spark, sf_dir).select("prediction_id", W.attribution_text().alias("attributions"))


@query("cf_text", f"""WITH {COUNTERFACTUALS}, {CF_TEXT}
SELECT prediction_id, coalesce(alternatives, 'No counterfactual scenarios available.') AS alternatives FROM scored LEFT JOIN cft USING (prediction_id)""")
def cf_text(spark, sf_dir):
    return explained(spark, sf_dir).select("prediction_id", W.counterfactual_text(F.col("counterfactuals")).alias("alternatives"))


_VALUES = " || chr(10) || ".join(f"'{FRIENDLY[c]}: ' || printf('%.6f', coalesce({c}, 0))" for c in W.PROMPT_VALUES)


@query("prompt_table", f"""WITH {COUNTERFACTUALS}, {SHAP_TEXT}, {CF_TEXT}
SELECT prediction_id, CASE WHEN prediction = 1 THEN 'declined' ELSE 'approved' END AS prediction_outcome,
       md5('The application was ' || CASE WHEN prediction = 1 THEN 'declined' ELSE 'approved' END || '.' || chr(10) || chr(10) || {_VALUES}
           || chr(10) || chr(10) || 'Influence of each value:' || chr(10) || attributions || chr(10) || chr(10)
           || 'What would change the decision:' || chr(10) || coalesce(alternatives, 'No counterfactual scenarios available.')) AS prompt_md5
FROM scored JOIN shap USING (prediction_id) LEFT JOIN cft USING (prediction_id)""")
def prompt_table(spark, sf_dir):
    return W.explanation_prompt(explained(spark, sf_dir)).select(
        "prediction_id", "prediction_outcome", F.md5("prompt").alias("prompt_md5"))


@query("judge_requests", f"""WITH {A.SCORED}, {EXPLANATIONS},
n AS (SELECT *, row_number() OVER (ORDER BY {hash_sql("explanation_id")}, explanation_id) AS rn FROM explanations)
SELECT 'request-' || rn AS key, n.prediction_id, llm_name, explanation_id,
       CASE WHEN prediction = 1 THEN 'DECLINED' ELSE 'APPROVED' END AS decision FROM n JOIN scored USING (prediction_id)""")
def judge_requests(spark, sf_dir):
    requests = W.judge_requests(explanations(spark, sf_dir), A.scored_applicants(spark, sf_dir))
    text = F.col("request.contents")[0]["parts"][0]["text"]
    return requests.select("key", "custom_metadata.*", F.regexp_extract(text, "^Decision: ([A-Z]+)", 1).alias("decision"))


# --- salvage ----------------------------------------------------------------------------
@query("salvaged_responses", f"""WITH {EXPLANATIONS}
SELECT explanation_id, doc_id, parse_stage, CASE WHEN parse_stage <> 'failed' THEN md5(body) END AS text_md5,
       array_to_string(listed, '|') AS top_features FROM explanations""")
def salvaged_responses(spark, sf_dir):
    df = salvage.salvage_responses(explanations(spark, sf_dir))
    return df.select("explanation_id", "doc_id", "parse_stage", F.md5("consumer_explanation").alias("text_md5"),
                     F.array_join("top_features", "|").alias("top_features"))


@query("quarantine_counts", f"WITH {EXPLANATIONS} SELECT parse_stage, count(*) AS n FROM explanations GROUP BY 1")
def quarantine_counts(spark, sf_dir):
    return salvage.salvage_responses(explanations(spark, sf_dir)).groupBy("parse_stage").agg(F.count(F.lit(1)).alias("n"))


@query("quarantined", f"WITH {EXPLANATIONS} SELECT explanation_id, md5(body) AS text_md5 FROM explanations WHERE parse_stage = 'failed'")
def quarantined(spark, sf_dir):
    return salvage.quarantine(salvage.salvage_responses(explanations(spark, sf_dir))).select(
        "explanation_id", F.md5("explanation_text").alias("text_md5"))


@query("flattened_explanations", f"""WITH {EXPLANATIONS}
SELECT explanation_id, llm_name, round(processing_time, 3) AS processing_time, parse_stage <> 'failed' AS explanation_parsed,
       len(listed) AS n_features FROM explanations""")
def flattened_explanations(spark, sf_dir):
    return salvage.flatten_explanations(explanations(spark, sf_dir)).select(
        "explanation_id", "llm_name", F.round("processing_time", 3).alias("processing_time"), "explanation_parsed",
        F.size("analysis_top_features").cast("long").alias("n_features"))


@query("stored_text", f"""WITH {EXPLANATIONS}
SELECT explanation_id, md5(CASE WHEN parse_stage = 'failed' THEN body ELSE body END) AS consumer_md5 FROM explanations""")
def stored_text(spark, sf_dir):
    df = salvage.salvage_responses(explanations(spark, sf_dir))
    stored = df.withColumn("stored", salvage.one_line_json(df))
    return stored.select("explanation_id", F.md5(salvage.consumer_text(F.col("stored"))).alias("consumer_md5"))


@query("run_summary", """SELECT 'gen-' || (user_id % 4) AS llm_name, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok,
       count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ROLLUP (1)""")
def run_summary(spark, sf_dir):
    log = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("gen-"), (F.col("user_id") % 4).cast("string")).alias("llm_name"), "event_type")
    return salvage.run_summary(log, F.col("event_type") == "error")


@query("judge_records", f"""WITH {JUDGED}
SELECT explanation_id, doc_id, m.principal_reason_identification, m.individual_specific_content, m.technical_jargon_check,
       CASE WHEN doc_id % 37 = 5 THEN 'marker out of range' END AS violation,
       CASE doc_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' ELSE 'tidied' END AS parse_stage,
       (SELECT count(*) FROM suggested s WHERE s.doc_id = paired.doc_id AND feature IS NOT NULL)
         + CASE WHEN doc_id % 20 IN (7, 9) THEN 1 ELSE 0 END AS n_changes
FROM paired JOIN markers m USING (doc_id)""")
def judge_records(spark, sf_dir):
    judged = salvage.salvage_judgements(judge_output(explanations(spark, sf_dir), predictions_for_grading(spark, sf_dir)))
    return judged.select("explanation_id", "doc_id", "principal_reason_identification", "individual_specific_content",
                         "technical_jargon_check", "violation", "parse_stage",
                         F.size("changes").cast("long").alias("n_changes"))


# --- metrics ----------------------------------------------------------------------------
@query("match_status", f"""WITH {A.APPLICANTS}, {EXPLANATIONS}
SELECT CASE WHEN row_id2 IS NULL THEN 'no_prediction' ELSE 'matched' END AS match_status, count(*) AS n
FROM explanations LEFT JOIN (SELECT 'app-' || row_id AS prediction_id, row_id AS row_id2 FROM applicants) USING (prediction_id) GROUP BY 1""")
def match_status(spark, sf_dir):
    df = M.match(explanations(spark, sf_dir), A.scored_applicants(spark, sf_dir).select("prediction_id", "prediction"))
    return df.groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))


_CHECK = ["understandability_earned", "understandability_applicable", "actionability_earned", "actionability_applicable"]
CHECK = f"""checks AS (SELECT doc_id, count(*) FILTER (i < 20 AND v = 1) AS understandability_earned, count(*) FILTER (i < 20 AND v <> 2) AS understandability_applicable,
          count(*) FILTER (i >= 20 AND v = 1) AS actionability_earned, count(*) FILTER (i >= 20 AND v <> 2) AS actionability_applicable FROM items GROUP BY 1)"""


@query("cemat_scores", f"""WITH {JUDGED}, {CHECK}
SELECT explanation_id, doc_id, {", ".join(_CHECK)}, round(understandability_earned / greatest(1, understandability_applicable), 6) AS understandability_score,
       round(actionability_earned / greatest(1, actionability_applicable), 6) AS actionability_score,
       round((understandability_earned + actionability_earned) / greatest(1, understandability_applicable + actionability_applicable), 6) AS overall_score
FROM paired JOIN checks USING (doc_id)""")
def cemat_scores(spark, sf_dir):
    judged = salvage.salvage_judgements(judge_output(explanations(spark, sf_dir), predictions_for_grading(spark, sf_dir)))
    scored = judged.select("explanation_id", "doc_id", M.checklist(
        F.col("understandability_items"), F.col("actionability_items")).alias("c")).select("explanation_id", "doc_id", "c.*")
    return scored.select("explanation_id", "doc_id", *[F.col(c).cast("long").alias(c) for c in _CHECK],
                         *rounded(["understandability_score", "actionability_score", "overall_score"]))


def _texts(spark, sf_dir):
    df = salvage.salvage_responses(explanations(spark, sf_dir))
    return df.withColumn("consumer_text", F.coalesce("consumer_explanation", "explanation_text"))


READ = """counted AS (SELECT explanation_id, doc_id, llm_name, len(regexp_extract_all(body, '[^ \\t\\n\\r]+'))::DOUBLE AS w,
          greatest(1, len(regexp_extract_all(body, '[.!?]+')))::DOUBLE AS s, len(regexp_extract_all(body, '[aeiouyAEIOUY]+'))::DOUBLE AS v FROM explanations),
ease AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (greatest(w, v) / w) AS e,
         0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (greatest(w, v) / w) - 15.59::DOUBLE AS g FROM counted WHERE w > 0)"""


@query("readability", f"""WITH {EXPLANATIONS}, {READ}
SELECT explanation_id, doc_id, round(least(100, greatest(0, e)) / 100, 6) AS score, round(e, 6) AS flesch_reading_ease,
       round(g, 6) AS flesch_kincaid_grade FROM ease""")
def readability(spark, sf_dir):
    df = M.evaluate(_texts(spark, sf_dir), ["readability"]).filter("readability is not null")
    return df.select("explanation_id", "doc_id", "readability.*").select(
        "explanation_id", "doc_id", *rounded(["score", "flesch_reading_ease", "flesch_kincaid_grade"]))


def _bounded_sql(term):
    escaped = term.replace("-", "\\-")
    return f"regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_]){escaped}($|[^\\p{{L}}\\p{{N}}_])')"


_TECH_HITS = "list_filter([" + ", ".join(
    f"CASE WHEN {_bounded_sql(n.lower())} THEN '{n}' END" for n in M.TECHNICAL_NAMES) + "], lambda x: x IS NOT NULL)"
_IMM_HITS = "list_filter([" + ", ".join(
    "CASE " + " ".join(f"WHEN {('contains(lower(body), ' + repr(t) + ')') if ' ' in t else _bounded_sql(t)} THEN '{f}:{t}'"
                       for t in terms) + " END" for f, terms in IMMUTABLE_TERMS) + "], lambda x: x IS NOT NULL)"


@query("technical_mentions", f"""WITH {EXPLANATIONS}
SELECT explanation_id, doc_id, len({_TECH_HITS}) AS count, array_to_string({_TECH_HITS}, '|') AS found_features FROM explanations""")
def technical_mentions(spark, sf_dir):
    df = M.evaluate(_texts(spark, sf_dir), ["technical"])
    return df.select("explanation_id", "doc_id", F.size("technical_mentions").cast("long").alias("count"),
                     F.array_join("technical_mentions", "|").alias("found_features"))


@query("immutable_mentions", f"""WITH {EXPLANATIONS}
SELECT explanation_id, doc_id, len({_IMM_HITS}) AS count, array_to_string({_IMM_HITS}, '|') AS mentioned FROM explanations""")
def immutable_mentions(spark, sf_dir):
    df = M.evaluate(_texts(spark, sf_dir), ["immutable"])
    text = F.array_join(F.transform("immutable_mentions", lambda m: F.concat(m["feature"], F.lit(":"), m["term_found"])), "|")
    return df.select("explanation_id", "doc_id", F.size("immutable_mentions").cast("long").alias("count"), text.alias("mentioned"))


@query("regulatory", f"""WITH {JUDGED}
SELECT explanation_id, doc_id, m.principal_reason_identification, m.individual_specific_content, m.technical_jargon_check,
       len(list_filter([{", ".join(repr(n.lower()) for n in M.TECHNICAL_NAMES)}], lambda n: contains(lower(body), n))) AS feature_name_matching
FROM paired JOIN markers m USING (doc_id)""")
def regulatory(spark, sf_dir):
    return graded(spark, sf_dir, ["regulatory"]).filter("match_status = 'matched'").select(
        "explanation_id", "doc_id", "principal_reason_identification", "individual_specific_content",
        "technical_jargon_check", F.col("feature_name_matching").cast("long").alias("feature_name_matching"))


_TO_TECH = "CASE x " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in TECHNICAL_OF_FRIENDLY.items()) + " ELSE x END"
FIDELITY = f"""top5 AS (SELECT prediction_id, feature, row_number() OVER (PARTITION BY prediction_id ORDER BY abs(phi) DESC, feature) AS pos FROM phi
         QUALIFY pos <= 5),
spread AS (SELECT doc_id, prediction_id, unnest(listed) AS x, generate_subscripts(listed, 1) AS pos FROM explanations),
names AS (SELECT doc_id, prediction_id, {_TO_TECH} AS feature, min(pos) AS pos FROM spread GROUP BY ALL),
common AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY names.pos) - row_number() OVER (PARTITION BY doc_id ORDER BY top5.pos) AS d
           FROM names JOIN top5 USING (prediction_id, feature)),
agree AS (SELECT doc_id, count(*) AS n, sum(d * d)::BIGINT AS d2 FROM common GROUP BY 1),
fid AS (SELECT e.explanation_id, e.doc_id, e.llm_name, e.listed IS NULL AS empty, coalesce(n, 0) AS n,
               CASE WHEN n >= 2 THEN 1 - 6.0::DOUBLE * d2 / (n * (n * n - 1)) ELSE 0 END AS score
        FROM paired e LEFT JOIN agree USING (doc_id)),
tee AS (SELECT *, abs(score) * sqrt((n - 2) / nullif(1 - score * score, 0)) AS t FROM fid WHERE n >= 3)"""


@query("fidelity", f"""WITH {JUDGED}, {FIDELITY}
SELECT fid.explanation_id, fid.doc_id, round(fid.score, 6) AS score, CASE WHEN NOT fid.empty THEN fid.n END AS matching_features,
       CASE WHEN fid.empty THEN 'no features to compare' WHEN fid.n < 2 THEN 'insufficient common features' END AS error,
       round(CASE WHEN fid.n >= 3 THEN CASE WHEN abs(fid.score) >= 1 THEN 0 WHEN fid.n = 3 THEN 1 - 2 / pi() * atan(t)
             WHEN fid.n = 4 THEN 1 - t / sqrt(2 + t * t)
             ELSE 1 - 2 / pi() * (atan(t / sqrt(3)) + (t / sqrt(3)) / (1 + t * t / 3)) END END, 6) AS p_value
FROM fid LEFT JOIN tee USING (doc_id)""")
def fidelity(spark, sf_dir):
    df = graded(spark, sf_dir, ["fidelity"]).filter("match_status = 'matched'")
    return df.select("explanation_id", "doc_id", "fidelity.*").select(
        "explanation_id", "doc_id", *rounded(["score", "p_value"]),
        F.col("matching_features").cast("long").alias("matching_features"), "error")


_WS = "CASE feature " + " ".join(f"WHEN '{TECHNICAL[c]}' THEN {A.FROZEN.weights[c] / 1.0!r}::DOUBLE" for c in TECHNICAL) + " END"
_SS = "CASE feature " + " ".join(f"WHEN '{TECHNICAL[c]}' THEN {A.FROZEN.scale[c]!r}::DOUBLE" for c in TECHNICAL) + " END"
VERIFIED = f"""tried AS (SELECT explanation_id, doc_id, llm_name, prediction, probability, kind, any_value(n_changes) AS k, doc_id % 20 = 7 AS extra,
                 any_value(logit) + coalesce(sum({_WS} * ((target - from_value) / {_SS})), 0) AS z
          FROM suggested GROUP BY ALL),
verified AS (SELECT *, prediction = 0 AS cf_skipped, prediction = 1 AND (k > 0 OR extra) AS live, 1 / (1 + exp(-z)) AS p2 FROM tried),
cfv AS (SELECT explanation_id, doc_id, llm_name, cf_skipped, CASE WHEN live THEN z <= 0 END AS cf_flipped,
        CASE WHEN live THEN kind = 0 AND k > 0 AND NOT extra END AS cf_match,
        CASE WHEN live AND kind = 0 AND k > 0 AND NOT extra THEN 1 END AS cf_match_index,
        CASE WHEN live AND k = 0 THEN 0.0::DOUBLE WHEN live THEN round(p2 - probability, 4) END AS cf_probability_change,
        CASE WHEN cf_skipped THEN NULL WHEN NOT live THEN 0.0::DOUBLE WHEN z <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cf_score FROM verified)"""


@query("cf_verification", f"WITH {JUDGED}, {VERIFIED} SELECT * EXCLUDE (llm_name) FROM cfv")
def cf_verification(spark, sf_dir):
    df = graded(spark, sf_dir, []).filter("match_status = 'matched'")
    return df.select("explanation_id", "doc_id", "cf_skipped", "cf_flipped", "cf_match", "cf_match_index",
                     "cf_probability_change", "cf_score")


@query("unresolved_suggestions", f"""WITH {JUDGED} SELECT doc_id, 'credit score' AS feature_name FROM paired WHERE doc_id % 20 = 7""")
def unresolved_suggestions(spark, sf_dir):
    judged = salvage.salvage_judgements(judge_output(explanations(spark, sf_dir), predictions_for_grading(spark, sf_dir)))
    return verification.unresolved_names(judged, ["doc_id"])


@query("suggestion_baselines", f"""WITH {JUDGED}
SELECT doc_id, feature, round(from_value, 9) AS from_value, round(target, 9) AS to_value FROM suggested WHERE feature IS NOT NULL""")
def suggestion_baselines(spark, sf_dir):
    predictions = predictions_for_grading(spark, sf_dir)
    judged = salvage.salvage_judgements(judge_output(explanations(spark, sf_dir), predictions))
    rows = judged.join(explanations(spark, sf_dir).select("explanation_id", "prediction_id"), "explanation_id").join(predictions, "prediction_id")
    return verification.baselines(rows, ["doc_id"]).select(
        "doc_id", "feature", F.round("from", 9).alias("from_value"), F.round("to", 9).alias("to_value"))


METRIC_VALUES = {
    "cemat_overall": "checklist.overall_score", "cemat_understandability": "checklist.understandability_score",
    "cemat_actionability": "checklist.actionability_score", "principal_reason": "principal_reason_identification",
    "individual_specific": "individual_specific_content", "technical_jargon": "technical_jargon_check",
    "fidelity": "fidelity.score", "readability": "readability.score", "cf_score": "cf_score",
    "cf_flipped": "cf_flipped", "cf_probability_change": "cf_probability_change", "processing_time": "processing_time",
}


def long_graded(spark, sf_dir):
    df = graded(spark, sf_dir).filter("match_status = 'matched'")
    values = {n: F.col(c).cast("double") for n, c in METRIC_VALUES.items()}
    values["technical_mentions"] = F.size("technical_mentions").cast("double")
    values["immutable_mentions"] = F.size("immutable_mentions").cast("double")
    return M.long_metrics(df, values, ["llm_name"])


def _metric(name, expr, source):
    return f"SELECT llm_name, '{name}' AS metric, ({expr})::DOUBLE AS value FROM {source}"


GRADED = JUDGED + f", {CHECK}, {READ}, {FIDELITY}, {VERIFIED}, long_metrics AS (" + " UNION ALL ".join([
    _metric("cemat_overall", "(understandability_earned + actionability_earned) / greatest(1, understandability_applicable + actionability_applicable)", "paired JOIN checks USING (doc_id)"),
    _metric("cemat_understandability", "understandability_earned / greatest(1, understandability_applicable)", "paired JOIN checks USING (doc_id)"),
    _metric("cemat_actionability", "actionability_earned / greatest(1, actionability_applicable)", "paired JOIN checks USING (doc_id)"),
    _metric("principal_reason", "principal_reason_identification", "paired JOIN markers USING (doc_id)"),
    _metric("individual_specific", "individual_specific_content", "paired JOIN markers USING (doc_id)"),
    _metric("technical_jargon", "technical_jargon_check", "paired JOIN markers USING (doc_id)"),
    _metric("fidelity", "score", "fid"),
    _metric("readability", "least(100, greatest(0, e)) / 100", "ease WHERE doc_id IN (SELECT doc_id FROM paired)"),
    _metric("cf_score", "cf_score", "cfv"), _metric("cf_flipped", "cf_flipped::INTEGER", "cfv"),
    _metric("cf_probability_change", "cf_probability_change", "cfv"), _metric("processing_time", "processing_time", "paired"),
    _metric("technical_mentions", f"len({_TECH_HITS})", "paired"), _metric("immutable_mentions", f"len({_IMM_HITS})", "paired"),
]) + ")"


@query("metric_summary", f"""WITH {GRADED}
SELECT llm_name, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS count
FROM long_metrics WHERE value IS NOT NULL GROUP BY GROUPING SETS ((llm_name, metric), (metric))""")
def metric_summary(spark, sf_dir):
    return M.metric_summary(long_graded(spark, sf_dir)).select("llm_name", "metric", *rounded(["mean", "std"]), "count")




# --- responses that are no JSON --------------------------------------------------------------
_BODY = "trim(regexp_replace(translate(coalesce(text, ''), '\"''\\\\.!?', ''), '[\\s]+', ' ', 'g'))"


def loose_responses(spark, sf_dir):
    """Whole texts of documents in shapes that only the fallback reads: single quotes, bare keys, an open list, a quoted decision, prose."""
    d = F.col("doc_id")
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\"'\\.!?", ""), r"\s+", " ")).alias("body"))
    b = F.col("body")
    text = (F.when(d % 6 == 0, F.concat(F.lit("Answer: {'consumer_explanation': 'So: "), b, F.lit("', 'analysis': {'top_features': ['age', 'monthly income']}}")))
            .when(d % 6 == 1, F.concat(F.lit('consumer_explanation: "So: '), b, F.lit('", top_features: ["age", "debt"')))
            .when(d % 6 == 2, F.concat(F.lit('The answer is "declined: '), b, F.lit('" as I said')))
            .when(d % 6 == 3, F.concat(F.lit("Dear reader. Thank you, but we are unable to help with "), b, F.lit(". One. Two! Three? Four. Five. Six. Seven.")))
            .when(d % 6 == 4, F.concat(F.lit('"consumer_explanation": "Open: '), b)).otherwise(F.concat(F.lit("Nothing "), F.substring("body", 1, 0))))
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("explanation_id"), text.alias("explanation_text"))


@query("salvaged_fallbacks", f"""WITH b AS (SELECT doc_id, {_BODY} AS body FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'failed' ELSE 'pattern' END AS parse_stage,
  md5(CASE doc_id % 6 WHEN 0 THEN 'So: ' || body WHEN 1 THEN 'So: ' || body WHEN 2 THEN 'declined: ' || body WHEN 4 THEN rtrim('Open: ' || body)
    WHEN 3 THEN 'Thank you, but we are unable to help with ' || body || '. One. Two! Three? Four. Five.' END) AS explanation_md5,
  CASE doc_id % 6 WHEN 0 THEN 'age|monthly income' WHEN 1 THEN 'age|debt' WHEN 5 THEN NULL ELSE '' END AS features FROM b""")
def salvaged_fallbacks(spark, sf_dir):
    out = salvage.salvage_responses(loose_responses(spark, sf_dir))
    return out.select("doc_id", "parse_stage", F.md5(F.col("consumer_explanation").cast("binary")).alias("explanation_md5"), F.array_join("top_features", "|").alias("features"))


@query("suggestion_shapes", f"""WITH {COUNTERFACTUALS},
first AS (SELECT row_id, prediction_id, feature, to_value, n_changes, row_number() OVER (PARTITION BY prediction_id ORDER BY feature) AS i FROM changes JOIN (SELECT row_id AS r, 1 AS one FROM scored) ON r = row_id WHERE cf_index = 1)
SELECT prediction_id, feature AS feature_name, round(to_value, 9) AS target_value FROM first WHERE row_id % 3 <> 1 OR i = 1""")
def suggestion_shapes(spark, sf_dir):
    """Suggestions stored as a list, as one from/to, and as an older list, read alike."""
    changes = F.array_sort(F.get("counterfactuals", F.lit(0))["changes"])
    kind = F.col("row_id") % 3
    new = F.to_json(F.struct(F.transform(changes, lambda m: F.struct(m["feature"].alias("feature_name"), m["to"].cast("string").alias("target_value"))).alias("changes")))
    single = F.to_json(F.struct(changes[0]["feature"].alias("feature_name"), changes[0]["from"].alias("from_value"), changes[0]["to"].alias("to_value")))
    old = F.to_json(F.struct(F.transform(changes, lambda m: F.struct(m["feature"].alias("feature_name"), m["from"].alias("from_value"), m["to"].alias("to_value"))).alias("counterfactual_changes")))
    stored = explained(spark, sf_dir).where(F.size("counterfactuals") > 0).select("prediction_id", F.when(kind == 0, new).when(kind == 1, single).otherwise(old).alias("extraction"))
    return stored.select("prediction_id", F.inline(verification.suggested_changes(F.col("extraction")))).select("prediction_id", "feature_name", F.round("target_value", 9).alias("target_value"))


@query("cf_text_sentences", f"""WITH {COUNTERFACTUALS}, {CF_TEXT}
SELECT prediction_id, CASE row_id % 5 WHEN 0 THEN '{CF_SENTENCES["failed"]}timeout' WHEN 1 THEN '{CF_SENTENCES["first_broken"]}' WHEN 2 THEN '{CF_SENTENCES["empty"]}'
  WHEN 3 THEN '{CF_SENTENCES["none"]}' ELSE coalesce(alternatives, '{CF_SENTENCES["none"]}') END AS alternatives FROM scored LEFT JOIN cft USING (prediction_id)""")
def cf_text_sentences(spark, sf_dir):
    """What a prompt says where counterfactuals failed, are broken, empty or absent."""
    df = explained(spark, sf_dir)
    kind, cfs = df.schema["counterfactuals"].dataType, F.col("counterfactuals")
    broken, empty = F.array(F.lit(None).cast(kind.elementType)), F.array(F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("n_changes"), F.lit("").alias("names"), F.array().cast(
        kind.elementType["changes"].dataType).alias("changes")).cast(kind.elementType))
    which = F.col("row_id") % 5
    given = F.when(which == 1, broken).when(which == 2, empty).when(which == 3, F.array().cast(kind)).otherwise(cfs)
    return df.select("prediction_id", W.counterfactual_text(given, F.when(which == 0, "timeout")).alias("alternatives"))


@query("prompt_system", f"""SELECT 'boosted trees' AS model_type, count(*) AS train_rows, {len(FEATURE_COLUMNS)} AS feature_count,
  '{", ".join(FRIENDLY[c] for c in FEATURE_COLUMNS)}' AS features, '{", ".join(FRIENDLY[c] for c in IMMUTABLE_COLUMNS)}' AS immutable_features FROM customer""")
def prompt_system(spark, sf_dir):
    """Values of the prompt that hold for all applications."""
    values = W.system_variables("boosted trees", 0, FEATURE_COLUMNS, IMMUTABLE_COLUMNS)
    text = {k: ", ".join(v) if isinstance(v, list) else v for k, v in values.items() if k != "train_rows"}
    return A.table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("train_rows")).select(*[F.lit(v).alias(k) for k, v in text.items()], "train_rows")
