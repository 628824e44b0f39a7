"""Explanations, raw responses and judge output derived from the given texts and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from decision_lens.functions.columns import outcome
from decision_lens.functions.joins import join_hot
from decision_lens.operators import metrics as M, salvage
from decision_lens.operators.attribution import ranked_features
from decision_lens.operators.worklist import explanation_key
from decision_lens.plans import adapters as A
from decision_lens.plans.models import COUNTERFACTUALS, FZ, explained
from decision_lens.schemas import CHECKLIST_ITEMS, FEATURES, FEATURE_COLUMNS, FIRST_ACTION_ITEM

NAMED = [(f[1], f[2]) for f in FEATURES if f[2]]
SUFFIXES = {
    1: " Your age and MonthlyIncome were considered.",
    2: " Reduce your DebtRatio; older applicants and children do not matter.",
    3: " See NumberOfTime30-59DaysPastDueNotWorse.",
    4: " Your family size is 3.",
}
FENCE = "```"


def explanations(spark, sf_dir) -> DataFrame:
    """One stored response per document: three regenerations per prediction, generator by language.

    The response is wrapped in one of eight ways, from clean JSON to plain text.
    """
    d = F.col("doc_id")
    suffix = F.lit("")
    for k, s in SUFFIXES.items():
        suffix = F.when(d % 6 == k, s).otherwise(suffix)
    friendly = F.array(*[F.lit(n) for _, n in NAMED])
    technical = F.array(*[F.lit(n) for n, _ in NAMED])

    def listed(i):
        at = (d + (F.when(d % 9 == 0, 0).otherwise(i) if i == 1 else F.lit(i))) % 10 + 1
        name = F.element_at(friendly, at.cast("int"))
        return F.when(d % 4 == 1, F.element_at(technical, at.cast("int"))).otherwise(name) if i == 0 else name

    docs = A.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("doc_id div 3").alias("row_id"), F.concat("text", suffix).alias("body"),
        F.concat(F.lit("gen-"), "lang").alias("llm_name"), "n_chars", "source")
    docs = docs.withColumn("prediction_id", F.concat(
        F.when(d % 31 == 0, "missing-").otherwise("app-"), F.col("row_id").cast("string")))
    docs = docs.withColumn("regeneration_number", (d % 3 + 1).cast("int")).withColumn(
        "explanation_id", explanation_key(F.col("prediction_id"), F.col("regeneration_number"), F.col("llm_name")))
    json = F.to_json(F.struct(F.col("body").alias("consumer_explanation"),
                              F.struct(F.array(*[listed(i) for i in range(5)]).alias("top_features")).alias("analysis")))
    wrapped = (F.when(d % 8 == 2, F.concat(F.lit(f"{FENCE}json\n"), "_j", F.lit(f"\n{FENCE}")))
               .when(d % 8 == 3, F.regexp_replace("_j", r"\]\}\}$", ",]},}"))
               .when(d % 8 == 4, F.expr("left(_j, length(_j) - 2)"))
               .when(d % 8 == 5, F.concat(F.lit("Here is the result: "), "_j", F.lit(" Hope this helps.")))
               .when(d % 8 == 6, F.col("body"))
               .when(d % 8 == 7, F.replace(F.col("_j"), F.lit('"analysis"'), F.lit('\x01"analysis"')))
               .otherwise(F.col("_j")))
    return docs.withColumn("_j", json).withColumn("explanation_text", wrapped).withColumn(
        "processing_time", F.round(F.col("n_chars") / 128.0, 6)).select(
        "doc_id", "explanation_id", "prediction_id", "llm_name", "regeneration_number", "explanation_text",
        "processing_time", "source")


_SUFFIX = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in SUFFIXES.items()) + " ELSE '' END"
_FRIENDLY = "[" + ", ".join(f"'{n}'" for _, n in NAMED) + "]"
_TECHNICAL = "[" + ", ".join(f"'{n}'" for n, _ in NAMED) + "]"
_AT = "((doc_id + CASE WHEN doc_id % 9 = 0 AND i = 1 THEN 0 ELSE i END) % 10 + 1)"
EXPLANATIONS = f"""docs AS (
  SELECT doc_id, doc_id // 3 AS row_id, text || {_SUFFIX} AS body, 'gen-' || lang AS llm_name, n_chars, source,
         CASE WHEN doc_id % 31 = 0 THEN 'missing-' ELSE 'app-' END || (doc_id // 3) AS prediction_id,
         (doc_id % 3 + 1)::INTEGER AS regeneration_number, round(n_chars / 128.0::DOUBLE, 6) AS processing_time,
         CASE doc_id % 8 WHEN 2 THEN 'fenced' WHEN 3 THEN 'tidied' WHEN 4 THEN 'closed' WHEN 5 THEN 'embedded'
              WHEN 6 THEN 'failed' WHEN 7 THEN 'control_chars' ELSE 'direct' END AS parse_stage,
         CASE WHEN doc_id % 8 <> 6 THEN list_transform(range(5), lambda i: CASE WHEN doc_id % 4 = 1 AND i = 0
              THEN {_TECHNICAL}[{_AT}] ELSE {_FRIENDLY}[{_AT}] END) END AS listed
  FROM documents),
explanations AS (SELECT *, prediction_id || '_exp_' || regeneration_number || '_' || llm_name AS explanation_id FROM docs)"""

ITEMS = [i for i, _ in CHECKLIST_ITEMS]
UNDERSTAND = [i for i in ITEMS if i < FIRST_ACTION_ITEM]
ACT = [i for i in ITEMS if i >= FIRST_ACTION_ITEM]


def judge_output(explanations_: DataFrame, predictions: DataFrame) -> DataFrame:
    """Raw judge text per explanation of a known prediction, wrapped in one of five ways."""
    d = F.col("doc_id")

    def items(ids):
        return F.map_from_entries(F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.struct(
            F.concat(F.lit("item_"), i.cast("string")),
            F.when((d + i) % 3 == 0, "0").when((d + i) % 3 == 1, "1").otherwise("N/A"))))

    kind = F.expr("(doc_id div 5) % 4")
    first = F.coalesce(F.get("counterfactuals", F.lit(0))["changes"], F.array().cast(
        "array<struct<feature:string,`from`:double,`to`:double,diff:double,from_percentile:double,"
        "to_percentile:double,percentile_change:double>>"))
    from decision_lens.operators.worklist import friendly
    named = F.transform(first, lambda m: F.struct(
        F.when(kind == 1, friendly(m["feature"])).when(kind == 2, F.concat(m["feature"], F.lit("_log")))
        .otherwise(m["feature"]).alias("feature_name"),
        F.when(kind == 2, m["to"] * 0.9).otherwise(m["to"]).cast("string").alias("target_value")))
    named = F.filter(named, lambda m: kind != 3)

    def extra(flag, name, value):
        entry = F.array(F.struct(F.lit(name).alias("feature_name"), F.lit(value).alias("target_value")))
        return F.filter(entry, lambda e: flag)

    changes = F.concat(named, extra(d % 20 == 7, "credit score", "700"), extra(d % 20 == 9, "MonthlyIncome", "n/a"))

    def marker(n):
        return F.concat(F.lit('{"score":'), n.cast("string"), F.lit("}"))

    principal = F.when(d % 37 == 5, F.lit(2)).otherwise(d % 2)
    text = F.concat(
        F.lit('{"cemat_evaluation":'), F.to_json(F.struct(items(UNDERSTAND).alias("understandability_items"),
                                                           items(ACT).alias("actionability_items"))),
        F.lit(',"regulatory_compliance":{"principal_reason_identification":'),
        F.when(d % 11 == 3, principal.cast("string")).otherwise(marker(principal)),
        F.lit(',"individual_specific_content":'), marker(F.when(d % 3 == 0, 1).otherwise(0)),
        F.when(d % 7 == 0, "").otherwise(F.concat(F.lit(',"technical_jargon_check":'), marker(
            F.when(d % 4 == 0, 0).otherwise(1)))),
        F.lit('},"counterfactual_extraction":'), F.to_json(F.struct(changes.alias("changes"))), F.lit("}"))
    j = F.col("_j")
    wrapped = (F.when(d % 5 == 1, F.concat(F.lit(f"{FENCE}json\n"), j, F.lit(f"\n{FENCE}")))
               .when(d % 5 == 2, F.regexp_replace(j, r"^\{", '{\n// see http://example.org/a {\n"note": "http://example.org/#x", '))
               .when(d % 5 == 3, F.replace(j, F.lit('"N/A"'), F.lit("N/A")))
               .when(d % 5 == 4, F.regexp_replace(j, r"\}\}$", "},}"))
               .otherwise(j))
    facts = predictions.select("prediction_id", "counterfactuals")
    return join_hot(explanations_.select("doc_id", "explanation_id", "prediction_id"), facts, "prediction_id").withColumn(
        "_j", text).select("doc_id", "explanation_id", wrapped.alias("judge_text"))


JUDGED = COUNTERFACTUALS + ", " + EXPLANATIONS + f""",
paired AS (SELECT e.*, s.prediction, s.probability, s.logit, (e.doc_id // 5) % 4 AS kind
          FROM explanations e JOIN scored s USING (prediction_id)),
items AS (SELECT doc_id, explanation_id, llm_name, i, (doc_id + i) % 3 AS v FROM paired, (SELECT unnest({ITEMS}) AS i)),
markers AS (SELECT doc_id, CASE WHEN doc_id % 37 <> 5 THEN doc_id % 2 END::INTEGER AS principal_reason_identification,
                   CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS individual_specific_content,
                   CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS technical_jargon_check FROM paired),
suggested AS (SELECT k.*, feature, to_value * CASE WHEN kind = 2 THEN 0.9::DOUBLE ELSE 1 END AS target, from_value,
                     count(feature) OVER (PARTITION BY k.doc_id) AS n_changes
              FROM paired k LEFT JOIN changes c ON c.prediction_id = k.prediction_id AND cf_index = 1 AND kind <> 3)"""


def predictions_for_grading(spark, sf_dir) -> DataFrame:
    """Predictions that an explanation names; others are never graded, so their counterfactuals are not searched."""
    df = explained(spark, sf_dir, explanations(spark, sf_dir))
    top = F.transform(F.slice(ranked_features(), 1, 5), lambda s: s["feature"])
    return df.select("prediction_id", "row_id", "prediction", "probability", *FEATURE_COLUMNS, "counterfactuals",
                     top.alias("shap_top"), outcome(F.col("prediction")).alias("prediction_outcome"))


def graded(spark, sf_dir, enabled: list[str] | None = None) -> DataFrame:
    """Explanations with prediction, judge record and the enabled metrics (all by default); one row per explanation.

    Responses are parsed only for metrics that read them.
    """
    from decision_lens.operators.verification import verify_suggestions
    predictions = predictions_for_grading(spark, sf_dir)
    rows = explanations(spark, sf_dir)
    judged = salvage.salvage_judgements(judge_output(rows, predictions)).select(
        "explanation_id", F.col("doc_id").alias("seq"), "understandability_items", "actionability_items",
        "principal_reason_identification", "individual_specific_content", "technical_jargon_check", "changes")
    matched = M.match(rows, predictions.drop("row_id"), judged)
    names = list(M.METRICS) if enabled is None else enabled
    if M.OF_TEXTS.intersection(names):
        matched = salvage.salvage_responses(matched).withColumn("consumer_text", F.coalesce("consumer_explanation", "explanation_text"))
    return verify_suggestions(M.evaluate(matched, names), FZ)
