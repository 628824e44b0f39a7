"""Work lists, prompt tables and judge requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from decision_lens.functions.joins import join_hot
from decision_lens.functions.sampling import number_by_hash
from decision_lens.operators.attribution import ranked_features
from decision_lens.schemas import CF_SENTENCES, COLUMN_OF, FRIENDLY, TARGET_ROUNDING, TECHNICAL, FEATURES

FRIENDLY_OF = {f[1]: FRIENDLY[f[0]] for f in FEATURES}


def friendly(technical: Column) -> Column:
    """Reader-facing name; names without one stay as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in FRIENDLY_OF.items() for x in p])[technical], technical)


def fixed_point(x: Column, digits: int, signed: bool = False) -> Column:
    """Decimal text of a double, rounded half to even on its exact value."""
    zeros = "0." + "0" * digits
    return F.call_function("format_number", x, F.lit(f"+{zeros};-{zeros}" if signed else zeros))


def explanation_key(prediction_id: Column, n: Column, generator: Column) -> Column:
    return F.concat(prediction_id, F.lit("_exp_"), n.cast("string"), F.lit("_"), generator)


def work_list(predictions: DataFrame, generators: list[str], regenerations: int) -> DataFrame:
    """One row per prediction, generator and regeneration; a narrow expansion of each row."""
    each = predictions.withColumn("llm_name", F.explode(F.array(*[F.lit(g) for g in generators]))).withColumn(
        "regeneration_number", F.explode(F.sequence(F.lit(1), F.lit(regenerations))))
    return each.withColumn("explanation_id", explanation_key(
        F.col("prediction_id"), F.col("regeneration_number"), F.col("llm_name")))


def remaining(work: DataFrame, stored: DataFrame, key: str = "explanation_id") -> DataFrame:
    """Work whose key is not stored yet; only the key column of the store is read."""
    return work.join(stored.select(key), key, "left_anti")


def attribution_text() -> Column:
    """Lines 'name: 0.1234', largest absolute attribution first (needs phi_ columns)."""
    return F.array_join(F.transform(ranked_features(), lambda s: F.concat(
        friendly(s["feature"]), F.lit(": "), fixed_point(s["phi"], 4))), "\n")


def safe_target(feature: Column, to: Column) -> Column:
    """Target moved to the safe side of its rounding step; features without a rule stay."""
    rounded = to
    for c, (direction, step) in TARGET_ROUNDING.items():
        steps = to / step
        moved = (F.ceil(steps) if direction == "up" else F.floor(steps)) * step
        rounded = F.when(feature == TECHNICAL[c], moved).otherwise(rounded)
    return rounded


def counterfactual_text(cfs: Column, error: Column | None = None) -> Column:
    """First counterfactual as lines 'name: from -> to (change: d)', or a fixed sentence; ``error`` is what generation said when it failed.

    A first counterfactual that is null is one that could not be read.
    """
    line = F.transform(cfs[0]["changes"], lambda m: F.concat(
        friendly(m["feature"]), F.lit(": "), fixed_point(m["from"], 6), F.lit(" → "),
        fixed_point(safe_target(m["feature"], m["to"]), 2),
        F.lit(" (change: "), fixed_point(m["diff"], 4, signed=True), F.lit(")")))
    first = F.get(cfs, F.lit(0))
    text = (F.when(cfs.isNull() | (F.size(cfs) == 0), CF_SENTENCES["none"]).when(first.isNull(), CF_SENTENCES["first_broken"])
            .when(F.size(first["changes"]) == 0, CF_SENTENCES["empty"])
            .otherwise(F.concat(F.lit("Scenario 1:\n"), F.array_join(line, "\n"))))
    return text if error is None else F.when(error.isNotNull(), F.concat(F.lit(CF_SENTENCES["failed"]), error)).otherwise(text)


PROMPT_VALUES = ["age", "income", "debt_ratio", "utilisation", "open_lines", "real_estate", "dependents",
                 "late_30_59", "late_60_89", "late_90"]


def prompt_variables(df: DataFrame) -> DataFrame:
    """Outcome word, values with missing as 0, attribution and counterfactual texts."""
    return df.select(
        "prediction_id", "prediction", F.when(F.col("prediction") == 1, "declined").otherwise("approved")
        .alias("prediction_outcome"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in PROMPT_VALUES],
        attribution_text().alias("attributions"), counterfactual_text(F.col("counterfactuals")).alias("alternatives"))


def system_variables(model_type: str, train_rows: int, features: list[str], immutable: list[str]) -> dict:
    """Dataset-level prompt values."""
    return {"model_type": model_type, "train_rows": train_rows, "feature_count": len(features),
            "features": [FRIENDLY[c] for c in features], "immutable_features": [FRIENDLY[c] for c in immutable]}


def values_text() -> Column:
    """Applicant values, one line each, in a fixed order."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{FRIENDLY[c]}: "), fixed_point(F.coalesce(
        F.col(c), F.lit(0.0)), 6)) for c in PROMPT_VALUES])


def explanation_prompt(df: DataFrame) -> DataFrame:
    """Prompt table for an external generator."""
    prompt = F.concat_ws("\n\n", F.concat(F.lit("The application was "), F.col("prediction_outcome"), F.lit(".")),
                         values_text(), F.concat(F.lit("Influence of each value:\n"), F.col("attributions")),
                         F.concat(F.lit("What would change the decision:\n"), F.col("alternatives")))
    return prompt_variables(df).withColumn("prompt", prompt)


def judge_requests(explanations: DataFrame, predictions: DataFrame, temperature: float = 0.2,
                   max_tokens: int = 8000, cached_content: str | None = None, seed=42) -> DataFrame:
    """One request per explanation with a known prediction.

    Requests are numbered over all explanations before unmatched ones drop out, so numbers keep gaps.
    """
    numbered = number_by_hash(explanations, "explanation_id", name="_no", seed=seed)
    facts = predictions.select("prediction_id", "prediction", *PROMPT_VALUES)
    prompt = F.concat(F.lit("Decision: "), F.when(F.col("prediction") == 1, "DECLINED").otherwise("APPROVED"),
                      F.lit("\n"), values_text(), F.lit("\nExplanation to grade:\n"), F.col("explanation_text"))
    fields = [F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"))).alias("contents"),
              F.struct(F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("maxOutputTokens"))
              .alias("generation_config")]
    if cached_content:
        fields.append(F.lit(cached_content).alias("cached_content"))
    return join_hot(numbered, facts, "prediction_id").select(
        F.concat(F.lit("request-"), F.col("_no").cast("string")).alias("key"), F.struct(*fields).alias("request"),
        F.struct("prediction_id", "llm_name", "explanation_id").alias("custom_metadata"))


__all__ = ["COLUMN_OF", "friendly", "explanation_key", "work_list", "remaining", "attribution_text",
           "counterfactual_text", "prompt_variables", "system_variables", "explanation_prompt", "judge_requests"]
