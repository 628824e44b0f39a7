"""Structured fields from messy generated text, with a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from decision_lens.functions.columns import pinned
from decision_lens.functions.text import repair_judgement, repair_response
from decision_lens.schemas import JUDGE_RECORD, RESPONSE_RECORD


def _read_response(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the parsed record, or null unless both required fields are there."""
    df = pinned(df, {name: F.from_json(F.col(text), RESPONSE_RECORD)})
    r = F.col(name)
    return df.withColumn(name, F.when(r["consumer_explanation"].isNotNull() & r["analysis"]["top_features"].isNotNull(), r))


def _read_judgement(df: DataFrame, text: str, name: str) -> DataFrame:
    c = F.col(text)
    df = pinned(df, {name: F.struct(F.from_json(c, JUDGE_RECORD).alias("r"), c.alias("json"), F.get_json_object(c, "$.regulatory_compliance").isNotNull().alias("complies"))})
    r = F.col(name)["r"]
    ok = (r["cemat_evaluation"]["understandability_items"].isNotNull() & r["cemat_evaluation"]["actionability_items"].isNotNull()
          & F.col(name)["complies"] & r["counterfactual_extraction"]["changes"].isNotNull())
    return df.withColumn(name, F.when(ok, F.struct(r.alias("r"), F.col(name)["json"].alias("json"))))


def _parsed(df: DataFrame, text: str, read, repair) -> DataFrame:
    """Columns _record, _fix and parse_stage. Texts that parse as they are never reach Python; every text is parsed once."""
    df = read(pinned(df, {"_t": F.trim(F.col(text))}), "_t", "_direct")
    df = pinned(df, {"_direct": F.col("_direct")})
    df = df.withColumn("_fix", repair(F.when(F.col("_direct").isNull(), F.col("_t")))).withColumn("_json", F.col("_fix.json"))
    stage = F.when(F.col("_direct").isNotNull(), "direct").otherwise(F.coalesce("_fix.stage", F.lit("failed")))
    df = read(df.withColumn("parse_stage", stage), "_json", "_mended")
    return pinned(df, {"_record": F.coalesce("_direct", "_mended")}).drop("_direct", "_mended", "_json", "_t")


def salvage_responses(df: DataFrame, text: str = "explanation_text") -> DataFrame:
    """Adds consumer_explanation, top_features and parse_stage; 'failed' rows keep nulls."""
    return (_parsed(df, text, _read_response, repair_response)
            .withColumn("consumer_explanation", F.coalesce("_record.consumer_explanation", "_fix.explanation"))
            .withColumn("top_features", F.coalesce("_record.analysis.top_features", "_fix.features"))
            .drop("_record", "_fix"))


def quarantine(df: DataFrame, text: str = "explanation_text") -> DataFrame:
    return df.filter("parse_stage = 'failed'").select("explanation_id", text)


def one_line_json(df: DataFrame, text: str = "explanation_text") -> Column:
    """Accepted responses as one-line JSON, others as they came (needs salvage_responses)."""
    packed = F.to_json(F.struct("consumer_explanation", F.struct("top_features").alias("analysis")))
    return F.when(F.col("parse_stage") != "failed", packed).otherwise(F.col(text))


def consumer_text(text: Column) -> Column:
    """The reader's text of a stored explanation: its JSON field, else all of it."""
    return F.coalesce(F.get_json_object(text, "$.consumer_explanation"), text)


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _marker(name: str) -> Column:
    """Score of a marker given as {"score": n} or as a bare n; only 0 and 1 are valid."""
    path = f"$.regulatory_compliance.{name}"
    raw = F.coalesce(F.get_json_object("_record.json", path + ".score"), F.get_json_object("_record.json", path))
    n = raw.try_cast("int")
    return F.when(n.isin(0, 1), n)


def salvage_judgements(df: DataFrame, text: str = "judge_text") -> DataFrame:
    """Judge output as checked columns; ``violation`` names what kept a record from being valid."""
    df = _parsed(df, text, _read_judgement, repair_judgement)
    r = F.col("_record.r")
    changes = F.transform(r["counterfactual_extraction"]["changes"], lambda c: F.struct(
        c["feature_name"].alias("feature_name"), _number(c["target_value"]).alias("target_value")))
    jargon = _marker("technical_jargon_check")
    given = F.get_json_object("_record.json", "$.regulatory_compliance.technical_jargon_check")
    df = df.select(
        "*", r["cemat_evaluation"]["understandability_items"].alias("understandability_items"),
        r["cemat_evaluation"]["actionability_items"].alias("actionability_items"),
        _marker("principal_reason_identification").alias("principal_reason_identification"),
        _marker("individual_specific_content").alias("individual_specific_content"),
        F.when(F.col("_record").isNotNull() & given.isNull(), 0).otherwise(jargon).alias("technical_jargon_check"),
        changes.alias("changes"))
    bad_marker = (F.col("principal_reason_identification").isNull() | F.col("individual_specific_content").isNull()
                  | F.col("technical_jargon_check").isNull())
    violation = F.when(F.col("_record").isNull(), "unparsed").when(bad_marker, "marker out of range")
    return df.withColumn("violation", violation).drop("_record", "_fix")


def flatten_explanations(df: DataFrame) -> DataFrame:
    """Token usage and parsed fields as columns, with a parsed flag."""
    flat = salvage_responses(df)
    usage = [F.col(f"token_usage.{c}").alias(c) for c in (
        "prompt_tokens", "completion_tokens", "total_tokens", "total_cost")] if "token_usage" in df.columns else []
    return flat.select(*[c for c in df.columns if c != "token_usage"], *usage, "consumer_explanation",
                       F.col("top_features").alias("analysis_top_features"),
                       (F.col("parse_stage") != "failed").alias("explanation_parsed"), "parse_stage")


def run_summary(df: DataFrame, failed: Column, by: str = "llm_name") -> DataFrame:
    """Totals, successes and failures per generator and overall (generator null)."""
    bad = failed.cast("long")
    return df.rollup(by).agg(F.count(F.lit(1)).alias("total"), F.sum(1 - bad).alias("ok"), F.sum(bad).alias("failed"))
