"""Changes suggested in explanations: names resolved, applied, re-scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from decision_lens.operators.counterfactual import rescored
from decision_lens.operators.ensembles import Ensemble
from decision_lens.schemas import FEATURE_COLUMNS, FEATURES, LOG_SUFFIX, NAME_PATTERNS, SUGGESTION_SHAPES, TECHNICAL_OF_FRIENDLY, Frozen

KNOWN = [f[1] for f in FEATURES]
TOLERANCE = 0.001


def resolve_name(name: Column) -> Column:
    """Technical name behind a suggested one, or null when nothing fits: known names, reader-facing ones, then NAME_PATTERNS."""
    exact = F.create_map(*[F.lit(x) for k in [*[(k, k) for k in KNOWN], *TECHNICAL_OF_FRIENDLY.items()] for x in k])
    spelled = F.coalesce(*[F.when(name.rlike(pattern), technical) for pattern, technical in NAME_PATTERNS])
    base = F.substring(name, F.lit(1), F.length(name) - len(LOG_SUFFIX))
    of_log = F.when(F.array_contains(F.array(*map(F.lit, KNOWN)), base), base)
    return F.coalesce(exact[name], F.when(name.endswith(LOG_SUFFIX), of_log).otherwise(spelled))


def last_wins(entries: Column) -> Column:
    """Array of (k, v) to a map; the last entry of a repeated key counts."""
    backwards = F.reverse(entries)
    keys = F.transform(backwards, lambda e: e["k"])
    return F.map_from_entries(F.reverse(F.filter(
        backwards, lambda e, i: F.array_position(keys, e["k"]) == i + 1)))


def suggested(changes: Column) -> Column:
    """Map suggested name -> target from (feature_name, target_value) entries with a target."""
    usable = F.filter(changes, lambda c: c["feature_name"].isNotNull() & (c["feature_name"] != "")
                      & c["target_value"].isNotNull())
    return last_wins(F.transform(usable, lambda c: F.struct(
        c["feature_name"].alias("k"), c["target_value"].alias("v"))))


def suggested_changes(extraction: Column) -> Column:
    """Entries (feature_name, target_value) of an extraction's JSON in any of SUGGESTION_SHAPES; text that is no number gives a null target."""
    r = F.from_json(extraction, SUGGESTION_SHAPES)
    number = lambda c: c.try_cast("double").alias("target_value")
    listed = F.transform(r["changes"], lambda c: F.struct(c["feature_name"].alias("feature_name"), number(c["target_value"])))
    single = F.array(F.struct(r["feature_name"].alias("feature_name"), number(r["to_value"])))
    older = F.transform(r["counterfactual_changes"], lambda c: F.struct(c["feature_name"].alias("feature_name"), number(c["to_value"])))
    return F.when(F.size(listed) > 0, listed).when(r["feature_name"].isNotNull(), single).otherwise(
        F.coalesce(older, F.array().cast("array<struct<feature_name:string,target_value:double>>")))


def resolved(targets: Column) -> Column:
    """Map technical name -> target; unresolved names drop out."""
    entries = F.transform(F.map_entries(targets), lambda e: F.struct(
        resolve_name(e["key"]).alias("k"), e["value"].alias("v")))
    return last_wins(F.filter(entries, lambda e: e["k"].isNotNull()))


def unresolved_names(df: DataFrame, keep: list[str]) -> DataFrame:
    """Reject table of suggested names that match no feature."""
    each = df.select(*keep, F.explode(F.map_keys(suggested(F.col("changes")))).alias("feature_name"))
    return each.filter(resolve_name(F.col("feature_name")).isNull())


def baselines(df: DataFrame, keep: list[str]) -> DataFrame:
    """(from, to, diff, confidence) per resolved suggestion."""
    from decision_lens.schemas import TECHNICAL
    now = F.create_map(*[x for c in FEATURE_COLUMNS for x in (F.lit(TECHNICAL[c]), F.col(c))])
    each = df.withColumn("_now", now).select(*keep, "_now", F.explode(resolved(suggested(F.col("changes")))).alias("feature", "to"))
    return each.select(*keep, "feature", F.element_at("_now", F.col("feature")).alias("from"), "to",
                       (F.col("to") - F.element_at("_now", F.col("feature"))).alias("diff"),
                       F.lit("medium").alias("confidence"))


def matched_index(targets: Column, counterfactuals: Column) -> Column:
    """1-based place of the first generated counterfactual with the same features and close targets."""
    def same(cf):
        close = F.forall(cf["changes"], lambda m: F.coalesce(
            F.abs(targets[m["feature"]] - m["to"]) <= TOLERANCE, F.lit(False)))
        return (F.size(cf["changes"]) == F.size(F.map_keys(targets))) & close
    place = F.array_position(F.transform(counterfactuals, same), True)
    return F.when(place > 0, place)


def verify_suggestions(df: DataFrame, model: Frozen | Ensemble) -> DataFrame:
    """Score of the suggested changes: 1 for a flip, 0.2 more (up to 1) for matching a generated one.

    Approved applications are skipped (null score); a text without usable suggestion scores 0.
    Needs prediction, probability, feature columns, ``changes`` and ``counterfactuals``.
    """
    raw = suggested(F.col("changes"))
    df = df.withColumn("_raw", raw).withColumn("_targets", resolved(F.col("_raw")))
    df = rescored(df, model, F.col("_targets"))
    skipped = F.col("prediction") == 0
    nothing = F.col("_raw").isNull() | (F.size(F.map_keys("_raw")) == 0)
    live = ~skipped & ~nothing
    place = matched_index(F.col("_raw"), F.col("counterfactuals"))
    score = F.least(F.lit(1.0), F.col("flipped").cast("double") + F.when(place.isNotNull(), 0.2).otherwise(0.0))
    return (df.withColumn("cf_skipped", skipped)
            .withColumn("cf_match", F.when(live, place.isNotNull())).withColumn("cf_match_index", F.when(live, place))
            .withColumn("cf_score", F.when(skipped, None).when(nothing, 0.0).otherwise(score))
            .withColumn("cf_flipped", F.when(live, F.col("flipped")))
            .withColumn("cf_improved", F.when(live, F.col("new_probability") < F.col("probability")))
            .withColumn("cf_probability_change", F.when(live, F.round(F.col("probability_change"), 4)))
            .drop("_raw", "_targets", "flipped", "new_probability", "new_prediction", "probability_change"))
