"""Explanation metrics (I1-I8, I15-I17), one record per explanation, all inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.functions.columns import pinned
from decision_lens.functions.joins import join_hot
from decision_lens.functions.text import mentions, with_readability
from decision_lens.schemas import IMMUTABLE_TERMS, TECHNICAL_OF_FRIENDLY, FEATURES

NOT_APPLICABLE = ("N/A", "n/a")
TECHNICAL_NAMES = [f[1] for f in FEATURES if f[2] and f[1] != "age"]


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the latest wins; an aggregate, so copies collapse before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_v")).select(key, "_v.*")


def match(explanations: DataFrame, predictions: DataFrame, judgements: DataFrame | None = None,
          order: str = "seq") -> DataFrame:
    """Explanations with their prediction and their last judge result; ``match_status`` tells what is missing.

    A prediction that very many explanations share is brought to them instead of gathering them in one task.
    """
    out = join_hot(explanations, predictions.withColumn("_has_prediction", F.lit(True)), "prediction_id", "left")
    if judgements is not None:
        last = last_per_key(judgements, "explanation_id", order).drop(order).withColumn("_has_judgement", F.lit(True))
        out = out.join(last, "explanation_id", "left")
    status = F.when(F.col("_has_prediction").isNull(), "no_prediction")
    if judgements is not None:
        status = status.when(F.col("_has_judgement").isNull(), "no_judgement")
    return out.withColumn("match_status", status.otherwise("matched")).drop("_has_prediction", "_has_judgement")


def checklist(understandability: Column, actionability: Column) -> Column:
    """Earned and applicable items and their ratios, per part and overall."""
    def earned(items):
        return F.size(F.filter(F.map_values(items), lambda v: v.try_cast("double") == 1))

    def applicable(items):
        return F.size(F.filter(F.map_values(items), lambda v: v.isNotNull() & ~v.isin(*NOT_APPLICABLE)))

    def ratio(e, a):
        return e / F.greatest(F.lit(1), a)

    eu, au, ea, aa = earned(understandability), applicable(understandability), earned(actionability), applicable(actionability)
    return F.when(understandability.isNotNull() | actionability.isNotNull(), F.struct(
        eu.alias("understandability_earned"), au.alias("understandability_applicable"),
        ea.alias("actionability_earned"), aa.alias("actionability_applicable"),
        ratio(eu, au).alias("understandability_score"), ratio(ea, aa).alias("actionability_score"),
        ratio(eu + ea, au + aa).alias("overall_score")))


def technical_substrings(text: Column, low: Column | None = None) -> Column:
    """How many technical names occur anywhere in the text, ignoring case."""
    low = F.lower(text) if low is None else low
    return F.size(F.filter(F.array(*[F.lit(n.lower()) for n in TECHNICAL_NAMES]), lambda n: F.contains(low, n)))


def technical_mentions(text: Column, low: Column | None = None) -> Column:
    """Technical names that occur as whole words, ignoring case ('age' is an ordinary word)."""
    low = F.lower(text) if low is None else low
    hits = [F.when(mentions(low, n.lower()), F.lit(n)) for n in TECHNICAL_NAMES]
    return F.array_compact(F.array(*hits))


def immutable_mentions(text: Column, low: Column | None = None) -> Column:
    """(feature, term) for every immutable feature, with the first of its terms that occurs."""
    low = F.lower(text) if low is None else low
    hits = []
    for feature, terms in IMMUTABLE_TERMS:
        found = F.coalesce(*[
            F.when(F.contains(low, F.lit(t)) if " " in t else mentions(low, t), F.lit(t)) for t in terms])
        hits.append(F.struct(F.lit(feature).alias("feature"), found.alias("term_found")))
    return F.filter(F.array(*hits), lambda h: h["term_found"].isNotNull())


def technical_name(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in TECHNICAL_OF_FRIENDLY.items() for x in p])[name], name)


def spearman_p(r: Column, n: Column) -> Column:
    """Two-sided t-test of a rank correlation of 3 to 5 positions; null below 3."""
    df = n - 2
    t = F.abs(r) * F.sqrt(df / (1 - r * r))
    u = t / F.sqrt(F.lit(3.0))
    p = (F.when(df == 1, 1 - (2 / F.pi()) * F.atan(t)).when(df == 2, 1 - t / F.sqrt(2 + t * t))
         .when(df == 3, 1 - (2 / F.pi()) * (F.atan(u) + u / (1 + u * u))))
    return F.when(df >= 1, F.when(F.abs(r) >= 1, 0.0).otherwise(p))


def fidelity(listed: Column, top: Column) -> Column:
    """Rank agreement of the features a text lists with the five largest attributions.

    ``listed`` may hold reader-facing or technical names, repeats count at their first place;
    ``top`` holds technical names, largest first. Fewer than two in common give 0.
    """
    names = F.transform(listed, technical_name)
    common = F.array_intersect(F.array_distinct(names), top)
    n = F.size(common)

    def places(source):
        return F.transform(common, lambda f: F.size(F.filter(common, lambda g: (
            F.array_position(source, g) < F.array_position(source, f)))))

    gaps = F.zip_with(places(names), places(top), lambda a, b: (a - b) * (a - b))
    d2 = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    r = 1 - F.try_divide(6.0 * d2, n * (n * n - 1))
    empty = listed.isNull() | (F.size(listed) == 0)
    error = (F.when(top.isNull(), "no attributions").when(empty, "no features to compare")
             .when(n < 2, "insufficient common features"))
    return F.struct(F.when(error.isNotNull(), 0.0).otherwise(r).alias("score"),
                    F.when(error.isNull(), spearman_p(r, n)).alias("p_value"),
                    F.when(top.isNotNull() & ~empty, n).alias("matching_features"), error.alias("error"))


METRICS = {
    "readability": lambda df: with_readability(df, "consumer_text"),
    "checklist": lambda df: df.withColumn("checklist", checklist(
        F.col("understandability_items"), F.col("actionability_items"))),
    "regulatory": lambda df: df.withColumn("feature_name_matching", technical_substrings(F.col("consumer_text"), F.col("_low"))),
    "fidelity": lambda df: df.withColumn("fidelity", fidelity(F.col("top_features"), F.col("shap_top"))),
    "immutable": lambda df: df.withColumn("immutable_mentions", immutable_mentions(F.col("consumer_text"), F.col("_low"))),
    "technical": lambda df: df.withColumn("technical_mentions", technical_mentions(F.col("consumer_text"), F.col("_low"))),
}

#: Metrics that need a parsed response.
OF_TEXTS = {"readability", "regulatory", "fidelity", "immutable", "technical"}
#: Metrics that search the text in lower case, which is made once a row however many terms are searched.
OF_LOWER = {"regulatory", "immutable", "technical"}


def evaluate(df: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Run the enabled metrics; each is a column expression that yields null instead of failing."""
    names = list(METRICS) if enabled is None else enabled
    lower = not OF_LOWER.isdisjoint(names)
    if lower:
        df = pinned(df, {"_low": F.lower("consumer_text")})
    for name in names:
        df = df.transform(METRICS[name])
    return df.drop("_low") if lower else df


def long_metrics(df: DataFrame, values: dict[str, Column], keep: list[str]) -> DataFrame:
    """(keep..., metric, value); narrow."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in values.items()])
    return df.select(*keep, F.inline(cells))


def metric_summary(long: DataFrame, by: str = "llm_name") -> DataFrame:
    """Mean, population std and count per (generator, metric) and per metric (generator null)."""
    present = long.filter(F.col("value").isNotNull())
    return present.groupingSets([[by, "metric"], ["metric"]], by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("count"))


def first_examples(df: DataFrame, by: list[str], order: str, n: int = 1) -> DataFrame:
    """First n rows per group by a unique key; n is a literal, so each task keeps only n per group."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
