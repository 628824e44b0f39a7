"""Counterfactual search, change records and verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from decision_lens.functions.columns import logistic
from decision_lens.functions.quantiles import exact_quantiles, quantile_dict
from decision_lens.functions.ranks import percentile_map, percentile_table
from decision_lens.operators import ensembles
from decision_lens.operators.ensembles import Ensemble
from decision_lens.operators.scoring import linear_logit
from decision_lens.schemas import (COUNT_COLUMNS, FEATURE_COLUMNS, IMMUTABLE_COLUMNS, MUTABLE_COLUMNS, SHOWN,
                                   TECHNICAL, Frozen)
from decision_lens.session import stage

LEVEL_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
SAME = 1e-10


def varying_features(features: list[str] = FEATURE_COLUMNS, immutable: list[str] = IMMUTABLE_COLUMNS,
                     outcome: str | None = None) -> list[str]:
    return [f for f in features if f not in immutable and f != outcome]


def level_grid(train: DataFrame, columns: list[str] = MUTABLE_COLUMNS,
               probs: list[float] = LEVEL_PROBS) -> list[tuple[str, float]]:
    """Distinct training quantiles per feature; counts are rounded half to even."""
    q = quantile_dict(train, columns, probs)
    grid = []
    for c in columns:
        values = [q[c][p] for p in probs if q[c][p] is not None]
        values = [float(round(v)) for v in values] if c in COUNT_COLUMNS else values
        grid += [(c, v) for v in sorted(set(values))]
    return grid


def training_percentiles(train: DataFrame, grid: list[tuple[str, float]],
                         columns: list[str] = MUTABLE_COLUMNS) -> DataFrame:
    """Staged percentile table over training values and grid levels."""
    extra = train.sparkSession.createDataFrame(grid, "feature string, value double")
    return stage(percentile_table(train, columns, extra))


def grid_percentiles(table: DataFrame, grid: list[tuple[str, float]]) -> dict:
    wanted = table.sparkSession.createDataFrame(grid, "feature string, value double")
    rows = table.join(F.broadcast(wanted), ["feature", "value"], "left_semi").collect()
    return {(r["feature"], r["value"]): r["percentile"] for r in rows}


def change_distance(changes: Column) -> Column:
    """Mean absolute percentile change over the changed features, 50 when there are none."""
    size = F.size(changes)
    total = F.aggregate(changes, F.lit(0.0), lambda a, m: a + m["percentile_change"])
    return F.when(size > 0, total / size).otherwise(50.0)


def candidate_list(grid: list[tuple[str, float]]) -> list[tuple[int, int | None]]:
    """One- and two-feature candidates as grid positions, in the order that breaks ties."""
    place = FEATURE_COLUMNS.index
    single = [(i, None) for i in range(len(grid))]
    double = [(i, j) for i in range(len(grid)) for j in range(len(grid)) if place(grid[i][0]) < place(grid[j][0])]

    def order(c):
        names = "|".join(TECHNICAL[grid[i][0]] for i in c if i is not None)
        return (sum(i is not None for i in c), names, *[grid[i][1] for i in c if i is not None])

    return sorted(single + double, key=order)


def _picker(grid, candidates, levels: dict, frozen: Frozen, k: int):
    """Pandas UDF: positions of the k best flipping candidates of each row (a few array operations per batch)."""
    columns = [c for c, _ in grid]
    used = sorted(set(columns), key=columns.index)
    at = np.array([used.index(c) for c in columns])
    to = np.array([v for _, v in grid])
    rank_to = np.array([levels[g] for g in grid])
    weight = np.array([frozen.weights[c] for c in columns])
    spread = np.array([frozen.scale[c] for c in columns])
    first = np.array([a for a, _ in candidates])
    second = np.array([a if b is None else b for a, b in candidates])
    one = np.array([b is None for _, b in candidates])

    def pick(logit: pd.Series, prediction: pd.Series, values: pd.Series, ranks: pd.Series) -> pd.Series:
        out = []
        for s in range(0, len(logit), 1024):
            x = np.stack(values.iloc[s:s + 1024].to_numpy()).astype(float)[:, at]
            rank = np.stack(ranks.iloc[s:s + 1024].to_numpy()).astype(float)[:, at]
            step, real = weight * ((to - x) / spread), np.abs(to - x) >= SAME
            far = np.abs(rank_to - rank)
            moved = np.where(one, step[:, first], step[:, first] + step[:, second])
            distance = np.round(np.where(one, far[:, first], (far[:, first] + far[:, second]) / 2), 9)
            z = logit.iloc[s:s + 1024].to_numpy()[:, None] + moved
            flips = (z > 0) != (prediction.iloc[s:s + 1024].to_numpy()[:, None] == 1)
            distance[~(flips & real[:, first] & real[:, second])] = np.inf
            rows, best = np.arange(len(x)), []
            for _ in range(k):
                i = distance.argmin(axis=1)
                best.append(np.where(np.isfinite(distance[rows, i]), i, -1))
                distance[rows, i] = np.inf
            out += [r[r >= 0] for r in np.stack(best, axis=1).astype(np.int32)]
        return pd.Series(out, index=logit.index, dtype=object)

    return F.pandas_udf(pick, T.ArrayType(T.IntegerType()))


def search(df: DataFrame, frozen: Frozen, grid: list[tuple[str, float]], levels: dict, k: int = 3) -> DataFrame:
    """Up to k flipping alternatives per row that change one or two mutable features.

    Needs columns logit, prediction and the map ``percentiles``. The grid is a short list of
    literals, so all candidates of a row live inside the row: nothing is joined or shuffled.
    Ranked by percentile distance, then number of changes, then features and targets. Only the
    choice runs in Python, on whole batches; the records are built from the chosen positions.
    """
    candidates = candidate_list(grid)
    used = list(dict.fromkeys(c for c, _ in grid))
    pick = _picker(grid, candidates, levels, frozen, k)
    chosen = pick("logit", "prediction", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in used]),
                  F.array(*[F.col("percentiles")[c] for c in used]))
    pairs = ", ".join(f"array({a})" if b is None else f"array({a}, {b})" for a, b in candidates)
    return with_records(df, F.transform(chosen, lambda i: F.get(F.expr(f"array({pairs})"), i)), grid, levels)


def with_records(df: DataFrame, chosen: Column, grid: list[tuple[str, float]], levels: dict) -> DataFrame:
    """Counterfactual records from the grid positions chosen for each row (one or two per counterfactual)."""
    used = list(dict.fromkeys(c for c, _ in grid))
    places = ", ".join(f"named_struct('u', {used.index(c)}, 'feature', '{TECHNICAL[c]}', 'to', {v!r}D, 'p', {levels[(c, v)]!r}D)"
                       for c, v in grid)
    df = df.withColumn("_chosen", chosen).withColumn("_x", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in used])).withColumn(
        "_p", F.array(*[F.col("percentiles")[c] for c in used]))
    level = F.expr(f"array({places})")

    def record(position: Column) -> Column:
        m = F.get(level, position)
        now, rank = F.get("_x", m["u"]), F.get("_p", m["u"])
        return F.struct(m["feature"].alias("feature"), now.alias("from"), m["to"].alias("to"), (m["to"] - now).alias("diff"),
                        rank.alias("from_percentile"), m["p"].alias("to_percentile"),
                        F.abs(m["p"] - rank).alias("percentile_change"))

    changes = F.transform("_chosen", lambda positions: F.transform(positions, record))
    cfs = F.transform(changes, lambda c: F.struct(
        F.round(change_distance(c), 9).alias("distance"), F.size(c).alias("n_changes"),
        F.array_join(F.transform(c, lambda m: m["feature"]), "|").alias("names"), c.alias("changes")))
    return df.withColumn("counterfactuals", cfs).drop("_chosen", "_x", "_p").withColumn(
        "cf_status", F.when(F.size("counterfactuals") > 0, "ok").otherwise("none_found"))


def with_ensemble_counterfactuals(scored: DataFrame, train: DataFrame, ensemble: Ensemble, k: int = 3, key: str = "row_id",
                                  columns: list[str] = MUTABLE_COLUMNS) -> DataFrame:
    """The same for a tree ensemble: all cells that its own thresholds cut out of one or two features are tried.

    Targets are the training values nearest to the row's own in the cell, so no cell with training values is missed. Needs the
    prediction; ``train`` should be staged.
    """
    levels = ensembles.cell_levels(train, ensemble, columns)
    grid = sorted({(r["feature"], r[end]) for r in levels for end in ("low", "high")})
    filled = train.select(*[ensembles.filled(c).alias(c) for c in columns])
    table = training_percentiles(filled, grid, columns)
    ranks = grid_percentiles(table, grid)
    moves = ensembles.Moves(ensemble, levels, ranks, columns)
    rows = scored.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ensemble.features})
    ranked = percentile_map(rows, key, columns, table)
    chosen = moves.chooser(k)(ensembles.vector(ensemble), F.array(*[F.col("percentiles")[c] for c in columns]), F.col("prediction"))
    return with_records(ranked, chosen, moves.grid, ranks)


def with_counterfactuals(scored: DataFrame, train: DataFrame, frozen: Frozen, k: int = 3,
                         key: str = "row_id") -> DataFrame:
    """Grid, percentile ranks and search in one go; ``train`` should be staged."""
    grid = level_grid(train)
    table = training_percentiles(train, grid)
    filled = scored.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in FEATURE_COLUMNS})
    ranked = percentile_map(filled, key, MUTABLE_COLUMNS, table)
    return search(ranked, frozen, grid, grid_percentiles(table, grid), k)


def change_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: one row per changed feature of every counterfactual."""
    each = df.select(*keep, F.posexplode("counterfactuals").alias("_p", "cf"))
    return each.select(*keep, (F.col("_p") + 1).alias("cf_index"), F.col("cf.distance").alias("distance"),
                       F.col("cf.n_changes").alias("n_changes"), F.explode("cf.changes").alias("m")).select(
        *keep, "cf_index", "distance", "n_changes", "m.*")


def change_map(cf: Column) -> Column:
    """{feature: {from, to, diff, percentiles}} of one counterfactual."""
    return F.map_from_entries(F.transform(cf["changes"], lambda m: F.struct(
        m["feature"], F.struct(*[m[n].alias(n) for n in (
            "from", "to", "diff", "from_percentile", "to_percentile", "percentile_change")]))))


def display_value(column: str, raw: Column, before: Column, after: Column, caps: dict) -> Column:
    """Value shown to a reader for a move from ``before`` to ``after`` in processed space, within the limits of SHOWN and of the caps.

    A move scales the raw value by its ratio, between a tenth and ten times; from nothing it is added.
    """
    if column in IMMUTABLE_COLUMNS:
        moved = raw
    else:
        scale = F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.try_divide(after, before)))
        moved = F.when(F.abs(before) > 1e-10, raw * scale).otherwise(raw + (after - before))
        moved = F.when(F.abs(after - before) < 1e-6, raw).otherwise(moved)
        least, most, whole = SHOWN.get(column, (None, None, False))
        moved = F.bround(moved) if whole else moved
        moved = moved if least is None else F.greatest(F.lit(least), moved)
        moved = moved if most is None else F.least(F.lit(most), moved)
    if column in caps:
        low, high = caps[column]
        moved = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), moved))
    return F.when(raw.isNotNull(), moved)


def applied(targets: Column, preserve_flag: bool = True) -> dict[str, Column]:
    """Feature columns after the changes in a map technical name -> target; missing becomes 0.

    Without ``preserve_flag`` the imputation flag is worked out again, as cleaning would on values that are filled by now: it is 0.
    """
    out = {c: F.coalesce(targets[TECHNICAL[c]], F.col(c), F.lit(0.0)) for c in FEATURE_COLUMNS}
    return out if preserve_flag else {**out, "imputed_income": F.lit(0.0)}


def rescored(df: DataFrame, model: Frozen | Ensemble, targets: Column, preserve_flag: bool = True) -> DataFrame:
    """new_probability, new_prediction, flipped and probability_change after changes, by a linear model or any tree ensemble.

    The imputation flag of the row is kept unless ``preserve_flag`` is off; cleaning is not run again on filled values.
    """
    if isinstance(model, Ensemble):
        df = df.withColumn("_m", ensembles.margin(model, ensembles.vector(model, applied(targets))))
        df = df.withColumn("new_probability", ensembles.probability(model, F.col("_m"))).withColumn(
            "new_prediction", F.when(F.col("_m") > model.cut, 1).otherwise(0)).drop("_m")
    else:
        df = df.withColumn("new_probability", logistic(linear_logit(model, applied(targets, preserve_flag)))).withColumn(
            "new_prediction", F.when(F.col("new_probability") > 0.5, 1).otherwise(0))
    return (df.withColumn("flipped", F.col("new_prediction") != F.col("prediction"))
            .withColumn("probability_change", F.col("new_probability") - F.col("probability")))


def verify_each(df: DataFrame, model: Frozen | Ensemble, keep: list[str]) -> DataFrame:
    """Every counterfactual of every row scored again."""
    each = df.select(*keep, "prediction", "probability", *FEATURE_COLUMNS,
                     F.posexplode("counterfactuals").alias("_p", "cf"))
    targets = F.map_from_entries(F.transform("cf.changes", lambda m: F.struct(m["feature"], m["to"])))
    return rescored(each.withColumn("_t", targets), model, F.col("_t")).select(
        *keep, (F.col("_p") + 1).alias("cf_index"), "prediction", "probability", "new_probability", "flipped",
        "probability_change", F.size("cf.changes").alias("n_changed"))


def verification_summary(df: DataFrame, model: Frozen | Ensemble, key: str = "prediction_id") -> DataFrame:
    """Per row: counterfactuals tried, successes and success rate (0 when there are none).

    Counterfactuals of a row never leave the row, so no shuffle is needed.
    """
    def targets(cf: Column) -> Column:
        return F.map_from_entries(F.transform(cf["changes"], lambda m: F.struct(m["feature"], m["to"])))

    if isinstance(model, Ensemble):
        changed = F.transform("counterfactuals", lambda cf: ensembles.vector(model, applied(targets(cf))))
        flags = F.transform(ensembles.margins(model, changed), lambda m: F.when(m > model.cut, 1).otherwise(0) != F.col("prediction"))
    else:
        flags = F.transform("counterfactuals", lambda cf: F.when(linear_logit(model, applied(targets(cf))) > 0, 1).otherwise(0) != F.col("prediction"))
    n, wins = F.size("counterfactuals"), F.size(F.filter("_flags", lambda f: f))
    return df.withColumn("_flags", flags).select(
        key, n.alias("n_counterfactuals"), wins.alias("n_flipped"),
        F.when(n > 0, wins / n).otherwise(0.0).alias("success_rate"))


def flip_rates(verified: DataFrame, declined_only: bool = True) -> DataFrame:
    """Share of flips by position; position 1 is the baseline rate of the report."""
    rows = verified.filter("prediction = 1") if declined_only else verified
    return rows.groupBy("cf_index").agg(F.count(F.lit(1)).alias("n"),
                                        F.avg(F.col("flipped").cast("double")).alias("flip_rate"))


def status_summary(df: DataFrame) -> DataFrame:
    """Rows with usable counterfactuals; rows without one count as such, not as success."""
    return df.groupBy("cf_status").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(F.size("counterfactuals")).alias("n_counterfactuals"))


def count_distribution(df: DataFrame) -> DataFrame:
    """Rows by class and number of counterfactuals, with their share of the class."""
    counted = df.groupBy("prediction", F.size("counterfactuals").alias("n_counterfactuals")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("prediction")))


def flat_rows(df: DataFrame, key: str = "prediction_id", features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """One wide row of texts and numbers per prediction: input_<name> columns, counterfactuals and remark as text."""
    nothing = F.size("counterfactuals") == 0
    return df.select(key, *[F.col(c).alias(f"input_{TECHNICAL[c]}") for c in features],
                     F.when(~nothing, F.to_json("counterfactuals")).alias("counterfactuals_text"), F.when(nothing, F.lit(NONE_FOUND)).alias("info"))


def split_rows(wide: DataFrame, key: str = "prediction_id", prefix: str = "input_") -> DataFrame:
    """(key, input_data map, counterfactuals, info) of wide rows (G16); any columns with the prefix are values, a text that does not
    parse gives no counterfactuals."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    values = F.create_map(*[x for c in names for x in (F.lit(c[len(prefix):]), F.col(f"`{c}`").cast("double"))])
    found = F.from_json("counterfactuals_text", CF_RECORDS)
    return wide.select(key, values.alias("input_data"), F.coalesce(found, F.array().cast(CF_RECORDS)).alias("counterfactuals"), "info")


def verification_dataset(df: DataFrame, n: int | None = None, order: list | None = None) -> DataFrame:
    """Rows that have counterfactuals to verify, the first n by an order that must be given with n."""
    rows = df.filter(F.size("counterfactuals") > 0)
    if n is None:
        return rows
    if not order:
        raise ValueError("the first rows need an order")
    return rows.orderBy(*order).limit(n)


NONE_FOUND = "No counterfactuals found"
CF_RECORDS = ("array<struct<distance:double,n_changes:int,names:string,changes:array<struct<feature:string,`from`:double,`to`:double,diff:double,"
              "from_percentile:double,to_percentile:double,percentile_change:double>>>>")


def prediction_overview(df: DataFrame) -> DataFrame:
    """Totals, spread of the probability, borderline rows and counterfactual counts per class and overall."""
    count = F.size("counterfactuals")
    figures = [F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"),
               F.stddev_samp("probability").alias("std_probability"), F.min("probability").alias("min_probability"),
               F.max("probability").alias("max_probability"),
               F.sum(F.col("probability").between(0.45, 0.55).cast("long")).alias("n_borderline"),
               F.avg(count).alias("mean_cf_count"), F.stddev_samp(count).alias("std_cf_count"),
               F.min(count).alias("min_cf_count"), F.max(count).alias("max_cf_count")]
    slim = df.select("prediction", "probability", count.alias("cf_count"))
    by_class = exact_quantiles(slim, ["probability", "cf_count"], [0.5], by=("prediction",))
    overall = exact_quantiles(slim, ["probability", "cf_count"], [0.5]).withColumn("prediction", F.lit(None).cast("int"))
    pick = lambda c: F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(f"median_{c}")
    medians = by_class.unionByName(overall.select(by_class.columns)).groupBy(F.col("prediction").alias("_p")).agg(pick("probability"), pick("cf_count"))
    return df.rollup("prediction").agg(*figures).join(medians, F.col("prediction").eqNullSafe(F.col("_p"))).drop("_p")
