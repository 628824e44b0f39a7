"""Fitted tree ensembles as flat arrays: scoring, counterfactual search and attribution for any of them.

A tree's node is a place in five arrays (split feature, threshold, left, right, leaf value); a row goes left when its value is at most
the threshold. The margin of a row is a bias and the sum of its leaves: log-odds for boosted trees, a probability for forests. The
thresholds of all trees cut every feature into cells in which no tree can tell values apart; a leaf is a box of cells.
Ensembles are part of a model, so their size is known; they travel to the tasks inside the functions that use them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from decision_lens.functions.columns import logistic
from decision_lens.functions.sampling import take_by_hash
from decision_lens.operators.boosting import LeafwiseModel
from decision_lens.schemas import FEATURE_COLUMNS, TECHNICAL, Frozen
from decision_lens.session import scratch_dir

ROWS_AT_ONCE = 64
CELLS_AT_ONCE = 4 << 20


@dataclass(frozen=True)
class Ensemble:
    features: tuple
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float = 0.0
    log_odds: bool = True

    @classmethod
    def from_trees(cls, features: list[str], trees: list, bias: float = 0.0, log_odds: bool = True) -> "Ensemble":
        """Trees as nested tuples (feature, threshold, left, right), a leaf as its value."""
        nodes: list[list] = []

        def add(tree) -> int:
            at = len(nodes)
            if not isinstance(tree, tuple):
                nodes.append([-1, 0.0, -1, -1, float(tree)])
                return at
            name, cut, low, high = tree
            nodes.append([features.index(name), float(cut), 0, 0, 0.0])
            nodes[at][2] = add(low)
            nodes[at][3] = add(high)
            return at

        roots = [add(t) for t in trees]
        return cls.from_nodes(features, nodes, roots, bias, log_odds)

    @classmethod
    def from_nodes(cls, features, nodes: list, roots: list[int], bias: float, log_odds: bool) -> "Ensemble":
        columns = list(zip(*nodes)) if nodes else [[]] * 5
        kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
        return cls(tuple(features), *[np.array(c, dtype=k) for c, k in zip(columns, kinds)], np.array(roots, dtype=np.int32), float(bias), log_odds)

    @property
    def cut(self) -> float:
        """Margins above it are declined."""
        return 0.0 if self.log_odds else 0.5

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margins of rows; all trees of a row descend together."""
        out = np.empty(len(x))
        step = max(1, CELLS_AT_ONCE // max(1, len(self.roots)))
        for i in range(0, len(x), step):
            part = x[i:i + step]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                low = part[row, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            out[i:i + step] = self.bias + self.value[at].sum(axis=1)
        return out

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        """Sorted thresholds of every feature."""
        return [np.unique(self.threshold[self.feature == f]) for f in range(len(self.features))]

    @cached_property
    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first cell, last cell, value) of every leaf; cells by feature, both ends included."""
        d = len(self.features)
        lows, highs, values = [], [], []
        whole = [len(c) for c in self.cuts]
        stack = [(int(r), [0] * d, list(whole)) for r in self.roots]
        while stack:
            at, low, high = stack.pop()
            f = int(self.feature[at])
            if f < 0:
                lows.append(low)
                highs.append(high)
                values.append(float(self.value[at]))
                continue
            k = int(np.searchsorted(self.cuts[f], self.threshold[at]))
            down, up = list(high), list(low)
            down[f], up[f] = min(high[f], k), max(low[f], k + 1)
            if low[f] <= down[f]:
                stack.append((int(self.left[at]), low, down))
            if up[f] <= high[f]:
                stack.append((int(self.right[at]), up, high))
        return np.array(lows, dtype=np.int32).reshape(-1, d), np.array(highs, dtype=np.int32).reshape(-1, d), np.array(values)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def agreeing(self, cells: np.ndarray) -> np.ndarray:
        """Bit sets (rows, leaves) of the features whose cell lies inside the leaf's box."""
        low, high, _ = self.boxes
        out = np.zeros((len(cells), len(low)), dtype=np.int64)
        for f in range(cells.shape[1]):
            c = cells[:, f][:, None]
            out |= ((low[:, f] <= c) & (c <= high[:, f])).astype(np.int64) << f
        return out


# --- from fitted models ------------------------------------------------------------------
def ensemble_of(model: Model, features: list[str] | None = None) -> Ensemble:
    """Any fitted tree classifier, alone or at the end of a pipeline behind its assembler."""
    if isinstance(model, PipelineModel):
        assembler, *others = model.stages
        if len(others) != 1:
            raise ValueError("a pipeline must be an assembler and a classifier")
        return ensemble_of(others[0], list(assembler.getInputCols()))
    features = list(features or FEATURE_COLUMNS)
    if isinstance(model, LeafwiseModel):
        nodes, roots, bias = model.nodes()
        return Ensemble.from_nodes(features, nodes, roots, bias, True)
    if not isinstance(model, (GBTClassificationModel, RandomForestClassificationModel, DecisionTreeClassificationModel)):
        raise ValueError(f"no tree ensemble: {type(model).__name__}")
    nodes, roots = saved_nodes(model)
    if isinstance(model, GBTClassificationModel):
        weights = [2.0 * w for w in model.treeWeights]  # the probability is logistic(2 * margin)
        value = lambda node: node["prediction"]
    else:
        weights = [1.0 / len(roots)] * len(roots)
        value = lambda node: node["impurityStats"][1] / sum(node["impurityStats"])
    flat, starts = [], []
    for tree, rows in enumerate(nodes):
        place = {r["id"]: len(flat) + i for i, r in enumerate(rows)}
        starts.append(place[0])
        for r in rows:
            leaf = r["leftChild"] < 0
            flat.append([-1, 0.0, -1, -1, weights[tree] * value(r)] if leaf else
                        [r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0], place[r["leftChild"]], place[r["rightChild"]], 0.0])
    return Ensemble.from_nodes(features, flat, starts, 0.0, isinstance(model, GBTClassificationModel))


def saved_nodes(model: Model) -> tuple[list[list], list[int]]:
    """Nodes of every tree as the model's own writer saves them; their number is bounded by trees and depth."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = f"{scratch_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    trees: dict[int, list] = {}
    for r in data.orderBy("treeID", "nodeData.id").collect():
        trees.setdefault(r["treeID"], []).append(r["nodeData"])
    return [trees[t] for t in sorted(trees)], sorted(trees)


def frozen_of(model: PipelineModel) -> Frozen:
    """A fitted logistic pipeline over FEATURE_COLUMNS as a frozen linear model, which the linear operators take."""
    assembler, linear = model.stages
    if not isinstance(linear, LogisticRegressionModel):
        raise ValueError(f"no linear model: {type(linear).__name__}")
    weights = dict(zip(assembler.getInputCols(), linear.coefficients.toArray().tolist()))
    return Frozen(center={c: 0.0 for c in FEATURE_COLUMNS}, scale={c: 1.0 for c in FEATURE_COLUMNS},
                  weights={c: weights.get(c, 0.0) for c in FEATURE_COLUMNS}, intercept=float(linear.intercept))


# --- scoring -------------------------------------------------------------------------------
def filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)).cast("double")


def vector(ensemble: Ensemble, values: dict[str, Column] | None = None) -> Column:
    """The features of a row as an array, missing ones as 0, after the given replacements."""
    values = values or {}
    return F.array(*[values.get(c, filled(c)) for c in ensemble.features])


def margin(ensemble: Ensemble, x: Column) -> Column:
    """Margin of an array of features."""
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(ensemble.margins(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

    return F.pandas_udf(run, T.DoubleType())(x)


def margins(ensemble: Ensemble, xs: Column) -> Column:
    """Margins of an array of such arrays."""
    def run(xs: pd.Series) -> pd.Series:
        sizes = [len(v) for v in xs]
        flat = [np.asarray(x, dtype=float) for v in xs for x in v]
        out = ensemble.margins(np.stack(flat)) if flat else np.zeros(0)
        return pd.Series(np.split(out, np.cumsum(sizes)[:-1]), index=xs.index, dtype=object) if sizes else pd.Series([], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(xs)


def probability(ensemble: Ensemble, m: Column) -> Column:
    return logistic(m) if ensemble.log_odds else m


def score(df: DataFrame, ensemble: Ensemble) -> DataFrame:
    """Adds margin, probability of default, prediction (1 = declined) and a stable id."""
    return (df.withColumn("margin", margin(ensemble, vector(ensemble))).withColumn("probability", probability(ensemble, F.col("margin")))
            .withColumn("prediction", F.when(F.col("margin") > ensemble.cut, 1).otherwise(0))
            .withColumn("prediction_id", F.concat(F.lit("app-"), F.col("row_id").cast("string"))))


# --- counterfactual search --------------------------------------------------------------------
def cell_levels(train: DataFrame, ensemble: Ensemble, columns: list[str]) -> list[dict]:
    """(feature, cell, low, high): the least and greatest training value in every cell of the given features."""
    from decision_lens.functions.quantiles import melt
    cuts = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*map(F.lit, ensemble.cuts[ensemble.features.index(c)].tolist())).cast("array<double>"))])
    filled_rows = train.select(*[filled(c).alias(c) for c in columns])
    cell = F.size(F.filter(F.element_at(cuts, F.col("feature")), lambda t: t < F.col("value")))
    rows = melt(filled_rows, columns).withColumn("cell", cell).groupBy("feature", "cell").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (ensemble.features.index(r["feature"]), r["cell"]))


class Moves:
    """Candidates of one or two changed features by cells, in the order that breaks ties, and their margins."""

    def __init__(self, ensemble: Ensemble, levels: list[dict], ranks: dict, columns: list[str]):
        self.e, self.columns = ensemble, columns
        self.at = [ensemble.features.index(c) for c in columns]
        self.grid: list[tuple[str, float]] = sorted({(r["feature"], r[k]) for r in levels for k in ("low", "high")}, key=lambda g: (columns.index(g[0]), g[1]))
        place = {g: i for i, g in enumerate(self.grid)}
        size = [len(ensemble.cuts[f]) + 1 for f in self.at]
        # place in the grid of the value that a cell is entered at, from below and from above; -1 where no training value lies in it
        self.up, self.down = ([np.full(n, -1) for n in size] for _ in range(2))
        for r in levels:
            i = columns.index(r["feature"])
            self.up[i][r["cell"]], self.down[i][r["cell"]] = place[(r["feature"], r["low"])], place[(r["feature"], r["high"])]
        self.rank = np.array([ranks[g] for g in self.grid] + [np.nan])
        name = [TECHNICAL.get(c, c) for c in columns]
        self.singles = sorted(range(len(columns)), key=lambda i: name[i])
        pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns)) if FEATURE_COLUMNS.index(columns[i]) < FEATURE_COLUMNS.index(columns[j])]
        self.pairs = sorted(pairs, key=lambda p: f"{name[p[0]]}|{name[p[1]]}")

    def plane(self, agree: np.ndarray, i: int, j: int) -> np.ndarray:
        """Margins (rows, cells of i, cells of j) of changing features i and j only.

        A leaf is reached from the cells of its box if all other features agree; boxes are added as differences, then summed up.
        """
        low, high, value = self.e.boxes
        f, g = self.at[i], self.at[j]
        n, m = len(self.up[i]), len(self.up[j])
        free = (1 << f) | (1 << g)
        row, leaf = np.nonzero((agree | free) == (1 << len(self.e.features)) - 1)
        out = np.zeros((len(agree), n + 1, m + 1))
        for a, b, sign in ((low[leaf, f], low[leaf, g], 1), (high[leaf, f] + 1, low[leaf, g], -1),
                           (low[leaf, f], high[leaf, g] + 1, -1), (high[leaf, f] + 1, high[leaf, g] + 1, 1)):
            np.add.at(out, (row, a, b), sign * value[leaf])
        return self.e.bias + out.cumsum(axis=1).cumsum(axis=2)[:, :n, :m]

    def steps(self, x: np.ndarray, cells: np.ndarray, ranks: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Grid places and percentile changes (rows, cells) of moving feature i into each cell; infinite for its own and for empty cells."""
        own = cells[:, self.at[i]][:, None]
        all_cells = np.arange(len(self.up[i]))[None, :]
        to = np.where(all_cells > own, self.up[i][None, :], self.down[i][None, :])
        far = np.abs(self.rank[to] - ranks[:, i][:, None])
        return to, np.where((all_cells == own) | (to < 0), np.inf, far)

    def best(self, x: np.ndarray, ranks: np.ndarray, prediction: np.ndarray, k: int) -> list[list[list[int]]]:
        """Grid places of the k nearest flipping candidates of every row."""
        cells = self.e.cells(x)
        agree = self.e.agreeing(cells)
        step = [self.steps(x, cells, ranks, i) for i in range(len(self.columns))]
        row = np.arange(len(x))
        found, sources = [], []
        planes = {}
        for i, j in self.pairs:
            planes[i, j] = self.plane(agree, i, j)
        partner = {}
        for i, j in self.pairs:
            partner.setdefault(i, (i, j))
            partner.setdefault(j, (i, j))
        for i in self.singles:
            p = partner[i]
            m = planes[p][row, :, cells[:, self.at[p[1]]]] if p[0] == i else planes[p][row, cells[:, self.at[p[0]]], :]
            found.append(self.flipped(m, step[i][1], prediction))
            sources.append((i, None))
        for i, j in self.pairs:
            far = (step[i][1][:, :, None] + step[j][1][:, None, :]) / 2
            found.append(self.flipped(planes[i, j], far, prediction).reshape(len(x), -1))
            sources.append((i, j))
        starts = np.concatenate([[0], np.cumsum([f.shape[1] for f in found])])
        distance, out = np.concatenate(found, axis=1), [[] for _ in row]
        for _ in range(k):
            at = distance.argmin(axis=1)
            for r in row[np.isfinite(distance[row, at])]:
                s = int(np.searchsorted(starts, at[r], side="right")) - 1
                (i, j), rest = sources[s], int(at[r] - starts[s])
                if j is None:
                    out[r].append([int(step[i][0][r, rest])])
                else:
                    a, b = divmod(rest, len(self.up[j]))
                    out[r].append([int(step[i][0][r, a]), int(step[j][0][r, b])])
            distance[row, at] = np.inf
        return out

    def flipped(self, m: np.ndarray, far: np.ndarray, prediction: np.ndarray) -> np.ndarray:
        declined = prediction.reshape(-1, *[1] * (m.ndim - 1)) == 1
        return np.where((m > self.e.cut) != declined, np.round(far, 9), np.inf)

    def chooser(self, k: int):
        """UDF (features, percentile ranks of the columns, prediction) -> grid places of the chosen candidates."""
        def pick(x: pd.Series, ranks: pd.Series, prediction: pd.Series) -> pd.Series:
            out: list = []
            leaves = max(1, len(self.e.boxes[2]))
            size = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // leaves))
            for s in range(0, len(x), size):
                part = slice(s, s + size)
                out += self.best(np.stack(x.iloc[part].to_numpy()).astype(float), np.stack(ranks.iloc[part].to_numpy()).astype(float),
                                 prediction.iloc[part].to_numpy(), k)
            return pd.Series(out, index=x.index, dtype=object)

        return F.pandas_udf(pick, T.ArrayType(T.ArrayType(T.IntegerType())))


# --- attribution ----------------------------------------------------------------------------------
def background(df: DataFrame, features: list[str], n: int | None = 100, key: str = "row_id", seed: int = 42, most: int = 1000) -> np.ndarray:
    """All rows, or n in hash order, as a matrix on the driver; more than ``most`` are refused."""
    rows = (df if n is None else take_by_hash(df, key, n, seed)).select(*[filled(f).alias(f) for f in features])
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a background of more than {most} rows; draw a sample")
    return np.array([tuple(r) for r in got], dtype=float).reshape(-1, len(features))


class Explainer:
    """Interventional Shapley values of a tree ensemble against background rows, exact.

    For a leaf and a pair of rows only three counts matter: of its features, how many agree with the explained row only, with the
    background row only, or with both. Background rows that agree alike are counted together.
    """

    def __init__(self, ensemble: Ensemble, rows: np.ndarray):
        if not len(rows):
            raise ValueError("an empty background")
        self.e, d = ensemble, len(ensemble.features)
        agree = ensemble.agreeing(ensemble.cells(rows))
        leaf, mask, weight = [], [], []
        for i in range(agree.shape[1]):
            kinds, n = np.unique(agree[:, i], return_counts=True)
            leaf.append(np.full(len(kinds), i))
            mask.append(kinds)
            weight.append(n / len(rows))
        self.leaf, self.mask, self.weight = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in (leaf, mask, weight))
        self.base = float(ensemble.margins(rows).mean())
        # share of a leaf's value for a feature on the row's side, by the sizes of both sides
        self.share = np.array([[factorial(a - 1) * factorial(b) / factorial(a + b) if a else 0.0 for b in range(d + 1)] for a in range(d + 1)])

    def values(self, x: np.ndarray) -> np.ndarray:
        d, value = len(self.e.features), self.e.boxes[2]
        out, every = np.zeros((len(x), d)), (1 << d) - 1
        size = max(1, CELLS_AT_ONCE // max(1, len(self.leaf)))
        for s in range(0, len(x), size):
            mine = self.e.agreeing(self.e.cells(x[s:s + size]))[:, self.leaf]
            row, g = np.nonzero(((mine | self.mask) == every) & (mine != self.mask))
            own, other = mine[row, g] & ~self.mask[g], self.mask[g] & ~mine[row, g]
            a, b = (np.sum([(m >> f) & 1 for f in range(d)], axis=0) for m in (own, other))
            worth = value[self.leaf[g]] * self.weight[g]
            gain, loss = worth * self.share[a, b], worth * self.share[b, a]
            for f in range(d):
                part = gain * ((own >> f) & 1) - loss * ((other >> f) & 1)
                out[s:s + size, f] = np.bincount(row, part, minlength=len(mine))
        return out


def attribution(df: DataFrame, explainer: Explainer) -> DataFrame:
    """Adds phi_<feature> and baseline: their sum is the margin (log-odds, or the probability of a forest)."""
    def run(x: pd.Series) -> pd.Series:
        values = explainer.values(np.stack(x.to_numpy()).astype(float)) if len(x) else np.zeros((0, 0))
        return pd.Series(list(values), index=x.index, dtype=object)

    phi = F.pandas_udf(run, T.ArrayType(T.DoubleType()))(vector(explainer.e))
    out = df.withColumn("_phi", phi)
    return out.withColumns({f"phi_{c}": F.get("_phi", F.lit(i)) for i, c in enumerate(explainer.e.features)}).withColumn(
        "baseline", F.lit(explainer.base)).drop("_phi")
