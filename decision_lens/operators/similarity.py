"""Pairwise cosine statistics of explanation vectors.

Two exact routes:

* ``moment_stats``: mean, standard deviation and count of every pair class from group sums.
  For unit vectors the sum of all pairwise cosines is (|sum u|^2 - n) / 2 and the sum of their
  squares (|sum u u'|_F^2 - n) / 2, so the work is linear in the number of vectors.
* ``view_stats``: median, minimum and maximum need every pair. Vectors are packed in blocks,
  a grid cell multiplies the blocks of two tiles, and returns only counts per value bin, for all groupings at once. The bin
  that holds the median is split again until few enough values are left in it to rank
  them. No pair is ever a row outside that last bin.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from decision_lens.functions.sampling import number_by_hash
from decision_lens.schemas import PAIR_CLASSES
from decision_lens.session import freeze, join_small, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUPINGS = {"overall": (), "by_llm": ("llm_name",), "by_outcome": ("outcome",), "by_llm_outcome": ("llm_name", "outcome")}
GROUP = ["grouping", "llm_name", "outcome"]
ANY = "*"
HOT_ROWS = 4096
BLOCK_ROWS = 1024
STRIP_ROWS = 128
MERGED_VALUES = 100_000
BINS = 4096
RANKED_VALUES = 100_000


def unit(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors scaled to length 1 as doubles; zero vectors stay zero, nulls drop out."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.filter(F.col(vector).isNotNull()).withColumn("_n", norm).withColumn(
        "u", F.transform(v, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0))).drop("_n", vector)



def grouped(df: DataFrame) -> DataFrame:
    """Every row once per grouping; keys a grouping does not use hold '*'."""
    cells = [F.struct(F.lit(g).alias("grouping"), *[
        (F.col(c) if c in used else F.lit(ANY)).alias(c) for c in ("llm_name", "outcome")]) for g, used in GROUPINGS.items()]
    others = [c for c in df.columns if c not in ("llm_name", "outcome")]
    return df.select(F.inline(F.array(*cells)), *others)


# --- moments ----------------------------------------------------------------------------
def _partials(batches, keys: list[str]):
    """Per partition and key: n, sum of squared lengths, sum vector, sum of outer products."""
    held: dict = {}
    for pdf in batches:
        for key, part in pdf.groupby(keys, sort=False):
            m = np.stack(part["u"].to_numpy())
            n, live, s, g = held.get(key, (0, 0.0, 0.0, 0.0))
            held[key] = (n + len(m), live + float((m * m).sum()), s + m.sum(axis=0), g + m.T @ m)
        if len(held) > 256:
            yield _partial_frame(held, keys)
            held = {}
    if held:
        yield _partial_frame(held, keys)


def _partial_frame(held: dict, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(list(held), columns=keys)
    out["n"] = [h[0] for h in held.values()]
    out["live"] = [h[1] for h in held.values()]
    out["cells"] = [np.concatenate([h[2], h[3].ravel()]).tolist() for h in held.values()]
    out["d"] = [len(h[2]) for h in held.values()]
    return out


def _small_groups(batches, keys: list[str]):
    """Sums of whole small groups from batches sorted by key; the last group waits for the next batch."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
        held = pdf.iloc[starts[-1]:]
        if len(starts) > 1:
            yield _group_frame(pdf, starts, keys)
    if held is not None and len(held):
        yield _group_frame(held, np.array([0, len(held)]), keys)


def _group_frame(pdf: pd.DataFrame, bounds: np.ndarray, keys: list[str]) -> pd.DataFrame:
    """One row per group between consecutive bounds."""
    u = np.stack(pdf["u"].iloc[:bounds[-1]].to_numpy())
    lengths = (u * u).sum(axis=1)
    out = pdf[keys].iloc[bounds[:-1]].reset_index(drop=True)
    groups = [u[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
    grams = [m @ m.T if len(m) <= m.shape[1] else m.T @ m for m in groups]
    out["n"] = np.diff(bounds)
    out["live"] = np.add.reduceat(lengths, bounds[:-1])
    out["s2"] = (np.add.reduceat(u, bounds[:-1], axis=0) ** 2).sum(axis=1)
    out["g2"] = [float((g * g).sum()) for g in grams]
    out["fourth"] = np.add.reduceat(lengths ** 2, bounds[:-1])
    return out


def pair_sums(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, n, pairs, total, squares): count, sum and sum of squares of the cosines inside each key.

    Keys of up to ``hot_rows`` rows are brought together and handled whole. Larger ones are reduced to
    one sum vector and one outer-product matrix per partition before anything is shuffled.
    Key columns must not be null.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = freeze(sizes.filter(F.col("_rows") > hot_rows).drop("_rows"))
    types = {f.name: f.dataType for f in df.schema.fields}
    key_fields = [T.StructField(k, types[k]) for k in keys]
    numbers = [T.StructField(n, T.DoubleType()) for n in ("live", "s2", "g2", "fourth")]
    small_schema = T.StructType([*key_fields, T.StructField("n", T.LongType()), *numbers])
    rows = df.select(*keys, "u")
    no_hot = hot[1] and hot[0].isEmpty()
    small = rows if no_hot else join_small(rows, hot, keys, "left_anti")
    sums = small.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(
        lambda it: _small_groups(it, keys), small_schema)
    if not no_hot:
        schema = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("live", T.DoubleType()),
                               T.StructField("cells", T.ArrayType(T.DoubleType())), T.StructField("d", T.IntegerType())])
        partial = join_small(rows, hot, keys).mapInPandas(lambda it: _partials(it, keys), schema)
        cells = (partial.select(*keys, "n", "live", "d", F.posexplode("cells").alias("i", "x"))
                 .groupBy(*keys, "d", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("live").alias("live")))
        square = F.col("x") * F.col("x")
        whole = cells.groupBy(*keys).agg(
            F.max("n").alias("n"), F.max("live").alias("live"),
            F.sum(F.when(F.col("i") < F.col("d"), square).otherwise(0.0)).alias("s2"),
            F.sum(F.when(F.col("i") >= F.col("d"), square).otherwise(0.0)).alias("g2"))
        # lengths are 0 or 1, so the fourth powers add up to the same as the squares
        sums = sums.unionByName(whole.withColumn("fourth", F.col("live")))
    return sums.select(*keys, "n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
                       ((F.col("s2") - F.col("live")) / 2).alias("total"),
                       ((F.col("g2") - F.col("fourth")) / 2).alias("squares"))


def _signed(sums: DataFrame, by: list[str], name: str, sign: int) -> DataFrame:
    return sums.select(*by, F.lit(name).alias("pair_class"), *[
        (F.col(c) * sign).alias(c) for c in ("pairs", "total", "squares")])


def _finish(parts: list[DataFrame], by: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy(*by, "pair_class").agg(*[F.sum(c).alias(c) for c in ("pairs", "total", "squares")])
    mean = F.when(F.col("pairs") > 0, F.try_divide(F.col("total"), F.col("pairs")))
    var = F.try_divide(F.col("squares"), F.col("pairs")) - F.col("mean") * F.col("mean")
    return out.withColumn("mean", mean).withColumn(
        "std", F.when(F.col("pairs") > 0, F.sqrt(F.greatest(F.lit(0.0), var)))).select(
        *by, "pair_class", F.col("pairs").alias("count"), "mean", "std")


def moment_stats(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, population std and count per grouping and pair class, linear in the rows.

    same_instance = same prediction - same prediction and regeneration; intra = same cluster -
    same prediction; inter = all with a cluster - same cluster (a prediction has one cluster).
    """
    rows = grouped(df)
    placed = rows.filter(F.col("cluster_id").isNotNull())
    everything, clustered = pair_sums(rows, GROUP, hot_rows), pair_sums(placed, GROUP, hot_rows)
    cluster = pair_sums(placed, [*GROUP, "cluster_id"], hot_rows)
    instance = pair_sums(rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))),
                         [*GROUP, "prediction_id", "cluster_id"], hot_rows)
    repeat = pair_sums(rows, [*GROUP, "prediction_id", "regeneration_number"], hot_rows)
    parts = [_signed(everything, GROUP, "random_baseline", 1), _signed(instance, GROUP, "same_instance", 1),
             _signed(repeat, GROUP, "same_instance", -1), _signed(cluster, GROUP, "intra_cluster", 1),
             _signed(instance.filter("cluster_id <> -1"), GROUP, "intra_cluster", -1),
             _signed(clustered, GROUP, "inter_cluster", 1), _signed(cluster, GROUP, "inter_cluster", -1)]
    alone = everything.filter("n < 2").select(*GROUP)
    return _finish(parts, GROUP).join(alone, GROUP, "left_anti")


def cluster_moments(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The intra-cluster figures of every cluster."""
    placed = df.filter(F.col("cluster_id").isNotNull())
    return _finish([_signed(pair_sums(placed, ["cluster_id"], hot_rows), ["cluster_id"], "intra_cluster", 1),
                    _signed(pair_sums(placed, ["cluster_id", "prediction_id"], hot_rows), ["cluster_id"], "intra_cluster", -1)],
                   ["cluster_id"])


# --- order statistics -------------------------------------------------------------------
def _bin(v: np.ndarray, low: float, width: float) -> np.ndarray:
    return np.clip((v - low) / width * BINS, 0, BINS - 1).astype(np.int64)


def _next(path: tuple) -> tuple[float, float]:
    """Range of the values that are counted next: the last chosen bin, or all of [-1, 1]."""
    if not path:
        return -1.0, 2.0
    low, width, chosen = path[-1]
    return low + chosen * width / BINS, width / BINS


class _Block:
    """Vectors of one key with what tells their pairs apart, and a ball that holds them."""

    def __init__(self, row: dict):
        n = row["n"]
        self.home, self.idx, self.ks = row["home"], row["idx"], row["ks"]
        if "data" in row:
            self.u = np.frombuffer(row["data"], dtype=np.float64).reshape(n, -1)
            self.p, self.r, self.c = (np.frombuffer(row[x], dtype=np.int64) for x in ("p", "r", "c"))
        self.centre, self.radius = np.frombuffer(row["centre"], dtype=np.float64), row["radius"]
        known = row.get("paths")
        self.paths = None if known is None else {
            (x["view"], x["pair_class"], x["target"]): tuple((s["low"], s["width"], s["chosen"]) for s in x["path"]) for x in json.loads(known)}

    def views(self, other: "_Block") -> list[int]:
        return [v for v, (x, y) in enumerate(zip(self.ks, other.ks)) if x == y]

    def range(self, other: "_Block") -> tuple[float, float]:
        """Bounds of every cosine between the two blocks, by their centres and radii."""
        middle = float(self.centre @ other.centre)
        reach = self.radius * float(np.linalg.norm(other.centre)) + other.radius * float(np.linalg.norm(self.centre)) + self.radius * other.radius + 1e-9
        return middle - reach, middle + reach

    def matters(self, other: "_Block", wanted: list[str]) -> bool:
        """Whether a pair of the two blocks can fall into a range that is still searched."""
        views = self.views(other)
        if not views or self.paths is None:
            return bool(views)
        low, high = self.range(other)
        for v in views:
            for name in wanted:
                for target in (0, 1):
                    path = self.paths.get((v, name, target))
                    if path is not None:
                        start, width = _next(path)
                        if low <= start + width and high >= start:
                            return True
        return False


def _classes(a: _Block, b: _Block, wanted: list[str], rows: slice):
    """Each class with its pairs of the given rows of a block and those of another, one class at a time; None is all of them."""
    p, r, c = (x[rows, None] for x in (a.p, a.r, a.c))
    same = p == b.p
    masks = {"same_instance": lambda: same & (r != b.r),
             "intra_cluster": lambda: ~same & (c >= 0) & (c == b.c), "inter_cluster": lambda: ~same & (c >= 0) & (b.c >= 0) & (c != b.c),
             "random_baseline": lambda: None}
    return ((name, masks[name]()) for name in wanted)


def _inside(v: np.ndarray, path: tuple) -> np.ndarray:
    """The values that fall into the chosen bin of every step of a path."""
    if path:
        start, width = _next(path)
        v = v[(v >= start - 1e-9) & (v <= start + width + 1e-9)]  # few are left to be told apart exactly
        for low, width, chosen in path:
            v = v[_bin(v, low, width) == chosen]
    return v


class _Counts:
    """Counts per value bin (or per value inside the last bin) of every view, key, class and target, added up over block pairs.

    Counts by bin are arrays of BINS, whatever the number of pairs. Values are those inside a bin that holds few, and
    are added up again when many have come together.
    """

    def __init__(self, wanted: list[str], values: bool):
        self.wanted, self.values = wanted, values
        self.found: dict[tuple, list] = {}

    def add(self, a: _Block, b: _Block) -> None:
        for first in range(0, len(a.u), STRIP_ROWS):
            self.add_strip(a, b, first, min(first + STRIP_ROWS, len(a.u)))

    def add_strip(self, a: _Block, b: _Block, first: int, last: int) -> None:
        """Pairs of the rows [first, last) of a block with those of another."""
        dots = np.clip(a.u[first:last] @ b.u.T, -1.0, 1.0)
        upper = np.arange(first, last)[:, None] < np.arange(len(b.u)) if a.idx == b.idx else None
        views = a.views(b)
        for name, mask in _classes(a, b, self.wanted, slice(first, last)):
            if mask is None:
                found = dots.ravel() if upper is None else dots[upper]
            else:
                found = dots[mask if upper is None else mask & upper]
            if not len(found):
                continue
            ends, counted = (float(found.min()), float(found.max())), {}
            for v in views:
                for target in (0, 1):
                    path = () if a.paths is None else a.paths.get((v, name, target))
                    if path is None:
                        continue
                    if path not in counted:
                        inside = _inside(found, path)
                        counted[path] = np.unique(inside, return_counts=True) if self.values else (
                            np.bincount(_bin(inside, *_next(path)), minlength=BINS) if len(inside) else inside)
                    self.keep((v, a.ks[v], name, target), counted[path], *ends)

    def keep(self, key: tuple, counted, low: float, high: float) -> None:
        if not len(counted[0] if self.values else counted):
            return
        if key not in self.found:
            self.found[key] = [[], [], 0, low, high] if self.values else [np.zeros(BINS, dtype=np.int64), low, high]
        kept = self.found[key]
        kept[-2:] = min(kept[-2], low), max(kept[-1], high)
        if not self.values:
            kept[0] += counted
            return
        kept[0].append(counted[0])
        kept[1].append(counted[1])
        kept[2] += len(counted[0])
        if kept[2] > MERGED_VALUES:
            at, n = _summed(kept[0], kept[1])
            kept[:3] = [at], [n], 0

    def table(self) -> pa.Table:
        made = []
        for (v, k, name, target), kept in self.found.items():
            if self.values:
                places, sums = _summed(kept[0], kept[1])
            else:
                places = np.flatnonzero(kept[0])
                sums = kept[0][places]
            m = len(places)
            made.append(pa.Table.from_arrays([
                pa.array([v] * m, pa.int32()), pa.array([k] * m, pa.string()), pa.array([name] * m, pa.string()), pa.array([target] * m, pa.int32()),
                pa.array(np.zeros(m, np.int32) if self.values else places.astype(np.int32)), pa.array(sums),
                pa.array(places if self.values else np.full(m, kept[-2])), pa.array(places if self.values else np.full(m, kept[-1]))], schema=COUNTS))
        return pa.concat_tables(made) if made else COUNTS.empty_table()


def _summed(at: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their counts."""
    places, where = np.unique(np.concatenate(at), return_inverse=True)
    return places, np.bincount(where, np.concatenate(n)).astype(np.int64)


COUNTS = pa.schema([("view", pa.int32()), ("k", pa.string()), ("pair_class", pa.string()), ("target", pa.int32()), ("bin", pa.int32()), ("n", pa.int64()),
                    ("lo", pa.float64()), ("hi", pa.float64())])
COUNTS_DDL = "view int, k string, pair_class string, target int, bin int, n long, lo double, hi double"
BLOCK_DDL = "n int, data binary, p binary, r binary, c binary, centre binary, radius double"


def _tile(table: pa.Table, wanted: list[str], values: bool) -> pa.Table:
    """One grid cell: all block pairs between two tiles that can still matter, in turn."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    held = [c for c, t in zip(table.column_names, table.schema.types) if pa.types.is_binary(t)]
    # binary values are read where they lie
    rows = [_Block(r | dict(zip(held, (x.as_buffer() for x in own)))) for r, own in zip(table.drop_columns(held).to_pylist(), zip(*(table.column(c) for c in held)))]
    tiles = table.column("tile").to_pylist()
    first, second = ([b for b, t in zip(rows, tiles) if t == x] for x in (i, j))
    counts = _Counts(wanted, values)
    for a in first:
        for b in second:
            if (i != j or a.idx <= b.idx) and a.matters(b, wanted):
                counts.add(a, b)
    return counts.table()


def _text(columns: tuple | list) -> F.Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns])) if columns else F.lit("{}")


def block_table(df: DataFrame, part: list[str], views: list[tuple], key: str, block_rows: int) -> DataFrame:
    """Staged blocks of up to ``block_rows`` vectors that agree in ``part``: home, ks (key by view), idx (place within the home), data, ball.

    Blocks meet only within their home, the columns that all views share.
    """
    common = [c for c in part if all(c in v for v in views)]
    numbered = number_by_hash(df, key, by=tuple(part), name="row_no")
    rows = numbered.select(*part, "u", F.xxhash64("prediction_id").alias("p"), F.col("regeneration_number").cast("long").alias("r"),
                           F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("c"), "row_no", F.floor((F.col("row_no") - 1) / block_rows).cast("int").alias("blk"))
    blocks = rows.groupBy(*part).agg((F.max("blk") + 1).alias("many"))
    order = Window.partitionBy("home").orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = freeze(blocks.withColumn("home", _text(common)).select(*part, "home", F.coalesce(F.sum("many").over(order), F.lit(0)).alias("start")))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join([*[f"`{c}` {types[c]}" for c in part], "blk int", BLOCK_DDL])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_no")
        m = np.stack([np.asarray(x, dtype=float) for x in table.column("u").to_pylist()])
        centre = m.mean(axis=0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max())
        number = lambda c: np.asarray(table.column(c).fill_null(NO_REPEAT)).astype(np.int64).tobytes()
        new = {"n": pa.array([len(m)], pa.int32()), "data": pa.array([m.tobytes()], pa.binary()), **{c: pa.array([number(c)], pa.binary()) for c in "prc"},
               "centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius])}
        head = table.slice(0, 1).select([*part, "blk"]).combine_chunks()
        return pa.Table.from_arrays([*[head.column(c) for c in head.column_names], *new.values()], names=[*head.column_names, *new])

    packed = join_small(rows.groupBy(*part, "blk").applyInArrow(pack, ddl), starts, part)
    return stage(packed.select("home", F.array(*[_text(v) for v in views]).alias("ks"), (F.col("start") + F.col("blk")).cast("long").alias("idx"),
                               "n", "data", "p", "r", "c", "centre", "radius"))


NO_REPEAT = -1
TILE_BYTES = 8 << 20


def view_stats(df: DataFrame, part: list[str], views: list[tuple], classes: list[str] = PAIR_CLASSES, key: str = "vec_id",
               block_rows: int = BLOCK_ROWS, ranked_values: int = RANKED_VALUES) -> DataFrame:
    """(view, k, pair_class, median, min, max): exact order statistics of all cosines, for several views at once.

    A view is a subset of ``part``, and k is its key as JSON. Blocks agree in all of ``part``, so two blocks belong to a view as a whole: one
    product of them counts for every view. Blocks travel in tiles of bounded size. After the first count only tiles are sent, and
    only blocks multiplied, whose cosines can reach a range that is still searched, by the balls around the blocks. Work is quadratic
    in the rows of a home by nature. Key columns must not be null.
    """
    blocks = block_table(df, part, views, key, block_rows)
    width = blocks.agg(F.max(F.octet_length("data"))).first()[0] or 1
    tile = max(1, TILE_BYTES // width)
    blocks = blocks.withColumn("tile", F.floor(F.col("idx") / tile).cast("int"))
    last = freeze(blocks.groupBy("home").agg(F.max("tile").alias("last")))
    group = ["view", "k", "pair_class", "target"]

    def spread(rows: DataFrame) -> DataFrame:
        return join_small(rows, last, "home").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn(
            "i", F.least("tile", "o")).withColumn("j", F.greatest("tile", "o")).drop("last", "o")

    def counted(state, values):
        if state is None:
            return spread(blocks.withColumn("paths", F.lit(None).cast("string"))).groupBy("home", "i", "j").applyInArrow(
                lambda t: _tile(t, classes, values), COUNTS_DDL)
        # the paths of a block's views go with it
        paths = state.groupBy("view", "k").agg(F.collect_list(F.struct("view", "pair_class", "target", "path")).alias("found"))
        each = blocks.select("home", "idx", F.posexplode("ks").alias("view", "k")).join(paths, ["view", "k"])
        known = stage(each.groupBy("home", "idx").agg(F.to_json(F.flatten(F.collect_list("found"))).alias("paths")))
        placed = blocks.join(known, ["home", "idx"])
        balls = spread(placed.select("home", "idx", "ks", "n", "centre", "radius", "paths", "tile"))

        def check(t: pa.Table) -> pa.Table:
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            rows, tiles = [_Block(r) for r in t.to_pylist()], t.column("tile").to_pylist()
            first, second = ([b for b, x in zip(rows, tiles) if x == y] for y in (i, j))
            needed = any(a.matters(b, classes) for a in first for b in second if i != j or a.idx <= b.idx)
            head = [rows[0].home] if needed else []
            return pa.Table.from_arrays([pa.array(head, pa.string()), pa.array([i] * len(head), pa.int32()), pa.array([j] * len(head), pa.int32())], names=["home", "i", "j"])

        wanted = stage(balls.groupBy("home", "i", "j").applyInArrow(check, "home string, i int, j int"))
        return spread(placed).join(wanted, ["home", "i", "j"], "left_semi").groupBy("home", "i", "j").applyInArrow(
            lambda t: _tile(t, classes, values), COUNTS_DDL)

    def placed_ranks(frame, place, state):
        """Rows that hold the wanted rank of their group."""
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
        whole = Window.partitionBy(*group)
        found = frame.withColumn("upto", upto)
        if state is None:
            total = F.sum("n").over(whole)
            found = found.select("*", F.floor((total - 1 + F.col("target")) / 2).alias("rank"), F.lit([]).cast("array<struct<low: double, width: double, chosen: int>>").alias("path"),
                                 F.min("lo").over(whole).alias("low"), F.max("hi").over(whole).alias("high"))
        else:
            found = found.drop("lo", "hi").join(state.select(*group, "rank", "path", "low", "high"), group)
        return found.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))

    last_step = F.try_element_at("path", F.lit(-1))
    grown = F.concat("path", F.array(F.struct(
        F.when(F.size("path") == 0, -1.0).otherwise(last_step["low"] + last_step["chosen"] * last_step["width"] / BINS).alias("low"),
        F.when(F.size("path") == 0, 2.0).otherwise(last_step["width"] / BINS).alias("width"), F.col("bin").alias("chosen"))))

    state = None
    for _ in range(4):
        bins = counted(state, False).groupBy(*group, "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        hit = placed_ranks(bins, "bin", state)
        state = stage(hit.select(*group, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "n",
                                 grown.alias("path"), "low", "high"))
        if (state.agg(F.max("n")).first()[0] or 0) <= ranked_values:
            break
    inside = counted(state, True).groupBy(*group, F.col("lo").alias("v")).agg(F.sum("n").alias("n"))
    found = placed_ranks(inside, "v", state)
    return found.groupBy("view", "k", "pair_class").agg((F.sum("v") / 2).alias("median"), F.max("low").alias("min"), F.max("high").alias("max"))


def order_stats(df: DataFrame, keys: list[str], classes: list[str] = PAIR_CLASSES, key: str = "vec_id",
                block_rows: int = BLOCK_ROWS, ranked_values: int = RANKED_VALUES) -> DataFrame:
    """Exact median, minimum and maximum cosine per key and pair class."""
    out = view_stats(df, keys, [tuple(keys)], classes, key, block_rows, ranked_values)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return out.withColumn("_k", F.from_json("k", ", ".join(f"`{c}` {types[c]}" for c in keys))).select("_k.*", "pair_class", "median", "min", "max")


# --- combined results -------------------------------------------------------------------
def pair_stats(df: DataFrame, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS, ranked_values: int = RANKED_VALUES) -> DataFrame:
    """count, mean, std, median, min, max per grouping and pair class; null where there is no pair."""
    names = list(GROUPINGS)
    found = view_stats(df, ["llm_name", "outcome"], list(GROUPINGS.values()), block_rows=block_rows, ranked_values=ranked_values)
    k = F.from_json("k", "llm_name string, outcome string")
    ordered = found.select(F.element_at(F.array(*map(F.lit, names)), F.col("view") + 1).alias("grouping"), *[
        F.coalesce(k[c], F.lit(ANY)).alias(c) for c in ("llm_name", "outcome")], "pair_class", "median", "min", "max")
    return moment_stats(df, hot_rows).join(ordered, [*GROUP, "pair_class"], "left")


def run_record(df: DataFrame, text: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One record of a whole similarity run (J9): rows given and used, dimension, and the figures per grouping with their summary.

    Rows without a vector (and, if ``text`` is named, without text) are left out and counted. Fewer than two rows give a record with
    the status "too_few" and no figures.
    """
    given = df.count()
    live = usable(df, text) if text else df
    live = stage(live.filter(F.col("u").isNotNull()))
    sizes = live.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("d"), F.countDistinct("prediction_id").alias("predictions"), F.countDistinct("cluster_id").alias("clusters")).first()
    head = [F.lit(given).cast("long").alias("n_given"), F.lit(sizes["n"]).cast("long").alias("n_used"), F.lit(sizes["d"]).cast("int").alias("dimension"),
            F.lit(sizes["predictions"]).cast("long").alias("n_predictions"), F.lit(sizes["clusters"]).cast("long").alias("n_clusters")]
    kind = "array<struct<grouping:string,llm_name:string,outcome:string,pair_class:string,count:bigint,mean:double,std:double,median:double,min:double,max:double>>"
    if sizes["n"] < 2:
        return df.sparkSession.range(1).select(F.lit("too_few").alias("status"), *head, F.array().cast(kind).alias("stats"), F.lit(None).cast("double").alias("consistency"),
                                               F.lit(None).cast("boolean").alias("order_correct"))
    stats = stage(pair_stats(live, block_rows))
    overall = stats.filter("grouping = 'overall'")
    one = consistency(overall).select("consistency").first()
    order = hierarchy(overall).select("order_correct").first()
    rows = stats.agg(F.sort_array(F.collect_list(F.struct("grouping", "llm_name", "outcome", "pair_class", "count", "mean", "std", "median", "min", "max"))).cast(kind).alias("stats"))
    return rows.select(F.lit("ok").alias("status"), *head, "stats", F.lit(one["consistency"] if one else None).cast("double").alias("consistency"),
                       F.lit(order["order_correct"] if order else None).cast("boolean").alias("order_correct"))


def consistency(stats: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """(intra mean - inter mean) / baseline std per group; null when a class is empty or the std is 0."""
    def pick(name, column):
        return F.max(F.when(F.col("pair_class") == name, F.col(column)))
    row = stats.groupBy(*by).agg(pick("intra_cluster", "mean").alias("intra_mean"),
                                 pick("inter_cluster", "mean").alias("inter_mean"),
                                 pick("random_baseline", "std").alias("baseline_std"))
    return row.withColumn("consistency", F.when(F.col("baseline_std") > 0, F.try_divide(
        F.col("intra_mean") - F.col("inter_mean"), F.col("baseline_std"))))


def hierarchy(stats: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Classes ranked by mean (four at most per group) and whether they come in the expected order."""
    present = stats.filter((F.col("count") > 0) & F.col("mean").isNotNull())
    position = F.array_position(F.array(*[F.lit(c) for c in PAIR_CLASSES]), F.col("pair_class"))
    ranked = present.groupBy(*by).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("mean")).alias("m"), position.alias("p"), "pair_class"))).alias("_r"))
    names = F.transform("_r", lambda x: x["pair_class"])
    return ranked.select(*by, names.alias("ranking"), (names == F.array(*[F.lit(c) for c in PAIR_CLASSES])).alias("order_correct"))


def usable(df: DataFrame, text: str) -> DataFrame:
    """Rows with text; a set of fewer than two has no pairs."""
    return df.filter(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
