"""Approximate nearest neighbours by largest inner product: balanced posting lists of replicated vectors.

Inner products become distances by one more component (the part that a vector lacks to the greatest length), so vectors of any
length can be clustered. Centroids are fitted in numpy by k-means whose cost grows with the size of a cluster, on at most FIT_ROWS rows
(FIT_BYTES in all) with the least hashes; there is one for each LIST_ROWS rows, MOST_LISTS at most, so they and the neighbour graph
on them fit into every task. Spark then files every row: a best-first search on the graph finds the nearest centroids, and a row goes
to each of the COPIES nearest ones that are less than BORDER farther than the nearest. Lists are shuffled by list number; those with
more than PART_ROWS rows, say of one vector that a third of the rows share, are dealt into parts, and so are the queries of a list.

A query searches all lists not farther than (1 + ratio) times its nearest one, however many these are. The ratio is fitted: for up to
PROBES queries (least hashes) the true neighbours are found by a scan in Spark, and the ratio is the one at which a share of TARGET of
them lies in a searched list. A query's FIRST nearest lists are searched first; their k-th score is the floor that rows of its other
lists must reach, so that what is sent to the final choice does not grow with the number of lists. Scores are computed anew in double
precision on the original vectors.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; shorter vectors count as padded with
zeros; a null id is no query and comes after every other id; repeated rows are candidates of their own, and a repeated query has results
for each of its rows; up to LIST_ROWS rows there is one list, which is exact; an empty table gives an empty result; further
columns are not carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from decision_lens.llm.blocks import NO_ID
from decision_lens.llm.textkit import quoted
from decision_lens.session import stage

LIST_ROWS, MOST_LISTS, PART_ROWS = 512, 4096, 4096
FIT_ROWS, FIT_BYTES, ROUNDS, PUSH = 32_768, 16 << 20, 12, 0.1
LINKS, STARTS, LEAST = 16, 8, 32
COPIES, BORDER = 2, 0.1
PROBES, TARGET = 256, 0.96
FIRST = 4
AT_ONCE = 256


def matrix(column, kind, width: int) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    values = column.to_pylist()
    full = width * np.dtype(kind).itemsize
    return np.frombuffer(b"".join(v.ljust(full, b"\0") for v in values), dtype=kind).reshape(len(values), width)


def vectors(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, object]:
    """Staged (place, vec_id, data, norm, width) of the rows that take part; a component keeps its type."""
    single = isinstance(rows.schema[vector].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64
    v = quoted(vector).cast("array<float>" if single else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    slim = rows.where(quoted(vector).isNotNull() & fine).select(F.coalesce(quoted(vec_id).cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"))

    def pack(batches):
        for batch in batches:
            col = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(col)))]).astype(int)
            flat = np.asarray(pa.compute.list_flatten(col)).astype(kind)
            each = [flat[a:b] for a, b in zip(ends, ends[1:])]
            most = [float(np.abs(x).max()) for x in each]
            norms = [m * float(np.sqrt(np.sum((x.astype(np.float64) / m) ** 2))) for x, m in zip(each, most)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in each], pa.binary()), pa.array(norms, pa.float64()),
                                              pa.array([len(x) for x in each], pa.int32())], names=["vec_id", "data", "norm", "width"])

    packed = slim.mapInArrow(pack, "vec_id long, data binary, norm double, width int")
    return stage(packed.withColumn("place", F.monotonically_increasing_id())), kind


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows of length 1 whose distances order as inner products do."""
    y = x.astype(np.float64) / longest
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1)))[:, None]], axis=1).astype(np.float32)


def asked(x: np.ndarray) -> np.ndarray:
    """Queries on the same sphere; their length does not change the order."""
    y = x.astype(np.float64)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    y = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    return np.concatenate([y, np.zeros((len(y), 1))], axis=1).astype(np.float32)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Balanced k-means: a cluster above the average size costs more in the next round."""
    rng = np.random.default_rng(0)
    sample = np.unique(sample, axis=0)
    k = min(k, len(sample))
    c, push = sample[np.sort(rng.choice(len(sample), k, replace=False))].copy(), np.zeros(k, dtype=np.float32)
    for _ in range(ROUNDS):
        sums, size, near = np.zeros_like(c, dtype=np.float64), np.zeros(k), 0.0
        for i in range(0, len(sample), 2048):
            part = sample[i:i + 2048]
            d = squares(part, c)
            at = (d + push).argmin(axis=1)
            near += float(d[np.arange(len(part)), at].sum())
            np.add.at(sums, at, part)
            size += np.bincount(at, minlength=k)
        used = size > 0
        c[used] = (sums[used] / size[used, None]).astype(np.float32)
        c[~used] = sample[rng.choice(len(sample), int((~used).sum()))]
        push += np.float32(PUSH * near / len(sample)) * np.clip(size * k / len(sample) - 1, -1, 1).astype(np.float32)
    return c


class Graph:
    """Centroids, each linked with its nearest ones, those that it is near to, and the next one."""

    def __init__(self, c: np.ndarray):
        self.c, k = c, len(c)
        m = min(LINKS, k - 1)
        near = np.zeros((k, m), dtype=np.int32)
        for i in range(0, k, 512):
            d = squares(c[i:i + 512], c)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            if m:
                near[i:i + 512] = np.argpartition(d, m - 1, axis=1)[:, :m]
        back: list[list[int]] = [[] for _ in range(k)]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(back[j]) < LINKS:
                    back[j].append(i)
        more = np.array([b + [i] * (LINKS - len(b)) for i, b in enumerate(back)], dtype=np.int32).reshape(k, LINKS)
        self.links = np.concatenate([near, more, ((np.arange(k) + 1) % k)[:, None].astype(np.int32)], axis=1)

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances from every row to the centroids met (infinite for others); what lies within the ratio of the nearest is explored."""
        q, k = len(x), len(self.c)
        d, done = np.full((q, k), np.inf, dtype=np.float32), np.zeros((q, k), dtype=bool)
        start = np.unique(np.linspace(0, k - 1, min(k, STARTS)).astype(int))
        d[:, start] = np.sqrt(squares(x, self.c[start]))
        least = min(LEAST, k) - 1
        while True:
            bar = np.maximum(d.min(axis=1) * (1 + ratio), np.partition(d, least, axis=1)[:, least])
            a, node = np.nonzero((d <= bar[:, None]) & ~done & np.isfinite(d))
            if not len(a):
                return d
            done[a, node] = True
            a, to = np.repeat(a, self.links.shape[1]), self.links[node].ravel()
            new = ~np.isfinite(d[a, to])
            pairs = np.unique(a[new].astype(np.int64) * k + to[new])
            for i in range(0, len(pairs), 1 << 15):
                a, to = np.divmod(pairs[i:i + (1 << 15)], k)
                d[a, to] = np.sqrt(((x[a] - self.c[to]) ** 2).sum(axis=1))


def filed(v: DataFrame, graph: Graph, kind, width: int, longest: float) -> DataFrame:
    """(list, place, vec_id, data): every row in its nearest list and in the next ones near a border."""
    def run(batches):
        for batch in batches:
            x = lifted(matrix(batch.column("data"), kind, width), longest)
            for i in range(0, len(x), AT_ONCE):
                d = graph.search(x[i:i + AT_ONCE], BORDER)
                n = min(COPIES, d.shape[1])
                at = np.argsort(d, axis=1, kind="stable")[:, :n]
                far = np.take_along_axis(d, at, axis=1)
                row, j = np.nonzero(far <= far[:, :1] * (1 + BORDER))
                part = batch.slice(i, AT_ONCE).select(["place", "vec_id", "data"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at[row, j].astype(np.int32)), *part.columns], names=["list", "place", "vec_id", "data"])

    return v.select("place", "vec_id", "data").mapInArrow(run, "list int, place long, vec_id long, data binary")


def chosen(queries: DataFrame, graph: Graph, ratio: float, kind, width: int) -> DataFrame:
    """(list, nth, q_place, q_id, q_data): the lists that every query searches, nth from 0 by distance."""
    def run(batches):
        for batch in batches:
            x = asked(matrix(batch.column("data"), kind, width))
            for i in range(0, len(x), AT_ONCE):
                d = graph.search(x[i:i + AT_ONCE], ratio)
                row, at = np.nonzero(d <= d.min(axis=1)[:, None] * (1 + ratio))
                order = np.lexsort((d[row, at], row))
                row, at = row[order], at[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                part = batch.slice(i, AT_ONCE).select(["place", "vec_id", "data"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(nth.astype(np.int32)), *part.columns], names=["list", "nth", "q_place", "q_id", "q_data"])

    return queries.select("place", "vec_id", "data").mapInArrow(run, "list int, nth int, q_place long, q_id long, q_data binary")


HIT = pa.schema([("q_place", pa.int64()), ("q_id", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
HIT_DDL = "q_place long, q_id long, place long, vec_id long, score double"


def best_of(queries: tuple, rows: tuple, k: int, floor: np.ndarray | None = None) -> pa.Table:
    """The k rows with the greatest inner products for every query, ties by id; (places, ids, matrix) on both sides."""
    (q_place, q_id, q), (place, ids, x) = queries, rows
    floor = np.full(len(q), -np.inf) if floor is None else floor
    q, x = q.astype(np.float64), x.astype(np.float64)
    made = []
    for i in range(0, len(q) if len(x) else 0, AT_ONCE):
        part = q[i:i + AT_ONCE]
        s = part @ x.T
        own = q_place[i:i + AT_ONCE][:, None] == place[None, :]
        s[own] = -np.inf
        bar = np.partition(s, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
        bar = np.maximum(bar, floor[i:i + AT_ONCE])
        # products of whole matrices may differ in the last bits by place; near ties are judged by the exact sums
        slack = 1e-12 * np.sqrt((part * part).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0))
        a, b = np.nonzero((s >= (bar - slack)[:, None]) & ~own)
        exact = np.concatenate([(part[a[j:j + 65536]] * x[b[j:j + 65536]]).sum(axis=1) for j in range(0, len(a), 65536)] or [np.zeros(0)])
        order = np.lexsort((place[b], ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, exact = a[top], b[top], exact[top]
        made.append(pa.Table.from_arrays([pa.array(c) for c in (q_place[i + a], q_id[i + a], place[b], ids[b], exact)], schema=HIT))
    return pa.concat_tables(made) if made else HIT.empty_table()


def side(t: pa.Table, names: tuple[str, str, str], kind, width: int) -> tuple:
    place, ids, data = (t.column(c) for c in names)
    return np.asarray(place).astype(np.int64), np.asarray(ids).astype(np.int64), matrix(data, kind, width)


QUERY, ROW = ("q_place", "q_id", "q_data"), ("place", "vec_id", "data")


def merged(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a row that came from several lists counts once."""
    rank = F.dense_rank().over(Window.partitionBy("q_place").orderBy(F.desc("score"), "vec_id", "place"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["q_place", "rank"])


def parts_of(lists: DataFrame, name: str) -> DataFrame:
    """How many parts a list is dealt into; one row for each of at most MOST_LISTS lists."""
    return lists.groupBy(F.col("list").alias(f"l_{name}")).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias(name))


def searched(rows: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id is divisible by ``every``."""
    v, kind = vectors(rows, vec_id, vector)
    size = v.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"), F.max("width").alias("width")).first()
    n, longest, width = size["n"], size["longest"] or 1.0, size["width"] or 0
    queries = v.where((F.col("vec_id") != NO_ID) & (F.col("vec_id") % every == 0))
    sample = v.select("data").orderBy(F.xxhash64("data"), "data").limit(min(FIT_ROWS, max(1, FIT_BYTES // (4 * width + 4)))).toArrow()
    graph = Graph(centroids(lifted(matrix(sample.column("data"), kind, width), longest), max(1, -(-n // LIST_ROWS)))) if n else Graph(np.zeros((1, 1), np.float32))
    lists = stage(filed(v, graph, kind, width, longest))
    ratio = fitted_ratio(v, queries, lists, graph, kind, width, k) if len(graph.c) > 1 else 0.0
    probes = stage(chosen(queries, graph, ratio, kind, width))
    # hot lists are dealt into parts on both sides; a part of the rows meets every part of the queries
    row_parts, query_parts = parts_of(lists, "rows"), parts_of(probes, "asks")
    parts = row_parts.join(F.broadcast(query_parts), F.col("l_rows") == F.col("l_asks")).select("l_rows", "rows", "asks")
    every_part = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = lists.join(F.broadcast(parts), F.col("list") == F.col("l_rows")).withColumn("row", F.pmod(F.xxhash64("place"), F.col("rows")).cast("int")).withColumn("ask", every_part("asks"))
    keys = ["list", "row", "ask"]

    def meet(a, b):
        floor = np.asarray(a.column("floor").fill_null(-np.inf)).astype(np.float64)
        return best_of(side(a, QUERY, kind, width), side(b, ROW, kind, width), k, floor)

    def met(some: DataFrame) -> DataFrame:
        left = some.join(F.broadcast(parts), F.col("list") == F.col("l_rows")).withColumn("ask", F.pmod(F.xxhash64("q_place"), F.col("asks")).cast("int")).withColumn("row", every_part("rows"))
        rows_of = right.join(F.broadcast(some.select(F.col("list").alias("some_")).distinct()), F.col("list") == F.col("some_"), "left_semi")
        return left.select(*keys, *QUERY, "floor").groupBy(*keys).cogroup(rows_of.select(*keys, *ROW).groupBy(*keys)).applyInArrow(meet, HIT_DDL)

    first = stage(met(probes.where(F.col("nth") < FIRST).withColumn("floor", F.lit(None).cast("double"))))
    floors = merged(first, k).where(F.col("rank") == k).select(F.col("q_place").alias("f_"), F.col("score").alias("floor"))
    others = probes.where(F.col("nth") >= FIRST).join(floors, F.col("q_place") == F.col("f_"), "left")
    return merged(first.unionByName(met(others)), k).select(
        F.col("q_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def fitted_ratio(v: DataFrame, queries: DataFrame, lists: DataFrame, graph: Graph, kind, width: int, k: int) -> float:
    """The ratio at which TARGET of the true neighbours of up to PROBES queries lie in a searched list."""
    probe = queries.select("place", "vec_id", "data").orderBy(F.xxhash64("place"), "place").limit(PROBES).toArrow()
    if not probe.num_rows:
        return 0.0
    asks = side(probe, ROW, kind, width)

    def scan(batches):
        for batch in batches:
            yield from best_of(asks, side(pa.Table.from_batches([batch]), ROW, kind, width), k).to_batches()

    true = merged(v.select(*ROW).mapInArrow(scan, HIT_DDL), k).select("q_place", F.col("place").alias("t_"))
    held = lists.join(F.broadcast(true), F.col("place") == F.col("t_")).groupBy("q_place", "t_").agg(F.collect_set("list").alias("lists")).collect()
    far = np.sqrt(squares(asked(asks[2]), graph.c))
    number = {p: i for i, p in enumerate(asks[0].tolist())}
    need = [far[number[r["q_place"]], r["lists"]].min() / max(far[number[r["q_place"]]].min(), 1e-12) - 1 for r in held]
    return float(np.quantile(need, TARGET)) + 1e-6 if need else 0.0
