"""Connected components of links between ids: union-find inside each partition, then star contraction over the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from decision_lens.session import stage


def forest(links: DataFrame) -> DataFrame:
    """Replace the links of each partition by links to the least id of their part, by union-find."""
    def run(batches):
        import pyarrow as pa
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = root(a), root(b)
                parent.setdefault(a, ra)
                parent.setdefault(b, rb)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        own = [x for x in parent if root(x) != x]
        for at in range(0, len(own), 50_000):
            part = own[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({"u": pa.array(part, pa.int64()), "v": pa.array([root(x) for x in part], pa.int64())})

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link (u, v); component is the least id that can be reached.

    Nulls and links of a node with itself are left out; repeats are harmless; no links give no rows.
    """
    e = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = stage(forest(e).distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stage(small.select("x.u", "x.v").where("u <> v").distinct())
