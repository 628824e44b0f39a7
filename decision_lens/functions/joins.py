"""Joins whose key may be held by a large part of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from decision_lens.session import SMALL_ROWS, freeze

LEAST_ROWS = 100_000
SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = LEAST_ROWS) -> DataFrame:
    """Join on one key; keys with more than a thousandth of the left rows (and ``least`` of them) do not travel.

    There are at most a thousand such keys. Their rows on the right, if few enough, are broadcast to the left rows where these are; all
    other keys are joined by shuffle. The result is that of a plain join, ``how`` is inner or left. Counting reads only the key.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > least) & F.col(key).isNotNull())
    largest = counts.orderBy(F.desc("n")).limit(SHARE).collect()
    if not largest:
        return left.join(right, key, how)
    floor = left.count() / SHARE
    kind = left.schema[key].dataType
    hot = left.sparkSession.createDataFrame([(r[key],) for r in largest if r["n"] > floor], f"`{key}` {kind.simpleString()}")
    some, fits = freeze(right.join(F.broadcast(hot), key, "left_semi"), SMALL_ROWS)
    if not fits:
        return left.join(right, key, how)
    stay = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(some), key, how)
    move = left.join(F.broadcast(hot), key, "left_anti").join(right.join(F.broadcast(hot), key, "left_anti"), key, how)
    return move.unionByName(stay)
