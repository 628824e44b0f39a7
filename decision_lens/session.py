"""Session helpers: shared scratch folder, staged tables, size-checked small frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SMALL_ROWS = 20_000
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only for local sessions that name none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="decision-lens-")
    return _LOCAL[app]


def stage(df: DataFrame) -> DataFrame:
    """Write a frame that several jobs read as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freeze(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Fix a usually small aggregate: (frame, fits).

    Up to ``limit`` rows come back as a local relation that is safe to broadcast;
    a larger one is staged and joined by shuffle instead.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return stage(df), False


def join_small(df: DataFrame, small: tuple[DataFrame, bool], on, how: str = "inner") -> DataFrame:
    """Join with a frozen frame, broadcasting it only when its size was checked."""
    frame, fits = small
    return df.join(F.broadcast(frame) if fits else frame, on, how)
