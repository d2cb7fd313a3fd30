"""Loops over DataFrames whose lineage is cut by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palio-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, without lineage."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def settled(df: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, must: bool = True) -> DataFrame:
    """``step`` applied until the rows stay the same. After ``rounds`` steps that still changed something it raises, or returns if not ``must``."""
    now = stored(df)
    mark = _mark(now)
    for _ in range(rounds):
        now = stored(step(now))
        new = _mark(now)
        if new == mark:
            return now
        mark = new
    if must:
        raise RuntimeError(f"still changing after {rounds} rounds")
    return now


#: A node table is broadcast to the edges only if it was counted and has at most so many rows of about 50 bytes.
BROADCAST_ROWS = 1_000_000


def is_small(table: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most so many rows; counting it reads file footers only."""
    return table.count() <= most


def small_side(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small by its count; else a join shuffles both sides."""
    return F.broadcast(table) if is_small(table) else table
