"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A side of a join is broadcast only when it was counted and has at most so many rows of at most 16 bytes.
BROADCAST_ROWS = 2_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session without that setting
    (tests, benchmarks) gets a temporary folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palio-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the JVM collects them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder, and its path; the reread table has no lineage."""
    spark = df.sparkSession
    release(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """``body`` of a value that is computed once: a lambda variable stands for it in higher-order functions."""
    return F.transform(F.array(value), body)[0]


def in_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """Range partitions by ``key`` (null first), then a hash of ``text``, then text; sorted inside. Ranges are sampled without texts."""
    parts = df.withColumn("_h", F.xxhash64(text)).repartitionByRange(key, "_h")
    return parts.sortWithinPartitions(key, "_h", text).drop("_h")


def indexed(df: DataFrame, key: str, text: str, name: str = "row_index") -> tuple[DataFrame, str]:
    """``df`` with a gapless index in the order of ``in_order``, and the path it is stored under.

    Range partitions are sorted and numbered on their own; the driver sees one count per partition.
    """
    numbered, path = stored(
        in_order(df, key, text).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "indexed"
    )
    low = numbered.groupBy("_p").agg(F.min("_i").alias("low"), F.count("*").alias("n")).orderBy("_p").collect()
    base, total = [], 0
    for r in low:
        base.append((r["_p"], total - r["low"]))
        total += r["n"]
    spark = df.sparkSession
    shift = spark.createDataFrame(base, "_p int, _shift long")
    return numbered.join(F.broadcast(shift), "_p").withColumn(name, F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift"), path


def unique_keys(docs: DataFrame, key: str) -> bool:
    """Whether every row has a key of its own."""
    n, distinct = docs.agg(F.count("*"), F.count_distinct(F.col(key))).first()
    return n == distinct


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``_id``, ``_key``, ``_text`` and, as one struct ``_row``, the columns ``carry``; ``_id`` is a unique long in the order of the keys.

    When the keys are unique and not null they serve as they are. Otherwise every row, repeated ones too, gets
    a number of its own; they follow key (null first), then a hash of the text, then text.
    """
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row")] if carry else []
    base = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"), *more)
    rest = ["_row"] * len(more)
    if unique_keys(base, "_key"):
        return base.select(F.col("_key").alias("_id"), "_key", "_text", *rest)
    return indexed(base, "_key", "_text", name="_id")[0].select("_id", "_key", "_text", *rest)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside; the session's own setting returns after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows. Give it a stored table: counting that reads file footers only."""
    return df.count() <= limit


def split_by_ids(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame] | None:
    """Rows of ``docs`` with and without their ``_id`` in ``ids``, without a shuffle; None if ``ids`` is too long for that."""
    ids, _ = stored(ids, "ids")
    if not is_small(ids, limit):
        return None
    small = F.broadcast(ids)
    return docs.join(small, "_id", "left_semi"), docs.join(small, "_id", "left_anti")


__all__ = [
    "BROADCAST_ROWS", "DataFrame", "batches_of", "F", "SparkSession", "T", "Window", "drop", "in_order", "indexed", "is_small", "keyed", "let",
    "scratch", "split_by_ids", "stored", "tables", "unique_keys",
]
