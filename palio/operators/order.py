"""Places and running sums in an order over whole tables, without a window that holds a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palio.operators.iterate import is_small, stored


def _ranges(rows: DataFrame, group: list[str], by: list[Column]) -> DataFrame:
    """Stored rows in range partitions of group and order, sorted; ``_part`` and ``_at`` say where a row stands.

    Give an order without ties: rows that are equal in it stay together in one partition.
    """
    dealt = rows.repartitionByRange(*(F.col(g) for g in group), *by).sortWithinPartitions(*(F.col(g) for g in group), *by)
    return stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def _ahead(parts: DataFrame, group: list[str], value: str) -> Column:
    """What earlier partitions of a group hold of a value. parts: a row per partition and group, so the window is small."""
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def positions(rows: DataFrame, group: list[str], by: list[Column], name: str = "position", start: int = 0) -> DataFrame:
    """``rows`` with their place in the order ``by`` inside each group, counted from ``start``.

    A range partition is sorted and numbered on its own; the counts of partitions, a row each per group, give what
    comes before it.
    """
    held = _ranges(rows, group, by)
    parts = held.groupBy("_part", *group).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    shift = stored(parts.select("_part", *group, (_ahead(parts, group, "_n") - F.col("_low") + start).alias("_shift")))
    return _matched(held, shift, group).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _matched(held: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """Rows with what is known of their partition and group; null groups match each other."""
    side = parts.select(*(F.col(c).alias(f"_r{c}") if c in group or c == "_part" else F.col(c) for c in parts.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in ["_part", *group]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return held.join(F.broadcast(side) if is_small(parts) else side, on).drop("_r_part", *(f"_r{g}" for g in group))


def running(rows: DataFrame, group: list[str], by: list[Column], value: str, name: str = "running") -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in the order ``by`` inside its group."""
    held = _ranges(rows, group, by)
    parts = held.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    ahead = stored(parts.select("_part", *group, _ahead(parts, group, "_sum").alias("_ahead")))
    # inside a range partition: its rows only
    inside = F.sum(value).over(Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return _matched(held.withColumn("_inside", inside), ahead, group).withColumn(name, F.col("_ahead") + F.coalesce("_inside", F.lit(0))).drop("_part", "_at", "_ahead", "_inside")


#: Leading bits of a double (sign, exponent, 6 of the fraction) by which rows are counted, and the bits behind them.
_BUCKETS, _BEHIND = 1 << 18, 46


def _counted(rows: DataFrame) -> DataFrame:
    """group, bucket, n: rows of ``group`` (a string), ``_v`` by the leading bits of the value, in ascending order of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                at = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["_group", "_bucket", "_n"])
            held.clear()

        for batch in batches:
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            which, bits = names.indices.to_numpy(), (batch.column(1).to_numpy() + 0.0).view(np.int64)  # no -0
            bucket = ((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> _BEHIND) + _BUCKETS // 2
            for k, name in enumerate(names.dictionary.to_pylist()):
                if name not in held and len(held) >= 64:
                    yield from given()
                np.add.at(held.setdefault(name, np.zeros(_BUCKETS, np.int64)), bucket[which == k], 1)
        yield from given()

    parts = rows.mapInArrow(run, "_group string, _bucket long, _n long")
    return stored(parts.groupBy("_group", "_bucket").agg(F.sum("_n").alias("_n")))


def _least(bucket: int) -> float:
    """The least value of a bucket."""
    bits = np.array([(bucket - _BUCKETS // 2) << _BEHIND], np.int64)
    value = float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])
    return float("-inf") if np.isnan(value) and bucket < _BUCKETS // 2 else float("inf") if np.isnan(value) else value


def medians(rows: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """The exact median of a double in each group (by one column of strings). Nulls don't count.

    Rows are counted by the leading bits of their values; only the values in the buckets of the middle places are put in
    order, a row for each different one.
    """
    (column,) = group
    rows = rows.where(F.col(value).isNotNull() & F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_group"), F.col(value).cast("double").alias("_v"))
    counts = running(_counted(rows), ["_group"], [F.col("_bucket")], "_n", "_end")
    total = counts.groupBy("_group").agg(F.max("_end").alias("_all"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    begin = F.col("_end") - F.col("_n")
    middle = stored(counts.join(total, "_group").where((begin <= high) & (low < F.col("_end"))).select("_group", "_bucket", "_all", begin.alias("_begin")))
    spans = middle.groupBy("_group").agg(F.min("_bucket").alias("_first"), F.max("_bucket").alias("_last"), F.min("_begin").alias("_below"), F.first("_all").alias("_all")).collect()  # a row per group
    schema = "_group string, _lo double, _hi double, _below long, _all long"
    bounds = F.broadcast(rows.sparkSession.createDataFrame([(r["_group"], _least(r["_first"]), _least(r["_last"] + 1), r["_below"], r["_all"]) for r in spans], schema))
    inside = rows.join(bounds, "_group").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") < F.col("_hi"))).groupBy("_group", "_v").agg(F.count("*").alias("_c"), F.first("_below").alias("_below"), F.first("_all").alias("_all"))
    placed = running(stored(inside), ["_group"], [F.col("_v")], "_c", "_end").withColumn("_end", F.col("_end") + F.col("_below"))
    at = lambda place: F.max(F.when((F.col("_end") - F.col("_c") <= place) & (place < F.col("_end")), F.col("_v")))
    return placed.groupBy(F.col("_group").alias(column)).agg(((at(low) + at(high)) / 2).alias(name))
