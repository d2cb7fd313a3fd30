"""Checks of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palio.functions import names
from palio.operators import graph, results


def missing_runtime(rows: DataFrame, allowed: DataFrame, parts: list[str]) -> DataFrame:
    """Rows with an upset but no runtime, without allowed (dataset, method) pairs and datasets that contain any of ``parts``."""
    bad = rows.where("upset_simple is not null and runtime_sec is null").join(allowed, ["dataset", "method"], "left_anti")
    for p in parts:
        bad = bad.where(~F.col("dataset").contains(p))
    return bad.select("dataset", "method")


def nondeterministic(results: DataFrame) -> DataFrame:
    """Single runs that report a deviation."""
    return results.where("num_runs = 1 and upset_simple_std > 1e-10").select("dataset", "method", "config", "which")


def checks(rules: dict[str, DataFrame]) -> DataFrame:
    """name, status: one-cell boolean tables as PASS, FAIL or, for null, WARN."""
    rows = [df.toDF("ok").select(F.lit(n).alias("name"), F.when(F.col("ok"), "PASS").when(F.col("ok").isNull(), "WARN").otherwise("FAIL").alias("status")) for n, df in rules.items()]
    return reduce(DataFrame.unionByName, rows)


def differences(have: DataFrame, want: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows that only one side has, or whose values differ by more than a tolerance (null equals null)."""
    w = want.select(*keys, *(F.col(v).alias(f"want_{v}") for v in values), F.lit(True).alias("_w"))
    both = have.withColumn("_h", F.lit(True)).join(w, keys, "full")
    bad = F.col("_h").isNull() | F.col("_w").isNull()
    for v in values:
        gap = F.abs(F.col(v) - F.col(f"want_{v}"))
        bad = bad | (F.col(v).isNull() != F.col(f"want_{v}").isNull()) | (F.coalesce(gap, F.lit(0.0)) > tolerance)
    return both.where(bad).drop("_h", "_w")


def inventory(edges: DataFrame, sparse: int = 100) -> DataFrame:
    """dataset, n, m and notes."""
    p = graph.profile(edges)
    return p.select("dataset", "n", "m", F.when(F.col("m") < sparse, "sparse").otherwise("").alias("notes"))


def denominator(table: DataFrame, rows: DataFrame) -> DataFrame:
    """have, want, ok: the N of the first row's coverage "n / N" and the number of data sets."""
    first = table.select(F.trim(F.split_part("coverage", F.lit("/"), F.lit(2))).cast("long").alias("have"))
    want = rows.agg(F.count_distinct("dataset").alias("want"))
    return first.join(want, how="cross").withColumn("ok", F.col("have") == F.col("want"))  # one row each


def per_method(frames: dict[str, DataFrame], spark) -> DataFrame:
    """name, ok: main tables need method or dataset columns, and may not be made of best_* columns only."""
    best = {"best_classical_upset_simple", "best_gnn_upset_simple"}
    ok = lambda c: "method" in c or ("dataset" in c and not best & c)
    return spark.createDataFrame([(n, ok(set(f.columns))) for n, f in frames.items()], "name string, ok boolean")


def consistency(rows: DataFrame, board: DataFrame, comparison: DataFrame, declared: int, policy: int, expected: list[str]) -> DataFrame:
    """Eleven rules between an inventory (``rows``), its leaderboard and the comparison table."""
    one = lambda df, c: df.agg(c.alias("x"))
    both = lambda a, b: a.join(b.withColumnRenamed("x", "y"), how="cross").select(F.col("x") == F.col("y"))  # noqa: E731  one row each
    datasets = F.count_distinct("dataset")
    table = results.summarize(board, declared)
    valid, total = names.coverage_parts(F.col("coverage"))
    quadrants = results.pareto_quadrants(comparison, ("ours_upset_simple", "best_upset_simple"), ("ours_runtime_sec", "best_runtime_sec"))
    known = board.join(rows.select("dataset").distinct(), "dataset", "left_anti")
    return checks({
        "inventory and suite": both(one(rows, datasets), one(board, datasets)),
        "denominator of every method": both(one(table, F.max(total).cast("long")), one(board, datasets)),
        "one comparison row per data set": both(one(comparison, F.count("*")), one(board, datasets)),
        "claims count the comparison": both(one(comparison, F.count("*")), one(comparison, F.count_distinct("dataset"))),
        "pareto denominator": quadrants.join(comparison.agg(F.count("*").alias("n")), how="cross").select(F.col("better_faster") + F.col("better_slower") + F.col("worse_faster") + F.col("worse_slower") <= F.col("n")),
        "expected methods": one(board, F.count_distinct(F.when(F.col("method").isin(expected), F.col("method"))) == len(expected)),
        "known data sets only": one(known, F.count("*") == 0),
        "no key twice": one(board, F.count("*") == F.count_distinct("dataset", "method")),
        "upsets within 0 and 4": one(board, F.bool_and(F.col("upset_simple").between(0, 4))),
        "policy size 81" if policy == 81 else f"policy size {policy}": one(board, datasets == policy),
        "coverage not above the size": one(table, F.bool_and(valid <= total)),
    })


def without_runtime_file(upsets: DataFrame, runtimes: DataFrame, keys: list[str]) -> DataFrame:
    """Upset files that have no runtime file of the same keys."""
    return upsets.join(runtimes, keys, "left_anti")


def row_trace(rows: DataFrame, **where: str) -> DataFrame:
    """The rows behind a table cell."""
    for c, v in where.items():
        rows = rows.where(F.col(c) == v)
    return rows


def explain_best(rows: DataFrame, board: DataFrame) -> DataFrame:
    """Configurations of each data set and method with their place, and which one the leaderboard names."""
    w = Window.partitionBy("dataset", "method").orderBy(F.asc_nulls_last("upset_simple"), "config")
    placed = rows.select("dataset", "method", "config", "upset_simple", F.row_number().over(w).alias("place"))
    named = board.select("dataset", "method", F.col("config").alias("_best"))
    return placed.join(named, ["dataset", "method"]).withColumn("chosen", F.col("config") == F.col("_best")).drop("_best")


def explain_coverage(board: DataFrame, limit: float) -> DataFrame:
    """Why a data set counts for a method, or doesn't."""
    late = F.col("runtime_sec") > limit
    reason = F.when(F.col("upset_simple").isNull(), "no metrics").when(F.col("runtime_sec").isNull(), "no runtime").when(late, "timeout").otherwise("valid")
    return board.select("method", "dataset", reason.alias("reason"))


def summary(rows: DataFrame) -> DataFrame:
    """Rows, data sets and configurations per method."""
    return rows.groupBy("method").agg(F.count("*").alias("n_rows"), F.count_distinct("dataset").alias("n_datasets"), F.count_distinct("config").alias("n_configs"), F.min("dataset").alias("first"), F.max("dataset").alias("last"))
