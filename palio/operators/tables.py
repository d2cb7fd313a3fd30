"""Report tables as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palio.functions import names
from palio.operators import order as ranges
from palio.operators import results


def _lines(rows: DataFrame, order: list[str], text: Column) -> DataFrame:
    """line (from 1, in an order over all rows), text; numbers come from range partitions."""
    placed = ranges.positions(rows.withColumn("_text", text), [], [F.col(c) for c in order], "_line", start=1)
    return placed.select(F.col("_line").cast("int").alias("line"), F.col("_text").alias("text"))


def latex_table(rows: DataFrame, order: list[str], digits: int = 4) -> DataFrame:
    """line, text: a LaTeX tabular, header first. Lines are numbered per row, so they can be written in parts."""
    cells = []
    for f in rows.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        if kind in ("double", "float"):
            cells.append(names.number(c, digits))
        elif kind in ("string",):
            cells.append(F.coalesce(names.latex(c), F.lit("---")))
        else:
            cells.append(F.coalesce(c.cast("string"), F.lit("---")))
    body = _lines(rows, order, F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")))
    head = " & ".join(c.replace("_", "\\_") for c in rows.columns) + " \\\\"
    first = rows.sparkSession.createDataFrame([(-1, "\\begin{tabular}{" + "l" * len(rows.columns) + "}"), (0, head + " \\hline")], "line int, text string")
    last = rows.sparkSession.createDataFrame([(2**31 - 1, "\\end{tabular}")], "line int, text string")
    return first.unionByName(body).unionByName(last)


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """line, text: a Markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    body = _lines(rows, order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))
    head = [(-1, "| " + " | ".join(rows.columns) + " |"), (0, "|" + "-|" * len(rows.columns))]
    return rows.sparkSession.createDataFrame(head, "line int, text string").unionByName(body)


def claims(comparison: DataFrame) -> DataFrame:
    """One JSON text of wins (ties count), gaps and speedups; nulls are written."""
    a = comparison.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ours_upset_simple") <= F.col("best_upset_simple")).alias("wins_or_ties"),
        F.round(F.median(F.col("ours_upset_simple") - F.col("best_upset_simple")), 6).alias("median_gap"),
        F.round(F.median(F.try_divide(F.col("best_runtime_sec"), F.when(F.col("ours_runtime_sec") > 0, F.col("ours_runtime_sec")))), 6).alias("median_speedup"),
    )
    return a.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("claims"))


def claim_counts(comparison: DataFrame, board: DataFrame) -> DataFrame:
    """Counts that a text may claim; ties are wins."""
    a = comparison.agg(F.count("*").alias("n"), F.count_if(F.col("ours_upset_simple") <= F.col("best_upset_simple")).alias("wins"), F.count_if(F.col("ours_runtime_sec") <= F.col("best_runtime_sec")).alias("faster"))
    return a.join(board.agg(F.count_distinct("dataset").alias("n_datasets")), how="cross")  # one row each


def mean_std_table(rows: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Mean and deviation as text with the best and second best marked."""
    agg = rows.groupBy(*keys, "method").agg(F.round(F.avg(value), 5).alias("mean"), F.round(F.stddev_pop(value), 5).alias("std"))
    return results.highlight(agg, "mean", keys).withColumn("text", names.mean_std(F.col("mean"), F.col("std")))
