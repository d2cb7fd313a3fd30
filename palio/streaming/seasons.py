"""Comparison graphs from a stream of results: one graph per event-time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(results: DataFrame, size: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """Edges of each window from streamed results (ts, src, dst, w); rows later than the watermark drop out."""
    g = results.withWatermark("ts", lateness).groupBy(F.window("ts", size), "src", "dst").agg(F.sum("w").alias("w"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("dataset"), "src", "dst", "w")


def rank_stream(edges: DataFrame, sink: Callable[[DataFrame, int], None], rank: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Ranks every finished window's graph with a batch ranker and hands the scores to ``sink``."""
    return edges.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: sink(rank(batch), epoch)).start()
