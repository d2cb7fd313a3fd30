"""Rank and evaluate many data sets by many methods in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palio.operators import graph, metrics, rank_dense, rank_rel

#: Methods with a relational plan; all others go one graph per task.
RELATIONAL = {"netWins": rank_rel.net_wins, "winRatio": rank_rel.win_ratio, "outWeight": rank_rel.out_weight, "davidScore": rank_rel.david_score}


def scores(edges: DataFrame, methods: list[str], trials: int = 1, seed: int = 10, dense_only: bool = False) -> DataFrame:
    """dataset, method, trial, node, score, runtime_sec, status of all methods."""
    names = [m for x in methods for m in rank_dense.PRESETS.get(x, [x])]
    rel = [] if dense_only else [m for m in names if m in RELATIONAL]
    rest = [m for m in names if m not in rel]
    out = rank_dense.rank(edges, rest, trials, seed) if rest else None
    for m in rel:
        s = RELATIONAL[m](edges).select("dataset", "method", F.lit(0).alias("trial"), "node", "score", F.lit(None).cast("double").alias("runtime_sec"), F.lit("ok").alias("status"))
        out = s if out is None else out.unionByName(s)
    return out


def evaluate(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """trial metrics: dataset, method, trial, the three upsets and the runtime. Failed trials have nulls."""
    e = graph.summed(graph.positive(edges))
    tag = F.concat_ws("\x01", "method", F.col("trial").cast("string"))
    flat = scored.select("dataset", tag.alias("method"), "node", "score").where("score is not null")
    got = metrics.evaluated(e, flat)
    runs = scored.groupBy("dataset", "method", "trial").agg(F.max("runtime_sec").alias("runtime_sec"), F.max("status").alias("status"))
    got = got.select("dataset", F.split_part("method", F.lit("\x01"), F.lit(1)).alias("method"), F.split_part("method", F.lit("\x01"), F.lit(2)).cast("int").alias("trial"), "upset_simple", "upset_ratio", "upset_naive")
    return runs.join(got, ["dataset", "method", "trial"], "left")
