"""Synthetic comparison graphs with known ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from palio.operators.iterate import stored


def ero_matrix(n: int, p: float, eta: float, style: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and true ranks (1 is best) of an Erdos-Renyi graph with outliers.

    An edge of the upper triangle exists with probability ``p``; with 1 - ``eta`` of these it is the true gap of scores,
    else noise. The lower triangle is minus the upper one; negative entries are dropped.
    """
    rng = np.random.RandomState(seed)
    scores = rng.uniform(0, 1, n) if style == "uniform" else rng.gamma(0.5, 1, n)
    wide = 1.0 if style == "uniform" else 2.0
    draw = rng.uniform(size=(n, n))
    noise = rng.uniform(-wide, wide, (n, n))
    gap = scores[:, None] - scores[None]
    a = np.where(draw < p * (1 - eta), gap, np.where(draw < p, noise, 0.0))
    a = np.triu(a, 1)
    a = np.maximum(a - a.T, 0)
    order = np.argsort(-scores, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(1, n + 1)
    return a, rank


def ero(spark: SparkSession, graphs: list[tuple[int, float, float, str, int]]) -> tuple[DataFrame, DataFrame]:
    """Edges and labels (dataset, node, true_rank) of graphs (n, p, eta, style, seed), one task each."""
    params = spark.createDataFrame([(i, *g) for i, g in enumerate(graphs)], "g int, n int, p double, eta double, style string, seed int").repartition(max(1, len(graphs)), "g")

    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                a, rank = ero_matrix(r.n, r.p, r.eta, r.style, r.seed)
                src, dst = np.nonzero(a)
                name = f"ERO/p{r.p}eta{r.eta}{r.style}seed{r.seed}"
                yield pd.DataFrame({"kind": "edge", "dataset": name, "src": src, "dst": dst, "w": a[src, dst]})
                yield pd.DataFrame({"kind": "label", "dataset": name, "src": np.arange(r.n), "dst": rank, "w": 0.0})

    rows = stored(params.mapInPandas(run, "kind string, dataset string, src long, dst long, w double"))
    return rows.where("kind = 'edge'").drop("kind"), rows.where("kind = 'label'").selectExpr("dataset", "src AS node", "dst AS true_rank")
