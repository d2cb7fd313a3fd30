"""Sinks: partitioned tables, single files for people, text reports and JSON."""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_dataset(df: DataFrame, path: str, mode: str = "append", keys: tuple[str, ...] = ("dataset",)) -> None:
    """Parquet partitioned by data set; rows of a partition meet in one task first, so it gets few files."""
    df.repartition(*keys).write.mode(mode).partitionBy(*keys).parquet(path)


def best_and_latest(trials: DataFrame, path: str) -> None:
    """Trial metrics partitioned by which (best or latest checkpoint), dataset and method; appended."""
    by_dataset(trials, path, keys=("which", "dataset", "method"))


def predictions(scores: DataFrame, path: str) -> None:
    """Scores of every node partitioned by dataset and method; appended."""
    by_dataset(scores, path, keys=("dataset", "method"))


def npz_archives(edges: DataFrame) -> DataFrame:
    """dataset, npz (a compressed-row archive), nodes: one row per data set, made in the task that has its edges."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, flat = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        src, dst = flat.reshape(-1, 2).T
        cell, at = np.unique(src * len(nodes) + dst, return_inverse=True)
        raw = io.BytesIO()
        pointers = np.searchsorted(cell // len(nodes), np.arange(len(nodes) + 1)).astype(np.int32)
        np.savez_compressed(raw, indices=(cell % len(nodes)).astype(np.int32), indptr=pointers, format=np.array(b"csr"), shape=np.array([len(nodes)] * 2), data=np.bincount(at, pdf["w"].to_numpy()))
        return pd.DataFrame({"dataset": [key[0]], "npz": [raw.getvalue()], "nodes": [nodes.tolist()]})

    return edges.select("dataset", "src", "dst", "w").groupBy("dataset").applyInPandas(run, "dataset string, npz binary, nodes array<long>")


def npz(edges: DataFrame, root: str) -> None:
    """``root/<dataset>/adj.npz`` and ``nodes.txt`` on a path that executors can open; written by the tasks."""

    def save(rows) -> None:
        for r in rows:
            folder = os.path.join(root, r["dataset"])
            os.makedirs(folder, exist_ok=True)
            for name, content in (("adj.npz", bytes(r["npz"])), ("nodes.txt", "".join(f"{n}\n" for n in r["nodes"]).encode())):
                with open(f"{folder}/.{name}", "wb") as f:
                    f.write(content)
                os.replace(f"{folder}/.{name}", f"{folder}/{name}")  # a second attempt of the task replaces it as a whole

    npz_archives(edges).foreachPartition(save)


def csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, for report tables."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def text(lines: DataFrame, path: str) -> None:
    """The texts of (line, text) in order, as one file."""
    lines.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text ``value``, nulls written."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def json(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def settings(values: dict, df: DataFrame) -> DataFrame:
    """Key and value rows of run settings."""
    return df.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "key string, value string")
