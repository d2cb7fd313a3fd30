"""Scans of match files, matrices, result tensors and logs. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palio.functions import names
from palio.operators.results import no_nan


def matches(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Headerless match lines: home, away, home_goals, away_goals."""
    return spark.read.schema("home string, away string, home_goals int, away_goals int").csv(path).withColumn("dataset", F.lit(dataset))


def csv_columns(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]], sep: str = ",") -> DataFrame:
    """Some columns of a file with a header: {new name: (name in the file, type)}; values that don't fit are null."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    return raw.select(*(F.col(f"`{old}`").try_cast(kind).alias(new) for new, (old, kind) in columns.items()))


def tsv_columns(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    return csv_columns(spark, path, columns, "\t")


def dense_matrix(spark: SparkSession, path: str, dataset: str, clip: bool = True) -> DataFrame:
    """Edges of a headerless n x n matrix file. One file is one task, so that its lines keep their numbers."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")).alias("src", "line"))
    cells = lines.select(F.col("src").cast("long"), F.posexplode(F.split("line", ",")).alias("dst", "text")).select("src", F.col("dst").cast("long"), F.trim("text").try_cast("double").alias("w"))
    return cells.where("w > 0" if clip else "w <> 0").select(F.lit(dataset).alias("dataset"), "src", "dst", "w")


def results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result file with a header; a missing path gives an empty table of the schema. Empty, NA and nan are null."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    want = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    cols = []
    for f in want.fields:
        c = F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast("string")
        cols.append((names.safe_cast(c).cast(f.dataType) if f.dataType.typeName() in ("double", "float") else c.try_cast(f.dataType)).alias(f.name))
    return no_nan(raw.select(*cols))


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def result_files(spark: SparkSession, root: str, skip: tuple[str, ...] = ("debug",)) -> DataFrame:
    """dataset, which, method, config, path, modified of .npy files laid out as dataset/which/method/config.npy."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root).select("path", F.col("modificationTime").alias("modified"))
    at = r"([^/]+(?:/[^/]+)?)/(upset|upset_latest|runtime|runtime_latest|kendall_tau)/([^/]+)/([^/]+)\.npy$"
    out = files.select(*(F.regexp_extract("path", at, i).alias(n) for i, n in enumerate(("dataset", "which", "method", "config"), 1)), "path", "modified").where("which <> ''")
    for s in skip:
        out = out.where(~F.col("path").contains(f"/{s}"))
    return out


def latest(files: DataFrame) -> DataFrame:
    """The newest file of each dataset, which and method."""
    return files.groupBy("dataset", "which", "method").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def npy_values(spark: SparkSession, root: str) -> DataFrame:
    """path, index (array of positions), value of every .npy tensor; NaN is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root).select("path", "content")

    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                a = np.load(io.BytesIO(r.content), allow_pickle=False)
                yield pd.DataFrame({"path": r.path, "index": [list(map(int, i)) for i in np.ndindex(a.shape)], "value": a.astype(float).ravel()})

    return no_nan(files.mapInPandas(run, "path string, index array<int>, value double"))


def match_runtimes(upsets: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Each upset file with the runtime file of its config, or with the only one of its dataset and method."""
    keys = ["dataset", "method"]
    r = runtimes.select(*keys, F.col("config"), F.col("path").alias("runtime_path"))
    only = r.groupBy(*keys).agg(F.count("*").alias("n"), F.min("runtime_path").alias("only_path")).where("n = 1").drop("n")
    return upsets.join(r, [*keys, "config"], "left").join(only, keys, "left").withColumn("runtime_path", F.coalesce("runtime_path", "only_path")).drop("only_path")


def npz_shape(raw: bytes) -> tuple[int, int]:
    """Nodes and stored entries of a sparse matrix archive, from the headers only."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        def header(name: str):
            with z.open(name) as f:
                version = np.lib.format.read_magic(f)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                return read(f)[0]

        return header("indptr.npy")[0] - 1, header("data.npy")[0]


def npz_profile(spark: SparkSession, root: str) -> DataFrame:
    """path, n, m of archives, without reading their values."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(root).select("path", "content")

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame([(r.path, *npz_shape(r.content)) for r in pdf.itertuples()], columns=["path", "n", "m"])

    return files.mapInPandas(run, "path string, n long, m long")


def _npz_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        data, indices, indptr = z["data"], z["indices"], z["indptr"]
    return np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)), indices, data.astype(float)


class NpzEdges(DataSource):
    """``spark.read.format("npz_edges").load(path)``: edges of one compressed-row archive on a path that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "npz_edges"

    def schema(self) -> str:
        return "dataset string, src long, dst long, w double"

    def reader(self, schema):
        return _NpzReader(self.options)


class _NpzReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.dataset = options.get("dataset", self.path)

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            src, dst, w = _npz_edges(f.read())
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
            yield (self.dataset, a, b, x)


def npz_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of all archives below a path, read by Spark (so from any store); dataset is the folder's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dataset"), "content")

    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                src, dst, w = _npz_edges(r.content)
                yield pd.DataFrame({"dataset": r.dataset, "src": src, "dst": dst, "w": w})

    return files.mapInPandas(run, "dataset string, src long, dst long, w double")


#: Names of metrics in run logs.
LOG_METRICS = ["upset_simple", "upset_ratio", "upset_naive", "runtime_sec"]


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """dataset, method, and mean and std of each metric from logs of tables "name mean$\\pm$std" under a header line.

    A header "<dataset>_<metric>Metric/Method  <method> ..." holds for the lines after it; of several methods the
    first counts. Tables without all four metrics drop out. One file is one row, so lines keep their order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    head = r"^\s*(\S+)_\w+/Method\s+(\S+)"
    cell = r"^\s*(\w+)\s+([-\d.einfa]+)\$\\pm\$([-\d.einfa]+)"
    ahead = Window.partitionBy("file").orderBy("n")
    tagged = lines.withColumn("h", F.when(F.col("line").rlike(head), F.struct(F.col("n").alias("at"), F.regexp_extract("line", head, 1).alias("dataset"), F.regexp_extract("line", head, 2).alias("method"))))
    tagged = tagged.withColumn("h", F.last("h", ignorenulls=True).over(ahead)).where(F.col("line").rlike(cell) & F.col("h").isNotNull())
    rows = tagged.select("file", "h.at", "h.dataset", "h.method", F.regexp_extract("line", cell, 1).alias("metric"), names.safe_cast(F.regexp_extract("line", cell, 2)).alias("mean"), names.safe_cast(F.regexp_extract("line", cell, 3)).alias("std")).where(F.col("metric").isin(LOG_METRICS))
    aggs = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in LOG_METRICS for c in ("mean", "std")]
    return rows.groupBy("file", "at", "dataset", "method").agg(*aggs, F.count_distinct("metric").alias("k")).where(F.col("k") == len(LOG_METRICS)).drop("file", "at", "k")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, root: str, key: str, forms: tuple[str, ...] = ("{key}/adj.npz", "{key}adj.npz", "{key}.npz", "{key}/adj.csv")) -> str | None:
    """The first of a data set's candidate paths that exists, in the order of ``forms``; None if none does."""
    for form in forms:
        path = f"{root.rstrip('/')}/{form.format(key=key.rstrip('/'))}"
        if _exists(spark, path):
            return path
    return None


def load_or_build(spark: SparkSession, path: str, build, regenerate: bool = False) -> DataFrame:
    """A cached table: read if the path exists, else built and written."""
    if regenerate or not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
