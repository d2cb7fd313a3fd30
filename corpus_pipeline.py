"""From raw documents to packed training sequences.

Stages: quality classifier, near-dedup by shingle similarity, substring dedup, benchmark decontamination, best-fit packing.
Each works on all that its predecessor kept, and every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palio.llm import _tokens, decontaminate, packing, similar, substring, weaklabel
from palio.llm._common import indexed, is_small, stored, tables, unique_keys

#: Words of a near-duplicate shingle, and the least similarity of near copies as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique number in the order of doc_id (doc_id itself unless it repeats or is null), and the number's name."""
    row = "__row__"
    while row in docs.columns:
        row += "_"
    if unique_keys(docs, "doc_id"):
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried")  # any names
    numbered = indexed(docs.select("doc_id", "text", kept), "doc_id", "text", name=row)[0]
    return numbered.select("carried.*", row), row


def _without(docs: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``docs`` whose ``row`` isn't in the stored table ``gone``."""
    return docs.join(F.broadcast(gone) if is_small(gone) else gone, row, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds toxic or of low quality."""
    fitted = weaklabel.fit(docs, tables(spark, sf_dir, "labels"))
    return weaklabel.keep(docs, fitted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies."""
    rows, row = _with_row(docs)
    near = similar.similar_groups(rows, key=row, shingle=SHINGLE, least=SIMILARITY)
    gone, _ = stored(near.where(F.col(row) != F.col("component")).select(row), "near-copies")
    return _without(rows, gone, row).select(*(F.col(f"`{c}`") for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; a document that loses all its words goes."""
    others = [c for c in docs.columns if c != "text"]
    rest = substring.dedup_substrings(spark, docs, texts=True, carry=tuple(others))
    kept = rest.where("n_removed = 0 or n_removed < n_words")

    def column(name: str):
        if name == "text":
            return F.col("rest").alias(name)
        old = F.col(f"carried.`{name}`")
        if name == "n_chars":
            old = F.when(F.col("n_removed") > 0, F.char_length("rest").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return kept.select(*(column(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    rows, row = _with_row(docs)
    found = decontaminate.find_contamination(rows, tables(spark, sf_dir, "benchmark"), key=row)
    gone, _ = stored(found.where("n_hit > 0").select(row), "contaminated")
    return _without(rows, gone, row).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: pieces of documents with their place in a sequence."""
    return packing.pack(docs, _tokens.default_path())


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: No SQL for the classifier, the fingerprints and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
