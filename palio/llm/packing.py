"""Vector best-fit packing of token sequences.

An item is a vector of tokens, documents (1) and attention cost (tokens squared); a bin has a capacity in
each. Items go, longest first, into the bin that fits under every constraint and scores best: by the
least weighted norm of the residual left, or by the largest weighted dot product of item and residual.
Items of one length have one vector, so the driver packs the histogram of lengths (bounded by the
sequence length, whatever the corpus) with whole groups of equal bins at a time. The plan says which
ranks of a length go to which bins; ranks are dealt out by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import _flat as K
from . import _tokens
from ._common import DataFrame, F, SparkSession, Window, batches_of, stored, tables

LENGTH, END = 1024, 2
#: Pieces numbered in one sort.
BUCKET = 10_000
#: What an encoder remembers and takes at once. Packing ends a pipeline, when the executors' memory is mostly in use.
UNITS, SLICE_BYTES = 150_000, 1 << 19


@dataclass(frozen=True)
class Capacity:
    """Of a bin, and the weights of the score. The default document and attention bounds never cost a token."""

    tokens: int = LENGTH
    documents: int = LENGTH
    attention: int = LENGTH * LENGTH
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    score: str = "norm"  # or "dot"


def plan(histogram: dict[int, int], cap: Capacity = Capacity()) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for counts of items by length."""
    full = np.array([cap.tokens, cap.documents, cap.attention], dtype=float)
    weights = np.array(cap.weights)
    left = np.zeros((1024, 3), np.int64)  # residuals of groups of equal bins
    bins, first = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    groups = sequences = 0
    out = []

    def add(residual, n: int, base: int) -> None:
        nonlocal left, bins, first, groups
        if groups == len(bins):
            left, bins, first = np.concatenate((left, left * 0)), np.append(bins, bins * 0), np.append(first, first * 0)
        left[groups], bins[groups], first[groups] = residual, n, base
        groups += 1

    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length])
        if (item > (cap.tokens, cap.documents, cap.attention)).any():
            raise ValueError(f"an item of {length} tokens exceeds the capacity")
        rank, end = 0, histogram[length]
        while rank < end:
            own = left[:groups]
            fits = np.flatnonzero((own >= item).all(axis=1) & (bins[:groups] > 0))
            if len(fits):
                if cap.score == "dot":
                    score = -((own[fits] / full) * (item / full) * weights).sum(axis=1)
                else:
                    score = (weights * ((own[fits] - item) / full) ** 2).sum(axis=1)
                g = int(fits[np.argmin(score)])
                n = min(end - rank, int(bins[g]))
                out.append((length, rank, rank + n, int(first[g]), int(cap.tokens - left[g, 0])))
                residual, base = left[g] - item, int(first[g])
                if n == bins[g]:
                    left[g] = residual
                else:
                    bins[g] -= n
                    first[g] += n
                    add(residual, n, base)
                rank += n
            else:  # new bins, each with as many copies as fit
                k = int((np.array([cap.tokens, cap.documents, cap.attention]) // item).min())
                n = (end - rank) // k
                if not n:
                    n, k = 1, end - rank
                for i in range(k):
                    out.append((length, rank, rank + n, sequences, i * length))
                    rank += n
                add(np.array([cap.tokens, cap.documents, cap.attention]) - k * item, n, sequences)
                sequences += n
        # exhausted groups make room
        keep = np.flatnonzero((left[:groups, 0] > 0) & (left[:groups, 1] > 0) & (bins[:groups] > 0))
        if len(keep) < groups:
            left[: len(keep)], bins[: len(keep)], first[: len(keep)] = left[keep], bins[keep], first[keep]
            groups = len(keep)
    return out


def pieces(documents: DataFrame, tokenizer: str, key: str, text: str, end: int, length: int, with_ids: bool = False) -> DataFrame:
    """doc, piece, start, length, crc and maybe ids: documents' ids with ``end``, cut if longer than ``length``; the first piece may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.give_back()
        coder = _tokens.encoder(tokenizer, UNITS, SLICE_BYTES)
        for batch in batches:
            flat, offs = coder.encode_with_end(batch.column(1), end)
            n = np.diff(offs)
            count = -(-n // length)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = n[row] - (count[row] - 1) * length  # the first piece takes what the full ones leave
            start = np.where(piece == 0, 0, first + (piece - 1) * length)
            size = np.where(piece == 0, first, length)
            raw, at = memoryview(flat.tobytes()), (offs[row] + start) * 4
            parts = [raw[s:e] for s, e in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(row)), *(pa.array(v, t) for v, t in ((piece, pa.int32()), (start, pa.int64()), (size, pa.int64()), ([zlib.crc32(x) for x in parts], pa.int64())))]
            if with_ids:
                cols.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "piece", "start", "length", "crc", "ids"][: 5 + with_ids])
            K.give_back()
        coder.forget()  # the worker may idle beside those of other stages
        K.give_back()

    kind = "doc long, piece int, start long, length long, crc long" + ", ids binary" * with_ids
    return documents.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind)


def pack(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, cap: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``cap.tokens`` ids.

    Returns ``key``, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids. A null text is
    empty, so it is one end id. Every input row is packed, repeated rows and null keys too. An empty table
    gives no sequences.
    """
    spark = documents.sparkSession
    with batches_of(spark, 1000):  # the encoder's caches need the room
        cut, _ = stored(pieces(documents, tokenizer, key, text, end, cap.tokens, with_ids), "pieces")
    buckets = max(1, -(-cut.count() // BUCKET))
    cut = cut.withColumn("b", F.pmod(F.xxhash64("doc", "piece"), F.lit(buckets)))
    counts, _ = stored(cut.groupBy("length", "b").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most cap.tokens rows
    steps = plan(histogram, cap)
    by_length: dict[int, np.ndarray] = {}
    for row in sorted(steps):
        by_length.setdefault(row[0], []).append(row[1:])
    handle = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})
    line = Window.partitionBy("length").orderBy("b")
    ahead = counts.withColumn("ahead", F.sum("n").over(line) - F.col("n")).select("length", "b", "ahead")
    ranked = cut.withColumn("i", F.row_number().over(Window.partitionBy("length", "b").orderBy("doc", "piece"))).join(ahead, ["length", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                table = handle.value[int(n)]
                at = np.searchsorted(table[:, 0], rank[own], side="right") - 1
                sequence[own] = table[at, 2] + rank[own] - table[at, 0]
                offset[own] = table[at, 3]
            cols = [batch.column(c) for c in range(5 + with_ids)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=["doc", "piece", "start", "length", "crc", *["ids"] * with_ids, "sequence_id", "offset"])

    kept = ["doc", "piece", "start", "length", "crc"] + ["ids"] * with_ids
    kind = "doc long, piece int, start long, length long, crc long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    out = ranked.select(*kept, (F.col("ahead") + F.col("i") - 1).alias("rank")).mapInArrow(run, kind)
    return out.withColumnRenamed("doc", key).withColumnRenamed("crc", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables(spark, sf_dir, "documents"), _tokens.default_path())
