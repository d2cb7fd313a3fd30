"""Substring deduplication by a compacted de Bruijn graph over words.

Nodes are word k-mers and edges the stretches of words between them. To keep the shuffle small the graph
is sparse: of all k-mers only the minimizers (the least hash among those of a 20-word window) are nodes,
and a *block* is an edge: a node with all the windows whose minimizer it is. Edges found more than once
are followed by the next edge of the same document and source (in a Spark window); a path branches
where the next edge has another source, and paths without a branch compact into one long repeat with source
coordinates. Both places of every repeat are read again, and only repeats whose words have equal digests count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _flat as K
from . import _repeats as R
from . import _tokens
from ._common import DataFrame, F, SparkSession, T, Window, batches_of, drop, keyed, split_by_ids, stored, tables

WINDOW, K_MER = 20, 5
#: Texts that a worker and Spark hold at once.
ROWS = 1000


def compact(repeats: DataFrame) -> DataFrame:
    """Chains of touching repeats with one source compact into paths: id, a, n, src_id, src_a.

    An edge continues another if it starts where that ends, in the document and in the source alike. An edge
    that no earlier one of its document's diagonal reaches is the head of a path.
    """
    line = ["id", "src_id", "diag"]
    e = repeats.select("id", "src_id", (F.col("a") - F.col("src_a")).alias("diag"), "a", (F.col("a") + F.col("n")).alias("z"))
    at = Window.partitionBy(*line).orderBy("a", "z")
    reached = F.max("z").over(at.rowsBetween(Window.unboundedPreceding, -1))
    heads = e.withColumn("head", (reached.isNull() | (reached < F.col("a"))).cast("int"))
    paths = heads.withColumn("i", F.sum("head").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    paths = paths.groupBy(*line, "i").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return paths.select("id", "a", (F.col("z") - F.col("a")).alias("n"), "src_id", (F.col("a") - F.col("diag")).alias("src_a"))


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """anchor, hash, id, a: every window of the open blocks. docs: _id, _text, opens (array of a, n, anchor)."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = K.text_buffers(batch.column(1))
            out: list[tuple] = []
            for i, one in enumerate(ids):
                x, _ = R.word_symbols(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
                v = batch.column(2)[i].values
                a, n, anchor = (v.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("a", "n", "anchor"))
                s = K.ragged(a, n)
                out.append((np.repeat(anchor, n), K.Rolling(x, 1).span(s, s + window).view(np.int64), np.full(len(s), one, np.int64), s.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], names=["anchor", "hash", "id", "a"])

    return docs.mapInArrow(run, "anchor long, hash long, id long, a int")


def removed_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = K_MER) -> DataFrame:
    """Paths of windows that also start earlier: id, a, n (windows a .. a + n - 1), src_id, src_a; stored. ``docs``: _id, _text."""
    found = R.find_blocks(docs, R.word_symbols, window, k, keep_first=True)
    compared, compared_path = stored(R.compare_blocks(found, keep_first=True), "edges")
    opens = compared.where("open").groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("a", "n", "anchor")).alias("opens"))
    parts = split_by_ids(docs, compared.where("open").select(F.col("id").alias("_id")).distinct())
    own = (parts[0] if parts else docs).join(opens, "_id").select("_id", "_text", "opens")
    windows = _window_rows(own, window)
    same = Window.partitionBy("anchor", "hash").orderBy("id", "a")
    later = (
        windows.withColumn("rank", F.row_number().over(same))
        .withColumn("first", F.first(F.struct("id", "a")).over(same))
        .where("rank > 1")
        .select("id", "a", F.lit(1).alias("n"), F.col("first.id").alias("src_id"), F.col("first.a").alias("src_a"))
    )
    # single windows in a row from one source are one edge; paths are joined from these
    line = ["id", "src_id", "diag"]
    island = F.col("a") - F.row_number().over(Window.partitionBy(*line).orderBy("a"))
    runs = later.withColumn("diag", F.col("a") - F.col("src_a")).withColumn("island", island).groupBy(*line, "island").agg(F.min("a").alias("a"), F.count("*").cast("int").alias("n"), F.min("src_a").alias("src_a"))
    whole = compared.where("not open").select("id", "a", "n", "src_id", "src_a")
    edges, edges_path = stored(whole.unionByName(runs.select("id", "a", "n", "src_id", "src_a")), "repeated-edges")
    drop(spark, compared_path)
    types = {"a": "int", "n": "int", "src_a": "int"}
    paths, _ = stored(compact(edges).withColumns({c: F.col(c).cast(t) for c, t in types.items()}), "paths")
    drop(spark, edges_path)
    return verified(docs, paths, window)


def _span_digests(docs: DataFrame, window: int) -> DataFrame:
    """id, a, n, src_id, src_a, d1, d2 (digest): of the words of the windows a .. a + n - 1. docs: _id, _text, places (array of a, n, src_id, src_a)."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            ids = batch.column(0).take(pc.list_parent_indices(places))
            own = pc.list_flatten(places)
            digests = []
            for i, text in enumerate(batch.column(1)):
                w = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                for a, n in zip(*(v.tolist() for v in R.span_arrays(places, i)), strict=True):
                    digests.append(hashlib.blake2b(b" ".join(w[a : a + n + window - 1]), digest_size=16).digest())
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            cols = [ids, *(own.field(f) for f in ("a", "n", "src_id", "src_a")), *(pa.array(np.ascontiguousarray(d[:, i])) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "a", "n", "src_id", "src_a", "d1", "d2"])

    return docs.mapInArrow(run, "id long, a int, n int, src_id long, src_a int, d1 long, d2 long")


def verified(docs: DataFrame, paths: DataFrame, window: int = WINDOW) -> DataFrame:
    """Those of the stored ``paths`` (id, a, n, src_id, src_a) whose words are the same at both places. docs: _id, _text.

    Every document is read once for all its places, whether it is a copy or a source; a source that many copies share
    is asked for each stretch once. Digests of a stretch and its copies meet in one aggregate; only if some differ
    are paths looked up.
    """
    there = paths.select(F.col("src_id").alias("id"), F.col("src_a").alias("a"), "n", "src_id", "src_a").distinct()
    places = paths.select("id", "a", "n", "src_id", "src_a").unionByName(there)
    places = places.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_set(F.struct("a", "n", "src_id", "src_a"))).alias("places"))
    parts = split_by_ids(docs, places.select("_id"))
    own = (parts[0] if parts else docs).join(places, "_id").select("_id", "_text", "places")
    found, path = stored(_span_digests(own, window), "digests")
    stretch = ["src_id", "src_a", "n"]
    ends = [f(d).alias(f"{name}_{d}") for d in ("d1", "d2") for name, f in (("least", F.min), ("most", F.max))]
    differing = found.groupBy(*stretch).agg(*ends).where("least_d1 != most_d1 or least_d2 != most_d2").select(*stretch)
    differing, differing_path = stored(differing, "differing")
    cols = ["id", "a", "n", "src_id", "src_a"]
    out = paths.select(*cols)
    if not differing.isEmpty():
        some = found.join(differing, stretch)
        source = some.where("id = src_id and a = src_a").select(*stretch, F.col("d1").alias("s1"), F.col("d2").alias("s2"))
        wrong = some.join(source, stretch).where("d1 != s1 or d2 != s2").select(*cols)
        out, _ = stored(out.join(wrong, cols, "left_anti"), "verified")
    drop(docs.sparkSession, path, differing_path)
    return out


def _rest(docs: DataFrame, window: int, has_spans: bool, texts: bool, more: list[str]) -> DataFrame:
    """Words, removed words and the digest (or the text) of the rest. docs: _id, _key, _text, maybe spans, and ``more``."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.parts(batches, ROWS):
            words, removed, last = [], [], []
            for i, text in enumerate(batch.column(2)):
                w = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                gone = 0
                words.append(len(w))
                if has_spans:
                    a, n = R.span_arrays(batch.column(3), i)
                    if len(a):
                        hit = R.covered(len(w), a, n, window)
                        gone = int(hit.sum())
                        w = list(compress(w, (~hit).tolist()))
                removed.append(gone)
                if texts:
                    last.append(b" ".join(w).decode() if gone else text.as_py())
                else:
                    last.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *(batch.column(c) for c in more), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string())], names=["_key", *more, "n_words", "n_removed", "rest"])

    own = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("rest", T.StringType())]
    return docs.mapInArrow(run, T.StructType([docs.schema["_key"], *(docs.schema[c] for c in more), *own]))


def dedup_substrings(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K_MER, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that also starts earlier.

    Earlier: in a document of smaller key, or before in the same one; windows are judged on the input.
    Returns ``key``, n_words, n_removed and ``rest``: if ``texts``, the kept words joined by one space (the text
    as it is where nothing was removed), else the sha256 of the kept words joined by one space. A null text
    has no words. One row per input row: rows of one key, and equal rows, are told apart by a hash of the text,
    text and then place, a null key comes first; of equal rows the first keeps its words. An empty table gives
    none. Columns ``carry`` come along in one struct ``carried``, so their names can't clash with others.
    """
    docs = keyed(documents, key, text, list(carry))
    with batches_of(spark, ROWS):
        spans = removed_spans(spark, docs.select("_id", "_text"), window, k)
    by_row = R.per_row(spans)
    parts = split_by_ids(docs, spans.select(F.col("id").alias("_id")).distinct())
    cols, more = ["_id", "_key", "_text"], ["_row"] if carry else []
    if parts:
        touched, others = parts
        out = _rest(touched.join(by_row, "_id").select(*cols, "spans", *more), window, True, texts, more)
        out = out.unionByName(_rest(others.select(*cols, *more), window, False, texts, more))
    else:
        out = _rest(docs.join(by_row, "_id", "left").select(*cols, "spans", *more), window, True, texts, more)
    return out.withColumnsRenamed({"_key": key, "_row": "carried"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark, tables(spark, sf_dir, "documents")).withColumnRenamed("rest", "kept_sha256")
