"""Benchmark decontamination by winnowing.

A document and a test item that share ten words share a fingerprint: of the hashes of all 5-word grams the least in
every run of six is kept, and any ten words hold such a run. Fingerprints of documents and of test items are joined in
Spark; around every hit the match is extended: the ten-word windows there are joined with those of the items. Items of
under ten words have one window of their own length, whose fingerprint is the window itself. If the test fingerprints
are few by their count, tasks leave out document fingerprints that no item has before the join; else all are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from . import _tokens
from ._common import DataFrame, F, SparkSession, is_small, keyed, stored, tables

WINDOW, GRAM = 10, 5
#: Distinct test fingerprints (8 bytes each) up to which tasks get their list.
LIST_ROWS = 1_000_000
SLICE_BYTES = 1 << 19


def _symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = K.LOWER[data]
    starts, ends, per = K.words(data, offs, K.ALNUM_WORD)
    return K.word_hashes(data, starts, ends), per


def winnow(x: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (hash, position of the gram): every gram whose hash is the least of some window - gram + 1 neighbours."""
    if len(x) < window:
        return np.zeros(0, K.U), np.zeros(0, np.int64)
    grams, run = K.Rolling(x, 0).every(gram), window - gram + 1
    least = K.sliding_min(grams, run)
    # a gram is kept if the largest minimum of the runs it lies in is its own hash
    edge = np.full(run - 1, ~K.U(0))
    at = np.flatnonzero(~K.sliding_min(np.concatenate((edge, ~least, edge)), run) == grams)
    return grams[at], at


def _benchmark_windows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """size, one, two, item: windows of items; and with size 0 their fingerprints as ``one``. rows: i, t."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = K.text_buffers(batch.column(1))
            for i in range(len(ids)):
                x, _ = _symbols(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
                size = min(len(x), window)
                if not size:
                    continue
                prints = winnow(x, window, gram)[0] if size == window else np.zeros(0, K.U)
                one = np.concatenate((K.Rolling(x, 0).every(size), prints))
                two = np.concatenate((K.Rolling(x, 1).every(size), prints))
                kind = np.where(np.arange(len(one)) < len(one) - len(prints), size, 0)
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(one), ids[i]))], names=["size", "one", "two", "item"])

    return rows.mapInArrow(run, "size int, one long, two long, item long").distinct()


SCANNED = "_id long, _key long, n_words long, prints array<struct<h: long, at: int>>, short array<struct<size: int, at: int, one: long, two: long>>"


def _lists(values: list[np.ndarray], kinds: list[pa.DataType], names: list[str], row: np.ndarray, rows: int) -> pa.ListArray:
    """Structs of some columns by row; ``row`` ascends."""
    offs = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names))


def _scan(docs: DataFrame, window: int, gram: int, prints: np.ndarray | None, short: dict[int, np.ndarray | None]) -> DataFrame:
    """Fingerprints and short windows of documents: those in the lists, or all where there is no list. docs: _id, _key, _text."""
    handle = docs.sparkSession.sparkContext.broadcast((prints, short))

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shorts = handle.value
        for batch in batches:
            data, offs = K.text_buffers(batch.column(2))
            for i, j in K.slices(offs, SLICE_BYTES):
                x, per = _symbols(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                h, at = winnow(x, window, gram)
                row = np.searchsorted(per, at, side="right") - 1
                ok = at + gram <= per[row + 1] if len(at) else np.zeros(0, bool)
                if wanted is not None:
                    ok &= np.isin(h, wanted)
                h, at, row = h[ok], at[ok], row[ok]
                first = _lists([h.view(np.int64), (at - per[row]).astype(np.int32)], [pa.int64(), pa.int32()], ["h", "at"], row, j - i)
                found = [[np.zeros(0, np.int64)] for _ in range(5)]
                for size, listed in shorts.items():
                    if len(x) < size:
                        continue
                    one, two = K.Rolling(x, 0).every(size), K.Rolling(x, 1).every(size)
                    s = np.arange(len(one)) if listed is None else np.flatnonzero(np.isin(one, listed))
                    r = np.searchsorted(per, s, side="right") - 1
                    inside = s + size <= per[r + 1]
                    s, r = s[inside], r[inside]
                    for c, v in zip(found, (r, np.full(len(s), size), s - per[r], one[s].view(np.int64), two[s].view(np.int64)), strict=True):
                        c.append(v)
                row, *cols = (np.concatenate(c) for c in found)
                order = np.argsort(row, kind="stable")
                second = _lists([c[order] for c in cols], [pa.int32(), pa.int32(), pa.int64(), pa.int64()], ["size", "at", "one", "two"], row[order], j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(per)), first, second], names=["_id", "_key", "n_words", "prints", "short"])

    return docs.select("_id", "_key", "_text").mapInArrow(run, SCANNED)


def _around(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """_id, size, at, one, two: windows that hold a gram at one of ``places``. docs: _id, _text, places."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.arange(window - gram + 1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = K.text_buffers(batch.column(1))
            for i, one_id in enumerate(ids):
                x, _ = _symbols(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
                s = np.unique((np.array(batch.column(2)[i].as_py(), np.int64)[:, None] - back).ravel())
                s = s[(s >= 0) & (s + window <= len(x))]
                one, two = (K.Rolling(x, k).span(s, s + window).view(np.int64) for k in (0, 1))
                cols = (np.full(len(s), one_id, np.int64), np.full(len(s), window, np.int32), s.astype(np.int32), one, two)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["_id", "size", "at", "one", "two"])

    return docs.mapInArrow(run, "_id long, size int, at int, one long, two long")


def find_contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Words of documents that lie in any window of a benchmark item.

    Returns ``key``, n_words, n_hit, items (sorted ids), spans (start and size of every hit window) per input
    row. Rows with null or empty text have no words; equal rows are judged each; a null item id is
    ignored, and items of one id count as one. An empty benchmark hits nothing.
    """
    docs = keyed(documents, key, text)
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    windows, _ = stored(_benchmark_windows(rows, window, gram), "test-windows")
    prints, _ = stored(windows.where("size = 0").select(F.col("one").alias("h")).distinct(), "test-prints")
    wins = windows.where("size > 0")

    def listed(hashes: DataFrame) -> np.ndarray | None:
        """A list of hashes if it was counted and is short."""
        return np.array([r[0] for r in hashes.collect()], np.int64).view(K.U) if hashes.count() <= LIST_ROWS else None

    sizes = sorted(r["size"] for r in wins.where(F.col("size") < window).select("size").distinct().collect())  # under ten numbers
    short = {n: listed(wins.where(F.col("size") == n).select("one").distinct()) for n in sizes}
    scanned, _ = stored(_scan(docs, window, gram, listed(prints), short), "fingerprints")
    few = F.broadcast(prints) if is_small(prints) else prints
    hits = scanned.select("_id", F.explode("prints").alias("p")).select("_id", "p.h", "p.at").join(few, "h")
    places, _ = stored(hits.groupBy("_id").agg(F.collect_set("at").alias("places")), "places")  # at most the words of a document
    near = F.broadcast(places) if is_small(places, 100_000) else places
    extended = _around(docs.select("_id", "_text").join(near, "_id"), window, gram)
    every = extended.unionByName(scanned.select("_id", F.explode("short").alias("s")).select("_id", "s.*"))
    known = F.broadcast(wins) if is_small(wins, 500_000) else wins
    found = every.join(known, ["size", "one", "two"]).groupBy("_id").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    found, _ = stored(found, "hits")
    side = F.broadcast(found) if is_small(found, 100_000) else found
    rows = scanned.select("_id", "_key", "n_words").join(side, "_id", "left")
    # hit words: starts in order, each span adds what lies beyond all before it
    spans = F.sort_array(F.coalesce("spans", F.expr("cast(array() as array<struct<at: int, size: int>>)")))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grown = F.aggregate(spans, none, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).alias("n"), F.greatest(a["end"], s["at"] + s["size"]).alias("end")))
    flat = F.flatten(F.transform(spans, lambda s: F.array(s["at"], s["size"])))
    return rows.select(F.col("_key").alias(key), "n_words", grown["n"].cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), flat.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


__all__ = ["find_contamination", "query", "winnow"]
