"""Ranked lexical search with best positions (BPA).

Documents are indexed in blocks, each by one task: for every term of the queries a list of its documents by falling
impact, and each document's own terms for direct accesses. A query reads its lists side by side. Every document it meets
is scored in full, which marks its places in all lists; a list's best position is the end of its leading places that are
marked. No document that hasn't been met can score more than the sum of what stands right after the best positions, and
reading stops when that sum is strictly below the k-th score so far, so that equal scores are still ordered by key. The
k-th score goes on to the next block of the task. Blocks have a bounded number of index entries, a task keeps k rows a
query, and Spark merges these. The statistics are taken over all documents first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from ._common import DataFrame, F, SparkSession, T, Window, batches_of, drop, is_small, keyed, stored, tables

TOP = 10
#: Index entries of a block, queries of one pass over the index, rows of a list that are read first.
ENTRIES, QUERIES_AT_ONCE, FIRST = 1 << 21, 2000, 32
BATCH, SLICE_BYTES = 512, 1 << 20
#: Fixed values of the score: saturation base and the weight of length in hundredths.
FLAT, LENGTH = 100, 75
_SALTS = 32


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all rows, and how many stand before each row."""
    data = K.LOWER[data]
    starts, ends, per = K.words(data, offs, K.ALNUM_WORD)
    return K.word_hashes(data, starts, ends), per


def _query_terms(items: DataFrame) -> DataFrame:
    """item, h, c: how often each term stands in an item. items: item, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffers(batch.column(1))
            h, per = _terms(data, offs)
            row = pa.array(np.repeat(np.arange(len(batch)), np.diff(per)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(h.view(np.int64))], names=["item", "h"])

    return items.mapInArrow(run, "item long, h long").groupBy("item", "h").agg(F.count("*").alias("c"))


def _index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc, n (terms), t, c: numbers of the document's terms in the sorted ``vocabulary`` and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffers(batch.column(1))
            for i, j in K.slices(offs, SLICE_BYTES):
                h, per = _terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = np.diff(per)
                row = np.repeat(np.arange(j - i), n)
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                own, count = np.unique(row[known] * max(1, len(vocabulary)) + at[known], return_counts=True)
                row, term = np.divmod(own, max(1, len(vocabulary)))
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=j - i)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *lists], names=["doc", "n", "t", "c"])

    return docs.mapInArrow(run, "doc long, n long, t array<int>, c array<int>")


def _frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term: a row per term and task goes into the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["t", "df"])

    out = np.zeros(terms, np.int64)
    for r in index.select("t").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        out[r["t"]] = r["df"]
    return out


class Block:
    """Impact lists of some documents, and each document's terms with impacts and places in the lists."""

    def __init__(self, doc: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.doc, self.ends, self.term, self.impact = doc, ends, term, impact
        row = np.repeat(np.arange(len(doc)), np.diff(ends))
        by = np.lexsort((-impact, term))
        self.list_doc, self.list_impact = row[by], impact[by]
        self.low = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms))))
        self.place = np.empty(len(term), np.int64)  # of each entry in all lists, one after another
        self.place[by] = np.arange(len(term))

    def best(self, terms: np.ndarray, weights: np.ndarray, all_weights: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with scores from ``floor`` on that are among the ``top`` or equal the last of them.

        ``all_weights`` has the ``weights`` of the query's ``terms``, and -1 for all other terms.
        """
        low, high = self.low[terms], self.low[terms + 1]
        at, best = low.copy(), low.copy()  # the next place to read, the first place that isn't marked
        lens = high - low
        base = np.concatenate(([0], np.cumsum(lens)))  # the query's lists, one after another
        marked = np.zeros(base[-1], bool)
        slot = np.full(len(all_weights), -1, np.int64)
        slot[terms] = np.arange(len(terms))
        met = np.zeros(len(self.doc), bool)
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        depth, kth = FIRST, floor
        while True:
            step = np.minimum(depth, high - at)
            new = np.unique(self.list_doc[K.ragged(at, step)])
            at += step
            depth *= 2
            new = new[~met[new]]
            met[new] = True
            n = self.ends[new + 1] - self.ends[new]
            entry = K.ragged(self.ends[new], n)  # direct accesses
            w = all_weights[self.term[entry]]
            row, entry, w = np.repeat(np.arange(len(new)), n)[w >= 0], entry[w >= 0], w[w >= 0]
            score = np.zeros(len(new), np.int64)
            if len(entry):
                head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                score[row[head]] = np.add.reduceat(w * self.impact[entry], head)
            own = slot[self.term[entry]]
            marked[base[own] + self.place[entry] - low[own]] = True
            found.append(new)
            scores.append(score)
            every = np.concatenate(scores)
            if len(every) >= top:
                kth = max(kth, int(np.partition(every, len(every) - top)[len(every) - top]))
            for k in np.flatnonzero(best < high).tolist():
                rest = marked[base[k] + best[k] - low[k] : base[k + 1]]
                stop = int(np.argmin(rest)) if len(rest) else 0
                best[k] = high[k] if len(rest) and rest[stop] else best[k] + stop
            open_ = best < high
            bound = int((weights[open_] * self.list_impact[best[open_]]).sum())
            if bound < kth or not (at < high).any():
                break
        rows, every = np.concatenate(found), np.concatenate(scores)
        keep = every >= max(1, kth)
        return rows[keep], every[keep]


def _search(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, docs: int, total: int, top: int) -> DataFrame:
    """item, doc, score: each task's best ``top`` of every query (number, terms, repeats)."""
    terms = len(weight)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> Block:
            t = pa.Table.from_batches(held).combine_chunks()
            term, c = (t[x].combine_chunks().flatten().to_numpy().astype(np.int64) for x in ("t", "c"))
            ends = np.concatenate(([0], np.cumsum(t["t"].combine_chunks().value_lengths().to_numpy()))).astype(np.int64)
            m = FLAT - LENGTH + (LENGTH * t["n"].to_numpy() * docs) // total
            impact = (1_000_000_000 * c) // (1000 * c + 8 * np.repeat(m, np.diff(ends)))
            return Block(t["doc"].to_numpy(), ends, term, impact, terms)

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= ENTRIES:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        every = np.full(terms, -1, np.int64)
        for block in blocks(batches):
            for k, (_, own, repeats) in enumerate(queries):
                d, s = have[k]
                w = weight[own] * repeats
                every[own] = w
                rows, score = block.best(own, w, every, top, int(s[-1]) if len(s) >= top else 1)
                every[own] = -1
                d, s = np.concatenate((d, block.doc[rows])), np.concatenate((s, score))
                order = np.lexsort((d, -s))[:top]
                have[k] = (d[order], s[order])
        item = np.repeat(np.array([q[0] for q in queries], np.int64), [len(d) for d, _ in have])
        yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.concatenate([h[i] for h in have])) for i in (0, 1))], names=["item", "doc", "score"])

    return index.where(F.size("t") > 0).mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """``item_key``, rank (from 1), ``key``, score: the ``top`` documents with the highest scores above 0 of every item.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. Keys of documents are longs;
    equal scores come by ascending key, rows that share a key by their text's hash, rows without a key first. Rows of
    ``items`` are items of their own, those with equal or null keys too. Null or empty texts have no terms; an item
    without terms and an empty table give no rows. Texts are read whole. Other columns, whatever their names, are left
    out. Items are searched in groups of ``QUERIES_AT_ONCE``, whose terms are all that the driver and the tasks hold of them.
    """
    spark = docs.sparkSession
    rows = keyed(docs, key, text)
    asked, asked_path = stored(items.select(F.col(f"`{item_key}`").alias("name"), F.col(f"`{item_text}`").cast("string").alias("t")).withColumn("item", F.monotonically_increasing_id()), "items")
    with batches_of(spark, BATCH):
        wanted, wanted_path = stored(_query_terms(asked.select("item", "t")), "item-terms")
    groups = wanted.select(F.floor(F.col("item") / QUERIES_AT_ONCE).alias("g")).distinct().orderBy("g").collect()
    parts, paths = [], []
    for (g,) in groups:
        part = wanted.where(F.floor(F.col("item") / QUERIES_AT_ONCE) == g).orderBy("item", "h").toPandas()
        vocabulary = np.unique(part["h"].to_numpy().view(np.uint64))
        with batches_of(spark, BATCH):
            index, index_path = stored(_index(rows.select("_id", "_text"), vocabulary), "index")
            df = _frequencies(index, len(vocabulary))
        n, total = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            drop(spark, index_path)
            continue
        weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        term = np.searchsorted(vocabulary, part["h"].to_numpy().view(np.uint64))
        item, c = part["item"].to_numpy(), part["c"].to_numpy()
        cut = np.concatenate(([0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)]))
        queries = [(int(item[a]), term[a:b], c[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        with batches_of(spark, BATCH):
            found, path = stored(_search(index, queries, weight, n, total, top), "found")
        drop(spark, index_path)
        parts.append(found)
        paths.append(path)
    out = parts[0] if parts else spark.createDataFrame([], "item long, doc long, score long")
    for p in parts[1:]:
        out = out.unionByName(p)
    order = [F.desc("score"), F.asc("doc")]
    few = out.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(_SALTS)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = asked.select("item", F.col("name").alias("__name__"))
    best, _ = stored(few.join(names, "item").select("__name__", "rank", "doc", "score"), "best")
    drop(spark, asked_path, wanted_path, *paths)
    keys = rows.select(F.col("_id").alias("doc"), "_key")
    named = keys.join(F.broadcast(best) if is_small(best) else best, "doc")
    return named.select(F.col("__name__").alias(item_key), "rank", F.col("_key").alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", F.col("score").cast(T.LongType()))
