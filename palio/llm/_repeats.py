"""Repeated windows of symbols across a corpus, found without shuffling every window.

Every window of ``window`` symbols belongs to the k-gram of least hash in it (its *anchor*), so equal
windows have equal anchors. Neighbouring windows with one anchor form a *block*; about one block per
(window - k + 2) / 2 symbols goes to the shuffle instead of every window. Blocks of equal content repeat
as a whole. Blocks that share an anchor but differ are compared window by window in a second step.

Each map task first merges its own equal blocks, so a passage of which millions of copies exist sends one
row per task to the shuffle. Blocks are compared by two independent 64-bit hashes (anchor and content).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from . import _tokens
from ._common import DataFrame, F, Window

#: Bytes of text handled at once and blocks held before they are merged.
SLICE_BYTES, HELD_BLOCKS = 1 << 19, 1_000_000

#: Symbols of some texts: values, and for each row the number of symbols before it.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

OCCURRENCE = "anchor long, block long, id long, a int, n int, cnt int, src_id long, src_a int"


def word_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, per = K.words(data, offs, K.SPACE_WORD)
    return K.word_hashes(data, starts, ends), per


def byte_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.BYTE_VALUE[data], offs


def _merged(anchor, block, ids, a, n, keep_first: bool):
    """Rows of one task: a representative per block content with its count, and the places that are repeats for sure.

    With ``keep_first`` the first place of a content isn't a repeat (later ones are); else all places of a
    content with two or more are. Repeats of touching blocks from one source run on as one row.
    """
    order = np.lexsort((a, ids, block, anchor))
    anchor, block, ids, a, n = (v[order] for v in (anchor, block, ids, a, n))
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(ids)))
    none = np.zeros(len(head), np.int64)
    rep = (anchor[head], block[head], ids[head], a[head], n[head], count, none, none)
    source = np.repeat(head, count)
    again = ~new if keep_first else np.repeat(count > 1, count)
    at = np.flatnonzero(again)
    src = source[at]
    if not keep_first:  # the first place has the second as its source
        src = np.where(src == at, src + 1, src)
    di, da, dn, si, sa = ids[at], a[at], n[at], ids[src], a[src]
    order = np.lexsort((da, di))
    di, da, dn, si, sa = (v[order] for v in (di, da, dn, si, sa))
    if len(di):
        runs_on = (di[1:] == di[:-1]) & (da[:-1] + dn[:-1] == da[1:]) & (si[1:] == si[:-1]) & (da[1:] - sa[1:] == da[:-1] - sa[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~runs_on)))
        end = np.append(head[1:], len(di)) - 1
        dn = da[end] + dn[end] - da[head]
        di, da, si, sa = di[head], da[head], si[head], sa[head]
    key = K.mix(di.astype(np.int64).view(K.U))  # spreads these rows over the tasks that follow
    zero = np.zeros(len(di), np.int64)
    return rep, (key, zero.view(K.U), di, da, dn, zero, si, sa)


def _batch(cols) -> pa.RecordBatch:
    anchor, block, ids, a, n, cnt, si, sa = cols
    i4 = [np.ascontiguousarray(v, dtype=np.int32) for v in (a, n, cnt, sa)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(anchor).view(np.int64)), pa.array(np.ascontiguousarray(block).view(np.int64)), pa.array(np.asarray(ids, np.int64)), pa.array(i4[0]), pa.array(i4[1]), pa.array(i4[2]), pa.array(np.asarray(si, np.int64)), pa.array(i4[3])],
        names=["anchor", "block", "id", "a", "n", "cnt", "src_id", "src_a"],
    )


def find_blocks(docs: DataFrame, symbols: Symbols, window: int, k: int, keep_first: bool) -> DataFrame:
    """OCCURRENCE rows of ``docs`` (_id, _text): representatives (cnt > 0) and repeats within one task (cnt = 0)."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            cols = [np.concatenate([h[i] for h in held]) for i in range(5)]
            for part in _merged(*cols, keep_first):
                for i in range(0, len(part[0]), 200_000):
                    yield _batch([c[i : i + 200_000] for c in part])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = K.text_buffers(batch.column(1))
            for i, j in K.slices(offs, SLICE_BYTES):
                x, per = symbols(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                anchor, block, row, a, n = K.blocks(x, per, window, k)
                if len(row):
                    held.append((anchor, block, ids[i:j][row], a, n))
                    size += len(row)
                if size > HELD_BLOCKS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select("_id", "_text").mapInArrow(run, OCCURRENCE)


def compare_blocks(found: DataFrame, keep_first: bool) -> DataFrame:
    """Repeats and open cases: id, a, n, src_id, src_a, anchor, open.

    ``open`` rows stand for one content of an anchor that has several; their windows need a comparison of
    their own. The others are repeats of the windows a .. a + n - 1 from those at src_a in src_id.
    """
    same = Window.partitionBy("anchor", "block").orderBy("id", "a")
    whole = Window.partitionBy("anchor", "block")
    of_anchor = Window.partitionBy("anchor")
    rows = (
        found.repartition("anchor")
        .withColumn("rank", F.row_number().over(same))
        .withColumn("first", F.first(F.struct("id", "a")).over(same))
        .withColumn("total", F.sum("cnt").over(whole))
        .withColumn("mixed", F.min("block").over(of_anchor) != F.max("block").over(of_anchor))
    )
    direct = F.col("cnt") == 0
    if keep_first:
        repeat = (F.col("rank") > 1) & ~direct
    else:
        repeat = (F.col("total") > 1) & (F.col("cnt") == 1)
    opens = (F.col("rank") == 1) & F.col("mixed") & ~direct
    made = F.array_compact(
        F.array(
            F.when(direct, F.struct("src_id", "src_a", F.lit(False).alias("open"))),
            F.when(repeat, F.struct(F.col("first.id").alias("src_id"), F.col("first.a").alias("src_a"), F.lit(False).alias("open"))),
            F.when(opens, F.struct(F.col("id").alias("src_id"), F.col("a").alias("src_a"), F.lit(True).alias("open"))),
        )
    )
    return rows.where(direct | repeat | opens).select("id", "a", "n", "anchor", F.explode(made).alias("m")).select("id", "a", "n", "m.src_id", "m.src_a", "anchor", "m.open")


def per_row(spans: DataFrame) -> DataFrame:
    """Spans (id, a, n) by id: _id, and the sorted array ``spans``. A row has no more spans than symbols."""
    return spans.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_set(F.struct("a", "n"))).alias("spans"))


def span_arrays(col: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of the spans of row ``i``; empty for null."""
    v = col[i].values
    if v is None:
        e = np.zeros(0, np.int64)
        return e, e
    return v.field("a").to_numpy(zero_copy_only=False).astype(np.int64), v.field("n").to_numpy(zero_copy_only=False).astype(np.int64)


def covered(size: int, a: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` symbols any window starting at a .. a + n - 1 covers."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, a + n + window - 1, -1)
    return np.cumsum(step[:-1]) > 0
