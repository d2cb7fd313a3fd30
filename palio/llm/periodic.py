"""Periodic runs of words: stretches that repeat a unit three times or more, found with string synchronising sets.

A scale tau = 1, 2, 4, ... serves the periods from 3 tau - 1 to 6 tau - 2. Its synchronising set holds a place when the
least hash of the tau-word windows at the next tau + 1 places stands at the first or the last of them, so whether a
place is in the set follows from its 2 tau words alone. A run of such a period has a place of the set in its first
words whose context comes again one period on; equal contexts at a fitting distance therefore propose all periods, and
comparing words from there on gives the run. Windows of period tau / 3 or less take no part in the minimum. They lie in
runs of smaller scales, which are known by then, and repeats of one word are found by comparing neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from ._common import DataFrame, F, SparkSession, batches_of, let, stored, tables

#: Least words of a run that is reported; a run holds its unit three times at least.
LEAST, TIMES = 24, 3
BATCH, SLICE_BYTES = 256, 1 << 22
_MOST = ~K.U(0)


def _ways(x: np.ndarray, at: np.ndarray, d: np.ndarray, step: int) -> np.ndarray:
    """How many places from ``at`` on, going by ``step``, hold the same symbol as the place ``d`` further right."""
    reach, live, width = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    while len(live):
        t = (at[live] + step * reach[live])[:, None] + step * np.arange(width)
        far = t + d[live][:, None]
        inside = (t >= 0) & (far < len(x))
        same = inside & (x[np.where(inside, t, 0)] == x[np.where(inside, far, 0)])
        full = same.all(axis=1)
        reach[live] += np.where(full, width, np.argmin(same, axis=1))
        live = live[full]
        width = min(2 * width, max(8, (1 << 21) // max(1, len(live))))
    return reach


def _one_each(x: np.ndarray, at: np.ndarray, d: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last proposal, and distance, of proposals that lie in one stretch. Each is known to match for ``known`` places."""
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    gap = at[1:] - at[:-1]
    joined = (d[1:] == d[:-1]) & (gap <= np.maximum(d[1:], known))
    ask = np.flatnonzero(joined & (gap > known))
    lens = gap[ask] - known
    t = K.ragged(at[ask] + known, lens)
    if len(ask):
        same = x[t] == x[t + np.repeat(d[ask], lens)]
        joined[ask] = np.logical_and.reduceat(same, np.cumsum(lens) - lens)
    head = np.flatnonzero(np.concatenate(([True], ~joined)))
    return at[head], at[np.append(head[1:], len(at)) - 1], d[head]


def _pairs(context: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with an equal context ``low`` to ``high`` further on, and the distances."""
    order = np.argsort(context, kind="stable")
    c, p = context[order], at[order]
    found, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lag = 1
    while lag < len(c):
        d = p[lag:] - p[:-lag]
        near = (c[lag:] == c[:-lag]) & (d <= high)
        if not near.any():
            break  # within a context distances grow with the lag
        near &= d >= low
        found.append(p[:-lag][near])
        far.append(d[near])
        lag += 1
    return np.concatenate(found), np.concatenate(far)


def runs_in(x: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of three periods or more. ``longest``: no run is longer than that."""
    n = len(x)
    longest = n if longest is None else longest
    edge = np.flatnonzero(np.diff(np.concatenate(([False], x[1:] == x[:-1], [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2] + 1
    long = end - start >= TIMES
    starts, ends = start[long], end[long]
    periods = np.ones(len(starts), np.int64)
    tau, h = 1, K.mix(x.astype(np.int64).view(K.U) * K.U(0x9E3779B97F4A7C15) + K.U(1))
    while TIMES * (3 * tau - 1) <= longest and n >= 2 * tau:
        places = n - 2 * tau + 1
        small = np.flatnonzero((TIMES * periods <= tau) & (ends - starts >= tau))
        rank = h
        if len(small):  # windows of a small period
            depth = np.zeros(len(h) + 1, np.int64)
            np.add.at(depth, starts[small], 1)
            np.add.at(depth, ends[small] - tau + 1, -1)
            rank = np.where(np.cumsum(depth)[:-1] > 0, _MOST, h)
        least = K.sliding_min(rank, tau + 1)
        sync = np.flatnonzero(((least == rank[:places]) | (least == rank[tau:])) & (least != _MOST))
        context = K.mix(h[:places] * K.U(0xD1342543DE82EF95) + h[tau:])
        at, d = _pairs(context[sync], sync, 3 * tau - 1, 6 * tau - 2)
        if len(at):
            first, last, d = _one_each(x, at, d, 2 * tau)
            lo, hi = first + 1 - _ways(x, first, d, -1), last + _ways(x, last, d, 1) + d
            ok = np.flatnonzero(hi - lo >= TIMES * d)
            # a multiple of the smallest period has the same ends, and comes later
            s, e, q = (np.concatenate(v) for v in ((starts, lo[ok]), (ends, hi[ok]), (periods, d[ok])))
            order = np.lexsort((q, e, s))
            s, e, q = s[order], e[order], q[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
            starts, ends, periods = s[new], e[new], q[new]
        tau, h = 2 * tau, context
    return starts, ends - starts, periods


def _numbers(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of every text, and a number for each word, equal for equal words."""
    each = [t.split() for t in texts]  # at ASCII white space
    flat = pa.array([w for ws in each for w in ws], pa.binary())
    return each, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def runs_of_texts(texts: list[bytes], least: int = LEAST) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words of every text and its runs of ``least`` words or more: rows (start, length, period) by start, then period."""
    each, ids = _numbers(texts)
    size = np.array([len(ws) for ws in each], np.int64)
    offs = np.concatenate(([0], np.cumsum(size)))
    runs: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(each)
    # texts of like length together: a scale is only worked on where it can occur
    level = np.ceil(np.log2(np.maximum(size, 1)) / 2)
    for v in np.unique(level[size >= least]):
        rows = np.flatnonzero((level == v) & (size >= least))
        n = size[rows]
        to = np.concatenate(([0], np.cumsum(n + 1)))
        x = np.empty(to[-1], np.int64)
        x[to[1:] - 1] = -1 - np.arange(len(rows))  # a symbol of its own ends every text
        x[K.ragged(to[:-1], n)] = ids[K.ragged(offs[rows], n)]
        s, length, q = runs_in(x, int(n.max()))
        keep = np.flatnonzero(length >= least)
        keep = keep[np.lexsort((q[keep], s[keep]))]
        own = np.searchsorted(to, s[keep], side="right") - 1
        m = np.stack((s[keep] - to[own], length[keep], q[keep]), axis=1)
        cut = np.searchsorted(own, np.arange(len(rows) + 1))
        for k, row in enumerate(rows.tolist()):
            runs[row] = m[cut[k] : cut[k + 1]]
    return each, runs


def _rest(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``key``, n_words, runs (array of start, length, period) and rest: the words that no run repeats, joined by one space.

    Words are split at ASCII white space and numbered from 0. A run is a stretch of words that recur after ``period``
    words, the smallest such number, with ``least`` words and three periods at least, as long as possible; runs come by
    start, then period. Rest leaves out what a run holds after its first period.

    One row per input row in no order: repeated rows and null keys stay, ties can't occur (a stretch has one smallest
    period). A null or empty text has no words, no runs and an empty rest. Texts are read whole, a task holds one
    slice of them or one longer text. Other columns, whatever their names, are left out; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffers(batch.column(1))
            for i, j in K.slices(offs, SLICE_BYTES):
                raw = data[offs[i] : offs[j]].tobytes()
                ends = (offs[i : j + 1] - offs[i]).tolist()
                words, runs = runs_of_texts([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], least)
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(_RUN)),
                )
                rest = pa.array([_rest(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                cols = [batch.column(0).slice(i, j - i), pa.array([len(w) for w in words], pa.int64()), lists, rest]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n_words", "runs", "rest"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, rest string")
    return out.withColumnRenamed("key", key)


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words of one document in ten by a checksum of its id become a cycle from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def cycle(w):
        g, n = F.floor(h / 10), F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " "))

    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, cycle)).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_cycles(tables(spark, sf_dir, "documents")))

    def better(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        order = F.array(b - a, x["start"] - y["start"], x["period"] - y["period"])
        return F.coalesce(F.filter(order, lambda v: v != 0)[0], F.lit(0)).cast("int")

    best = F.when(F.size("runs") > 0, F.array_sort("runs", lambda x, y: F.signum(better(x, y)).cast("int"))[0])
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("rest", 256).alias("collapsed_sha256"))
    milli = F.floor((1000 * F.col("b.length")) / F.col("b.period"))
    out = digest.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
    with batches_of(spark, BATCH):
        return stored(out, "runs")[0]
