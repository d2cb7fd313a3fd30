"""Suffix-array deduplication of byte strings.

Repeats of 400 bytes are narrowed down by minimizers first (see _repeats): blocks found twice repeat as a
whole, and only the surroundings of minimizers with several contents are sorted. Those *contexts* are
grouped by the minimizer and the bytes that all their windows share, so a group holds real candidates
only. Each group's suffix array is built in two stages: suffixes smaller than their successor are sorted
directly, all others are induced from these by one scan of the buckets of the first byte. Windows that
share 400 bytes with their neighbour in the array are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from . import _repeats as R
from ._common import DataFrame, F, SparkSession, is_small, keyed, split_by_ids, stored, tables

WINDOW, K_GRAM = 400, 32
#: Different contexts of one key that are sorted at most (more are split first), and bytes sorted in one array.
GROUP, CHUNK_BYTES = 300, 150_000


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over ``depth`` bytes at least. The last byte must be 0."""
    n = len(data)
    up = np.empty(n, dtype=bool)  # whether a suffix is smaller than its successor
    change = np.flatnonzero(data[1:] != data[:-1])  # i with data[i] != data[i + 1]
    run_end = np.full(n, n - 1)
    if len(change):
        at = np.searchsorted(change, np.arange(n))
        run_end[at < len(change)] = change[at[at < len(change)]]
    following = np.append(data[1:], 0)
    up[:] = following[run_end] > data
    up[run_end == n - 1] = True
    # stage 1: direct sort
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    small = np.flatnonzero(up)
    keys = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))[small]).view(f"S{depth}").ravel()
    small = small[np.argsort(keys, kind="stable")]
    del keys
    # stage 2: by buckets in ascending order; the successor's bucket is complete when it is needed
    rank = np.empty(n, np.int64)
    order = np.empty(n, np.int64)
    large = np.flatnonzero(~up)
    large = large[np.argsort(data[large], kind="stable")]
    bounds_large = np.searchsorted(data[large], np.arange(257))
    bounds_small = np.searchsorted(data[small], np.arange(257))
    done = 0
    for c in range(256):
        own = large[bounds_large[c] : bounds_large[c + 1]]
        if len(own):
            length = run_end[own] - own
            own = own[np.lexsort((rank[run_end[own] + 1], length))]
        for part in (own, small[bounds_small[c] : bounds_small[c + 1]]):
            order[done : done + len(part)] = part
            rank[part] = np.arange(done, done + len(part))
            done += len(part)
    return order


def common_at_least(data: np.ndarray, p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at ``p`` and ``q`` share ``depth`` bytes (a multiple of 8)."""
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    live = np.arange(len(p))
    for at in range(0, depth, 8):
        live = live[eights[p[live] + at] == eights[q[live] + at]]
        if not len(live):
            break
    out = np.zeros(len(p), dtype=bool)
    out[live] = True
    return out


def repeated_windows(contexts: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each context, which of its windows occur twice or more in all of them."""
    lens = np.array([len(c) for c in contexts])
    data = np.concatenate([x for c in contexts for x in (c, np.zeros(1, np.uint8))])
    starts = np.cumsum(lens + 1) - lens - 1
    room = np.repeat(starts + lens, lens + 1) - np.arange(len(data))  # bytes up to the context's end
    order = suffix_order(data, window)
    order = order[room[order] >= window]
    same = common_at_least(data, order[:-1], order[1:], window)
    hit = np.zeros(len(data), dtype=bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[s : s + max(0, n - window + 1)] for s, n in zip(starts, lens, strict=True)]


CONTEXT = "key long, id long, a int, off int, bytes binary"


def _context_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["key", "id", "a", "off", "bytes"])


def _contexts(docs: DataFrame, window: int, k: int) -> DataFrame:
    """key, id, a, off, bytes: surroundings of open minimizers in halves; off is the minimizer's place in them. docs: _id, _text, opens (array of a)."""
    reach, half = window - k, (window - k) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 128) for b in batches for i in range(0, len(b), 128)):
            data, offs = K.text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for i, one in enumerate(ids):
                text = data[offs[i] : offs[i + 1]]
                x = K.BYTE_VALUE[text]
                anchor, _, _, a, n = K.blocks(x, np.array([0, len(x)]), window, k)
                own = np.flatnonzero(np.isin(a, batch.column(2)[i].values.to_numpy(zero_copy_only=False)))
                roll = K.Rolling(x, 1)
                grams = K.Rolling(x, 0).every(k)
                for j in own:
                    first, last = int(a[j]), int(a[j] + n[j] - 1)
                    p = last + int(np.flatnonzero(grams[last : first + reach + 1] == anchor[j])[0])  # lies in all windows
                    for lo, hi, s, e in ((max(first, p - reach), min(last, p - half), p - half, p + k), (max(first, p - half + 1), min(last, p), p, p - half + 1 + window)):
                        if lo <= hi:
                            key = K.mix(roll.span(np.array([s]), np.array([e])) ^ anchor[j])[0]
                            for c, v in zip(rows, (key.view(np.int64), one, lo, p - lo, text[lo : hi + window].tobytes()), strict=True):
                                c.append(v)
            yield _context_batch(rows)

    return docs.mapInArrow(run, CONTEXT)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def _sorted_groups(contexts: DataFrame, window: int) -> DataFrame:
    """Repeats (id, a, n) inside groups of contexts with one key; several groups share a suffix array."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, a, n = [], [], []
        texts = [np.frombuffer(h[3], np.uint8) for h in held]
        for h, hit in zip(held, repeated_windows(texts, window), strict=True):
            for s, m in zip(*_runs(hit), strict=True):
                ids.append(h[1])
                a.append(h[2] + int(s))
                n.append(int(m))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int32()), pa.array(n, pa.int32())], names=["id", "a", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups
        group: list[tuple] = []  # of the current key
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "a", "bytes")), strict=True):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:
                        held += group
                        size += sum(len(g[3]) for g in group)
                        if size > CHUNK_BYTES:
                            yield from solve(held)
                            held, size = [], 0
                    group = []
                group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield from solve(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, a int, n int")


def _split(contexts: DataFrame, window: int, step: int) -> DataFrame:
    """Contexts cut into ranges of ``step`` windows, aligned at the minimizer; the bytes that all windows of a range share join the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            rows: list[list] = [[], [], [], [], []]
            for key, one, a, off, raw in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                roll, n = K.Rolling(K.BYTE_VALUE[np.frombuffer(raw, np.uint8)], 1), len(raw) - window + 1
                s = 0
                while s < n:  # the window at s has the minimizer at off - s
                    low = (off - s) // step * step
                    e = min(n, off - low + 1)
                    shared = roll.span(np.array([off - low]), np.array([off - low - step + 1 + window]))
                    own = K.mix(shared + np.array([key]).view(K.U))[0]
                    for c, v in zip(rows, (own.view(np.int64), one, a + s, off - s, raw[s : e - 1 + window]), strict=True):
                        c.append(v)
                    s = e
            yield _context_batch(rows)

    return contexts.mapInArrow(run, CONTEXT)


def _repeats_in(contexts: DataFrame, window: int) -> DataFrame:
    """Repeats (id, a, n) among contexts with one key.

    Equal contexts repeat as a whole and go on as one. Keys with up to ``GROUP`` different contexts are sorted;
    larger ones are split into ranges of windows that share more bytes, which separates what differs and
    makes equal what is common, until each is small: a range of one window has no different contexts.
    """
    found = []
    content = [F.xxhash64("bytes").alias("h"), F.crc32("bytes").alias("h2")]
    step = window // 2
    while True:
        marked = contexts.select("key", "id", "a", "off", "bytes", *content)
        classes, _ = stored(marked.groupBy("key", "h", "h2").agg(F.count("*").alias("c"), F.min(F.struct("id", "a")).alias("at"), F.first("off").alias("off"), F.first("bytes").alias("bytes")), "contents")
        several = classes.where("c > 1").select("key", "h", "h2")
        n = (F.octet_length("bytes") - window + 1).cast("int").alias("n")
        found.append(marked.select("key", "id", "a", n, "h", "h2").join(several, ["key", "h", "h2"]).select("id", "a", "n"))
        rest = classes.select("key", F.col("at.id").alias("id"), F.col("at.a").alias("a"), "off", "bytes")
        sizes = rest.groupBy("key").agg(F.count("*").alias("c"))
        # at most count / GROUP keys have more than GROUP contexts
        large, _ = stored(sizes.where(F.col("c") > GROUP).select("key"), "large")
        side = F.broadcast(large) if is_small(large) else large
        found.append(_sorted_groups(rest.join(side, "key", "left_anti"), window))
        if step == 1 or large.isEmpty():
            break
        step = max(1, step // 4)
        contexts, _ = stored(_split(rest.join(side, "key", "left_semi"), window, step), "contexts")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def removed_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = K_GRAM) -> DataFrame:
    """Windows that start twice or more: id, a, n (windows a .. a + n - 1). ``docs``: _id, _text."""
    found = R.find_blocks(docs, R.byte_symbols, window, k, keep_first=False)
    compared, _ = stored(R.compare_blocks(found, keep_first=False), "blocks")
    opens = compared.where("open").groupBy(F.col("id").alias("_id")).agg(F.collect_set("a").alias("opens"))
    parts = split_by_ids(docs, compared.where("open").select(F.col("id").alias("_id")).distinct())
    own = (parts[0] if parts else docs).join(opens, "_id").select("_id", "_text", "opens")
    contexts, _ = stored(_contexts(own, window, k), "contexts")
    return compared.where("not open").select("id", "a", "n").unionByName(_repeats_in(contexts, window))


def _rest(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """docs: _id, _key, _text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffers(batch.column(2))
            size, removed, runs, last = [], [], [], []
            for i in range(len(batch)):
                text = data[offs[i] : offs[i + 1]]
                a, n = R.span_arrays(batch.column(3), i)
                hit = R.covered(len(text), a, n, window)
                size.append(len(text))
                removed.append(int(hit.sum()))
                runs.append(len(_runs(hit)[0]))
                rest = text[~hit].tobytes()
                last.append(rest if texts else hashlib.sha256(rest).hexdigest().encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (size, removed, runs)), pa.array(last, pa.binary())], names=["_id", "_key", "n_bytes", "n_removed", "n_spans", "rest"])

    return docs.mapInArrow(run, "_id long, _key long, n_bytes long, n_removed long, n_spans long, rest binary")


def dedup_bytes(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K_GRAM, texts: bool = False) -> DataFrame:
    """Removes each byte covered by a ``window``-byte string that also starts anywhere else, first place included.

    Strings lie in one document and are judged on the input. Returns ``key``, n_bytes, n_removed, n_spans
    (maximal removed runs) and ``rest``: the remaining bytes if ``texts``, else the hex digits of their
    sha256 (both binary). A null text is empty. One row per input row; equal rows are copies of each other.
    ``window`` must be a multiple of 8.
    """
    docs = keyed(documents, key, text)
    spans, _ = stored(removed_spans(spark, docs, window, k), "spans")
    by_row = R.per_row(spans)
    raw = F.coalesce(F.col("_text"), F.lit("")).cast("binary")
    plain = [F.col("_key").alias(key), F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (raw if texts else F.sha2(raw, 256).cast("binary")).alias("rest")]
    parts = split_by_ids(docs, spans.select(F.col("id").alias("_id")).distinct())
    if parts:
        touched, others = parts
        out = _rest(touched.join(by_row, "_id").select("_id", "_key", "_text", "spans"), window, texts)
        return out.drop("_id").withColumnRenamed("_key", key).unionByName(others.select(*plain))
    out = _rest(docs.join(by_row, "_id", "left").select("_id", "_key", "_text", "spans"), window, texts)
    return out.drop("_id").withColumnRenamed("_key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark, tables(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.col("rest").cast("string")).drop("rest")
