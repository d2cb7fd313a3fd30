"""SimHash near-duplicates: exact links within a Hamming radius, compared bit-sliced.

Fingerprints that differ in at most 4 of 64 bits agree on at least two of six bit groups, so every pair
of groups is a join key and no link is lost. Within a key the fingerprints are stored as vertical bit
planes; the distances of all rows to their d-th neighbour are counted at once with carry-save adders,
64 rows to a machine word, and a block is left as soon as all its counters exceed the radius. Of the
links of a key only a spanning forest goes on to the components, which Spark joins contract by stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa

from . import _flat as K
from . import _tokens
from ._common import DataFrame, F, SparkSession, drop, is_small, stored, tables

RADIUS, SHINGLE, GROUPS = 4, 4, 6
#: Fingerprints of one key compared in one task; a longer key is dealt out to pairs of slots of this size.
SLOT, CHUNK = 4096, 1 << 16
SLICE_BYTES = 1 << 19

# XXH64 primes
P1, P2, P3, P4, P5 = (K.U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << K.U(r)) | (x >> K.U(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of a byte array at once."""
    buf = np.concatenate((data, np.zeros(40, np.uint8)))
    eights = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    fours = np.ndarray((len(buf) - 3,), dtype="<u4", buffer=buf, strides=(1,))
    one = np.zeros(1, K.U) + K.U(seed)
    h = np.broadcast_to(one + P5, len(start)).copy()
    at = start.copy()

    def step(acc, lane):
        return _rotl(acc + lane * P2, 31) * P1

    long = np.flatnonzero(size >= 32)
    if len(long):
        acc = [np.broadcast_to(v, len(long)).copy() for v in (one + P1 + P2, one + P2, one, one - P1)]
        left, live = size[long] // 32, np.arange(len(long))
        while len(live):
            for i in range(4):
                acc[i][live] = step(acc[i][live], eights[at[long[live]] + 8 * i])
            at[long[live]] += 32
            left[live] -= 1
            live = live[left[live] > 0]
        v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            v = (v ^ step(np.zeros(1, K.U), a)) * P1 + P4
        h[long] = v
    h += size.astype(K.U)
    rest = size & 31
    for _ in range(3):
        live = np.flatnonzero(rest >= 8)
        h[live] = _rotl(h[live] ^ step(np.zeros(1, K.U), eights[at[live]]), 27) * P1 + P4
        at[live] += 8
        rest[live] -= 8
    live = np.flatnonzero(rest >= 4)
    h[live] = _rotl(h[live] ^ (fours[at[live]].astype(K.U) * P1), 23) * P2 + P3
    at[live] += 4
    rest[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(rest)
        h[live] = _rotl(h[live] ^ (buf[at[live]].astype(K.U) * P5), 11) * P1
        at[live] += 1
        rest[live] -= 1
    h ^= h >> K.U(33)
    h *= P2
    h ^= h >> K.U(29)
    h *= P3
    return h ^ (h >> K.U(32))


def shingles_of(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, one row after another, and how many each row has."""
    data = K.LOWER[data]
    starts, ends, per = K.words(data, offs, K.SPACE_WORD)
    count = np.diff(per)
    grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    if not len(starts):
        return np.zeros(0, K.U), grams
    lens = ends - starts
    to = np.cumsum(lens + 1) - lens - 1
    joined = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    joined[K.ragged(to, lens)] = data[K.ragged(starts, lens)]
    first = K.ragged(per[:-1], grams)
    last = first + np.repeat(np.minimum(count, shingle), grams) - 1
    return xxh64(joined, to[first], to[last] + lens[last] - to[first]), grams


def majority(h: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes of every row (``grams`` hashes each, one row after another); zero without hashes."""
    out = np.zeros(len(grams), K.U)
    if not len(h):
        return out
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(grams)
    sums = np.add.reduceat(bits, (np.cumsum(grams) - grams)[some], axis=0, dtype=np.int32)
    major = 2 * sums > grams[some][:, None]
    out[some] = np.packbits(major, axis=1, bitorder="little").view(K.U).ravel()
    return out


def fingerprints_of(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of every row."""
    return majority(*shingles_of(data, offs, shingle))


def fingerprints(documents: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffers(batch.column(1))
            f = [fingerprints_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle) for i, j in K.slices(offs, SLICE_BYTES)]
            f = np.concatenate(f) if f else np.zeros(0, K.U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["doc", "fp"])

    return documents.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc long, fp long")


def _planes(f: np.ndarray) -> np.ndarray:
    """Bit b of all fingerprints as row b, 64 to a word, with a word of zeros at the end."""
    bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out = np.zeros((64, (len(f) // 64 + 2) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(K.U)


def _pack(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    p = np.packbits(flags, bitorder="little")
    out[: len(p)] = p
    return out.view(K.U)


def near(planes: np.ndarray, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Of the ``wanted`` lanes, those whose row differs from the row ``shift`` later in at most ``radius`` bits."""
    q, r = divmod(shift, 64)
    width = len(wanted)
    counters = [np.zeros(width, K.U) for _ in range((radius + 1).bit_length())]
    alive = wanted.copy()
    for b in range(64):
        own = planes[b]
        other = np.zeros(width, K.U)
        other[: width - q] = own[q:]
        if r:
            other >>= K.U(r)
            other[: width - q - 1] |= own[q + 1 :] << K.U(64 - r)
        carry = own ^ other
        for c in counters:  # carry-save: add one bit to every lane's counter
            carry, c[:] = carry & c, carry ^ c
        alive &= ~carry
        over = np.zeros(width, K.U)  # counter > radius
        equal = ~over
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                over |= equal & counters[i]
                equal &= ~counters[i]
        alive &= ~over
        if b % 4 == 3 and not alive.any():
            break
    return alive


def links(key: np.ndarray, f: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within every key. Rows of a key stand together."""
    out_u, out_v = [], []
    parent = np.arange(len(f))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    rows = np.arange(len(f))
    shift = 1
    while True:
        # keep the rows of keys with more than ``shift`` rows
        k = key[rows]
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(cut, len(rows)))
        rows = rows[np.repeat(size > shift, size)]
        if not len(rows):
            break
        k, planes = key[rows], _planes(f[rows])
        for d in range(shift, 2 * shift):
            same = k[:-d] == k[d:] if d < len(k) else np.zeros(0, bool)
            if not same.any():
                return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (f[:0], f[:0])
            alive = near(planes, d, _pack(same, planes.shape[1]), radius)
            hit = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[: len(k)])
            if len(hit):
                i, j = rows[hit], rows[hit + d]
                apart = np.flatnonzero(parent[i] != parent[j])
                got = []
                for x in apart:
                    a, b = root(int(i[x])), root(int(j[x]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        got.append(x)
                if got:
                    out_u.append(f[i[got]])
                    out_v.append(f[j[got]])
                    while True:  # flatten
                        up = parent[parent]
                        if np.array_equal(up, parent):
                            break
                        parent = up
        shift *= 2
    return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (f[:0], f[:0])


def _keys(fp: str = "fp"):
    """Join keys: every pair of six bit groups, with the pair's number on top."""
    edges = [round(64 * g / GROUPS) for g in range(GROUPS + 1)]
    part = [F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    pairs = combinations(range(GROUPS), 2)
    return F.array(*(F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(part[a], 16) + part[b] for n, (a, b) in enumerate(pairs)))


def link_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) that connect all that are within ``radius`` (at most 4)."""
    rows = distinct.select("fp", F.explode(_keys()).alias("key"))
    large, _ = stored(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > SLOT).select("key", F.ceil(F.col("c") / SLOT).cast("int").alias("s")), "large")
    rows = rows.join(F.broadcast(large) if is_small(large) else large, "key", "left")
    slot = F.pmod(F.xxhash64("fp"), F.coalesce("s", F.lit(1))).cast("int")
    rows = rows.withColumn("slot", slot).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1)))
    rows = rows.select("key", F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"), "fp")

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def solve(m: np.ndarray):
            ids = np.cumsum(np.concatenate(([0], (m[1:, :3] != m[:-1, :3]).any(axis=1))))
            u, v = links(ids, np.ascontiguousarray(m[:, 3]).view(K.U), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            size += len(batch)
            if size >= CHUNK:
                m = np.concatenate(held)
                cut = np.flatnonzero((m[1:, :3] != m[:-1, :3]).any(axis=1))
                end = int(cut[-1]) + 1 if len(cut) else 0
                if end:
                    yield solve(m[:end])
                held = [m[end:]]
                size = len(m) - end
        if size:
            yield solve(np.concatenate(held))

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (u, v longs); root is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stay the same; every
    step is a grouped minimum and a join, its result a stored table.
    """
    spark = edges.sparkSession
    now, path = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    mark = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.where("u <> v").distinct()
        low, mid = stored(low, "large-star")
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after, new_path = stored(small.where("u <> v").distinct(), "small-star")
        new_mark = state(after)
        drop(spark, path, mid)
        now, path = after, new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.withColumnRenamed("u", "node").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``key``, fp (long), component (least key reachable over links of at most ``radius`` differing bits).

    Words are lower-cased (A-Z) and split at ASCII white space; a text of fewer words than ``shingle`` is one
    shingle, null or empty texts have fingerprint zero and link like any other. One row per input row;
    repeated rows share their fingerprint. A null key gets a component if another row of it has a key.
    """
    fps, _ = stored(fingerprints(documents, key, text, shingle), "fingerprints")
    classes, _ = stored(fps.groupBy("fp").agg(F.min("doc").alias("least")), "classes")
    comp = components(link_edges(classes.select("fp"), radius))
    labelled = classes.join(comp, classes.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = labelled.groupBy("root").agg(F.min("least").alias("component"))
    by_fp, _ = stored(labelled.join(firsts, "root").select("fp", "component"), "components")
    side = F.broadcast(by_fp) if is_small(by_fp) else by_fp
    return fps.join(side, "fp").select(F.col("doc").alias(key), "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
