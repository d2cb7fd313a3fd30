"""Token ids in files, coded by an adaptive context-mixing range coder.

A file is a Parquet table with one row per block; a block holds whole documents and is decoded alone.
Within a block the ids are cut into equal lanes that are coded side by side with one shared model, which
starts anew in every block. The order-2 and the order-1 context each predict one id with a confidence, order 0
gives every id a share by adaptive counts. The three are mixed into one distribution: both predictions get extra
weight on top of their order-0 share, and adaptive weights by both confidences say how much each part counts.
Every id is one step of the range coder under that mixture. Checksums cover the ids of a block.

Block layout, all little-endian: magic ``PLB2``; u32 documents, tokens, lanes, vocabulary; u32 crc32 of the
ids as u32; i64 document keys and u8 flags (1: null key), u32 token counts; u32 words of each lane; the words
of the lanes, u32 each, one lane after another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _tokens
from ._common import DataFrame, F, SparkSession, batches_of, in_order, scratch, tables

MAGIC, END = b"PLB2", 2
#: A block has about so many tokens, and lanes of ``LANE_TOKENS`` or more, at most ``LANES``.
BLOCK_TOKENS, LANES, LANE_TOKENS = 1 << 22, 4096, 256
U = np.uint64
_LOW, _WORD = U(0xFFFFFFFF), U(32)
#: Bits of a confidence and its ceiling, bits of the order-2 table and of mixed weights.
SURE_BITS, TOP, SLOT_BITS, BITS = 3, 7, 18, 11
#: Order-0 step and ceiling, and steps between refreshes of counts and weights.
STEP, CEILING, REFRESH = 12, 1 << 20, 4
#: The decoder's guide has an id for every 2**GUIDE_BITS order-0 counts; no part of the format.
GUIDE_BITS = 6


def _pick(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x`` where ``mask``, else ``y``, in bits; several times faster than a choice by branches."""
    return y ^ ((x ^ y) & -mask.astype(x.dtype))


class Model:
    """The state both sides hold. Integers only, so coder and decoder agree everywhere.

    A table entry is a predicted id and its confidence in the lowest bits. A *cell* is the pair of both confidences and
    whether the predictions agree. All lanes of a cell share their weights: the adaptive counts of what held there,
    order 2's prediction, order 1's or neither.
    """

    def __init__(self, vocabulary: int):
        #: 32 bits hold every part of the mixture unless the ids alone exceed the ceiling of their counts.
        self.kind = np.dtype(np.uint32 if vocabulary <= CEILING else np.int64)
        self.two, self.one = np.zeros(1 << SLOT_BITS, self.kind), np.zeros(vocabulary, self.kind)
        sure = np.arange(TOP + 1)
        self.held = np.ones((TOP + 1, TOP + 1, 2, 3), np.int64)
        self.held[..., 0] += 4 * sure[:, None, None]
        self.held[..., 0, 1] += 2 * sure
        self.held[..., 2] += 8
        self.held = self.held.reshape(-1, 3)
        self.count = np.ones(vocabulary, self.kind)
        self.below = np.zeros(vocabulary + 1, self.kind)  # order-0 counts of smaller ids
        self.total = vocabulary
        self.missed: list[np.ndarray] = []  # ids that are counted at the next refresh
        self.steps = 0
        self._weigh()
        self._refresh()

    def _weigh(self) -> None:
        weights = self.held[:, :2] * ((1 << BITS) - 1) // self.held.sum(axis=1)[:, None]
        self.weight2, self.weight1 = weights[:, 0].astype(self.kind), weights[:, 1].astype(self.kind)

    def _refresh(self) -> None:
        if self.missed:
            missed = np.concatenate(self.missed)
            self.count += (STEP * np.bincount(missed, minlength=len(self.count))).astype(self.kind)
            self.total += STEP * len(missed)
            self.missed = []
        if self.total > CEILING:
            self.count = (self.count + 1) >> 1
        np.cumsum(self.count, out=self.below[1:], dtype=self.kind)
        self.total = int(self.below[-1])
        self.guide: np.ndarray | None = None

    def predict(self, before: np.ndarray, last: np.ndarray):
        """Predictions of order 2 and 1, their weights and that of order 0 out of 2**BITS, and what ``learn`` needs."""
        slot = (((before * 0x2C1B3C6D + last) * 0x297A2D39) & 0x7FFFFFFF) >> (31 - SLOT_BITS)
        slot, last = slot.astype(np.intp), last.astype(np.intp)
        e2, e1 = self.two[slot], self.one[last]
        two, one = e2 >> SURE_BITS, e1 >> SURE_BITS
        cell = ((((e2 & TOP) << SURE_BITS) | (e1 & TOP)) << 1) | (two == one)
        cell = cell.astype(np.intp)
        w2, w1 = self.weight2[cell], self.weight1[cell]
        return two, one, w2, w1, (1 << BITS) - w2 - w1, (slot, last, e2, e1, cell)

    def learn(self, state, ids: np.ndarray) -> None:
        two, one, _, _, _, (slot, last, e2, e1, cell) = state
        wrong2, wrong1 = two != ids, one != ids
        neither = wrong2 & wrong1
        held = cell * 3
        held += wrong2
        held += neither
        self.held += np.bincount(held, minlength=self.held.size).reshape(self.held.shape)
        self.missed.append(ids[neither])
        other = ids << SURE_BITS
        for table, key, entry, wrong in ((self.two, slot, e2, wrong2), (self.one, last, e1, wrong1)):
            sure = entry & TOP
            # right: surer by one; wrong: half as sure, or another id if it was not sure at all
            new = entry + (~wrong & (sure < TOP)) - wrong * ((sure + 1) >> 1)
            table[key] = _pick(wrong & (sure == 0), other, new)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps < REFRESH:
            over = self.held.sum(axis=1) > 1 << 14
            self.held[over] = (self.held[over] + 1) >> 1
            self._weigh()
            self._refresh()

    def interval(self, state, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Start and size of each id's part of the mixture, and the whole."""
        two, one, w2, w1, w0, _ = state
        at = ids.astype(np.intp)
        start = w0 * self.below[at] + ((two < ids) * w2 + (one < ids) * w1) * self.total
        size = w0 * self.count[at] + ((two == ids) * w2 + (one == ids) * w1) * self.total
        return start, size, self.total << BITS

    def _locate(self, goal: np.ndarray) -> np.ndarray:
        """The ids whose order-0 counts hold ``goal``: a guide has the id at every 2**GUIDE_BITS counts, a few steps lead on."""
        below = self.below
        if self.guide is None:
            self.guide = np.cumsum(np.bincount((below + ((1 << GUIDE_BITS) - 1)) >> GUIDE_BITS)) - 1
        x = self.guide[goal >> GUIDE_BITS]
        for _ in range(2):
            x += below[x + 1] <= goal
        far = np.flatnonzero(below[x + 1] <= goal)
        x[far] = np.searchsorted(below, goal[far], side="right") - 1
        return x

    def find(self, state, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose parts hold ``goal``, with start and size of the parts."""
        two, one, w2, w1, w0, _ = state
        w2, w1 = w2 * self.total, w1 * self.total
        at2, at1 = two.astype(np.intp), one.astype(np.intp)
        equal = two == one
        start2, start1 = w0 * self.below[at2] + (one < two) * w1, w0 * self.below[at1] + (two < one) * w2
        size2, size1 = w0 * self.count[at2] + w2 + equal * w1, w0 * self.count[at1] + w1
        hit2, past2 = goal >= start2, goal >= start2 + size2
        hit1, past1 = goal >= start1, (goal >= start1 + size1) | (equal & past2)
        hit2 &= ~past2
        hit1 &= ~(past1 | equal)
        ids, start, size = (_pick(hit2, x, y) for x, y in ((two, one), (start2, start1), (size2, size1)))
        other = np.flatnonzero(~(hit2 | hit1))
        ahead = (past2 * w2 + past1 * w1)[other]
        own = w0[other]
        x = self._locate((goal[other] - ahead) // own)
        ids[other], start[other], size[other] = x, own * self.below[x] + ahead, own * self.count[x]
        return ids, start, size


def _grid(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_TOKENS))
    return lanes, -(-n // lanes)


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each lane (count) and all words, u32."""
    lanes, steps = _grid(len(ids))
    model = Model(vocabulary)
    x = np.zeros(lanes * steps, model.kind)
    x[: len(ids)] = ids
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    words = np.zeros(lanes * (steps + 3), U)  # a step puts out one word at most
    first = np.arange(lanes) * (steps + 3)
    low, span, at = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U), first.copy()
    before = last = np.zeros(lanes, model.kind)
    for now in x:
        state = model.predict(before, last)
        start, size, whole = model.interval(state, now)
        r = span // U(whole)
        new = low + r * start.astype(U)
        carry = np.flatnonzero(new < low)
        words[at[carry] - 1] += U(1)
        span = r * size.astype(U)
        short = span <= _LOW
        out = np.flatnonzero(short)
        words[at[out]] = new[out] >> _WORD
        at += short
        shift = short * _WORD
        low, span = new << shift, span << shift
        model.learn(state, now)
        before, last = last, now
    # the least multiple of 2**32 that is not below low lies in the span; what follows reads as zeros
    last_word = (low >> _WORD) + ((low & _LOW) > U(0))
    carry = np.flatnonzero(last_word > _LOW)
    words[at[carry] - 1] += U(1)
    words[at] = last_word & _LOW
    at += 1 - first
    words = words.reshape(lanes, steps + 3)[:, : at.max()]
    while True:  # carries run back towards the first word
        over = np.argwhere(words > _LOW)
        if not len(over):
            break
        words[over[:, 0], over[:, 1]] &= _LOW
        words[over[:, 0], over[:, 1] - 1] += U(1)
    return at.astype("<u4"), words[np.arange(words.shape[1]) < at[:, None]].astype("<u4")


def decode_ids(n: int, lanes: int, counts: np.ndarray, words: np.ndarray, vocabulary: int) -> np.ndarray:
    steps = -(-n // lanes)
    end = np.cumsum(counts.astype(np.int64))
    at = end - counts
    words = np.append(words, np.zeros(1, words.dtype)).astype(U)
    none = len(words) - 1

    def following(who) -> np.ndarray:
        own = at[who]
        got = words[np.where(own < end[who], own, none)]
        at[who] = own + 1
        return got

    everyone = np.arange(lanes)
    value = following(everyone) << _WORD
    value |= following(everyone)
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    model = Model(vocabulary)
    out = np.empty((steps, lanes), model.kind)
    before = last = np.zeros(lanes, model.kind)
    for t in range(steps):
        state = model.predict(before, last)
        whole = U(model.total << BITS)
        r = span // whole
        now, start, size = model.find(state, np.minimum(value // r, whole - U(1)).astype(model.kind))
        value -= r * start.astype(U)
        span = r * size.astype(U)
        short = span <= _LOW
        shift = short * _WORD
        value <<= shift
        span <<= shift
        short = np.flatnonzero(short)
        value[short] |= following(short)
        model.learn(state, now)
        before, last = last, now
        out[t] = now
    return out.T.ravel()[:n]


def encode_block(keys: list[int | None], counts: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """``ids``: those of all documents, u32."""
    lanes, _ = _grid(len(ids)) if len(ids) else (0, 0)
    per, words = encode_ids(ids, vocabulary) if lanes else (np.zeros(0, "<u4"), np.zeros(0, "<u4"))
    head = struct.pack("<5I", len(keys), len(ids), lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes()))
    index = np.array([k or 0 for k in keys], "<i8").tobytes() + bytes(k is None for k in keys) + np.array(counts, "<u4").tobytes()
    return MAGIC + head + index + per.tobytes() + words.tobytes()


def decode_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, token counts and ids (u32) of a block; raises ValueError if it is damaged."""
    if raw[:4] != MAGIC:
        raise ValueError("not a block")
    docs, n, lanes, vocabulary, crc = struct.unpack_from("<5I", raw, 4)
    at = 24
    keys = np.frombuffer(raw, "<i8", docs, at).tolist()
    null = raw[at + 8 * docs : at + 9 * docs]
    counts = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    per = np.frombuffer(raw, "<u4", lanes, at)
    words = np.frombuffer(raw, "<u4", offset=at + 4 * lanes)
    ids = (decode_ids(n, lanes, per, words, vocabulary) if n else np.zeros(0)).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc or int(counts.sum()) != n:
        raise ValueError("checksum of a block differs")
    return [None if z else k for k, z in zip(keys, null, strict=True)], counts, ids


def write_ids(documents: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes every whole text, appends ``end`` and writes blocks in ascending order of ``key`` (null first, then by a hash of the text).

    Range partitions are the shards; rows are shard, block, first (ids of the shard before the block),
    n_docs, n_tokens, data. A null text is empty. A document longer than a block has one of its own.
    Repeated rows are written each; an empty table gives an empty file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = _tokens.encoder(tokenizer)
        vocabulary = coder.tokenizer.get_vocab_size()
        keys: list = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        size = first = block = 0

        def flush():
            data = encode_block(keys, counts, np.concatenate(parts), vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((shard, pa.int32()), (block, pa.int32()), (first, pa.int64()), (len(keys), pa.int64()), (size, pa.int64()), (data, pa.binary()))], names=["shard", "block", "first", "n_docs", "n_tokens", "data"])

        for batch in batches:
            flat, offs = coder.encode_with_end(batch.column(1), end)
            i, rows = 0, len(batch)
            while i < rows:  # documents i .. j - 1 still fit
                j = int(np.searchsorted(offs, offs[i] + block_tokens - size, side="right")) - 1
                if j <= i and keys:
                    yield flush()
                    block, first = block + 1, first + size
                    keys, counts, parts, size = [], [], [], 0
                    continue
                j = min(max(j, i + 1), rows)
                keys += batch.column(0).slice(i, j - i).to_pylist()
                counts += np.diff(offs[i : j + 1]).tolist()
                parts.append(flat[offs[i] : offs[j]])
                size += int(offs[j] - offs[i])
                i = j
        if keys:
            yield flush()

    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    with batches_of(documents.sparkSession, 1000):
        _written(rows, run, path)


def _written(rows: DataFrame, run, path: str) -> None:
    in_order(rows, "k", "t").mapInArrow(run, "shard int, block int, first long, n_docs long, n_tokens long, data binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``key``, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids (binary, u32) per document."""
    blocks = spark.read.parquet(path)
    total, base = 0, []
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # one row per shard
        base.append((r["shard"], total))
        total += r["n"]
    shift = spark.createDataFrame(base, "shard int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, counts, ids = decode_block(batch.column(1)[i].as_buffer().to_pybytes())
                end = np.cumsum(counts.astype(np.int64))
                start = end - counts
                raw = memoryview(ids.tobytes())
                each = [raw[4 * s : 4 * e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(start + batch.column(0)[i].as_py()), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(e) for e in each], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(e) for e in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    rows = blocks.join(F.broadcast(shift), "shard").select((F.col("base") + F.col("first")).alias("at"), "data")
    return rows.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    write_ids(tables(spark, sf_dir, "documents"), path, _tokens.default_path())
    return read_ids(spark, path, with_ids=False)
