"""Groups of texts that are linked by a Jaccard similarity of their shingle sets, exactly.

SimHash comes first: sets of equal fingerprints, and fingerprints within the radius (bit-sliced comparison, see
``simhash``), are candidates at once. It can't find all pairs, because sets of similarity 0.8 differ in about ten of 64
bits. So prefixes complete it: two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of
each in any common order, so these prefixes are join keys that lose no pair. The order puts shingles that a sample
finds common last; the sample changes the cost and never the result. Equal sets are one class. SimHash candidates and
neighbours within a key are verified first. Then rows of keys with more than one group carry the parities of their
sets, and pairs are made of what these can't tell apart only: in rounds each row's likeliest partner in another
group, at last all that are left and not linked yet. Sets are of 64-bit shingle hashes and made from the texts where they are needed, as they are larger than those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from . import _tokens
from ._common import BROADCAST_ROWS, DataFrame, F, batches_of, drop, is_small, stored
from .simhash import P2, SLICE_BYTES, components, link_edges, majority, shingles_of

#: Least similarity as a fraction, words of a shingle.
LEAST, SHINGLE = (4, 5), 5
#: Texts whose shingles are counted for the order, and the most common shingles that are put last.
SAMPLE, COMMON = 5_000, 50_000
CHUNK, BATCH = 1 << 16, 256
#: Prefix keys of a text that give its first neighbours, rounds of likeliest partners, and classes of the bound.
NEAR_KEYS, ROUNDS, CLASSES = 8, 2, 4096
#: Rows of a key beyond which it is dealt over blocks, and rows of parities that are broadcast.
SLOT, PARITY_ROWS = 4096, 30_000


def _sets_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows i .. j - 1: the sorted hashes of each row's set, how many each has, and the rows' fingerprints."""
    data, offs = K.text_buffers(column)
    for i, j in K.slices(offs, SLICE_BYTES):
        h, grams = shingles_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
        fp = majority(h, grams)
        row = np.repeat(np.arange(j - i), grams)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield i, j, h[new], np.bincount(row[new], minlength=j - i), fp


def _digests(docs: DataFrame, shingle: int) -> DataFrame:
    """doc, n (different shingles), a, b (digest of the set), fp (SimHash). docs: doc, text."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, n, fp in _sets_of(batch.column(1), shingle):
                ends = np.concatenate(([0], np.cumsum(n)))
                mixed = (h ^ (h >> K.U(29))) * P2
                sums = [np.concatenate((np.zeros(1, K.U), np.cumsum(v, dtype=K.U))) for v in (h, mixed ^ (mixed >> K.U(32)))]
                digest = [pa.array((v[ends[1:]] - v[ends[:-1]]).view(np.int64)) for v in sums]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int32)), *digest, pa.array(fp.view(np.int64))], names=["doc", "n", "a", "b", "fp"])

    return docs.mapInArrow(run, "doc long, n int, a long, b long, fp long")


def _as_sets(docs: DataFrame, shingle: int, parities: bool) -> DataFrame:
    """doc, n, s: the sorted hashes, or the parities of the numbers of them in ``CLASSES`` classes, a bit each."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, n, _ in _sets_of(batch.column(1), shingle):
                ends = np.concatenate(([0], np.cumsum(n)))
                if parities:
                    row = np.repeat(np.arange(len(n)), n)
                    odd = np.bincount(row * CLASSES + (h >> K.U(52)).astype(np.int64), minlength=len(n) * CLASSES) & 1
                    raw, ends = np.packbits(odd.astype(np.uint8)).tobytes(), np.arange(len(n) + 1) * (CLASSES // 8)
                else:
                    raw, ends = h.tobytes(), 8 * ends
                parts = [raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int32)), pa.array(parts, pa.binary())], names=["doc", "n", "s"])

    return docs.mapInArrow(run, "doc long, n int, s binary")


def _common(docs: DataFrame, total: int, shingle: int) -> np.ndarray:
    """Common shingles of a sample, the commonest last."""
    part = docs.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, total // SAMPLE))) == 0)

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, _, _ in _sets_of(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    counts = part.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 2")
    top = counts.orderBy(F.desc("c"), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(K.U)


def _prefixes(docs: DataFrame, common: np.ndarray, least: tuple[int, int], shingle: int) -> DataFrame:
    """h, n, doc, pos: the shingles of every set's prefix."""
    num, den = least
    known = np.argsort(common)
    values = common[known]

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, n, _ in _sets_of(batch.column(1), shingle):
                doc = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(h), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    rank = np.where(values[at] == h, known[at] + 1, 0)
                h = h[np.lexsort((h, rank, row))]
                pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = np.flatnonzero(pos < np.repeat(n - (num * n + den - 1) // den + 1, n))
                cols = [h[keep].view(np.int64), n[row[keep]].astype(np.int32), doc[row[keep]], pos[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "n", "doc", "pos"])

    return docs.mapInArrow(run, "h long, n int, doc long, pos int")


def _by_key(rows: DataFrame, solve, schema: str, by: tuple[str, ...] = ("h",)) -> DataFrame:
    """``solve`` of a matrix that holds all rows of its keys (first columns), in the order of the columns.

    A binary column, the last one, gives the matrix one column per 64 bits.
    """

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        raw = [c for c in batch.columns if pa.types.is_binary(c.type)]
        out = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[: batch.num_columns - len(raw)]], axis=1)
        parts = [np.frombuffer(b"".join(c.to_pylist()), np.int64).reshape(len(batch), -1) for c in raw]
        return np.concatenate([out, *parts], axis=1) if parts else out

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(matrix(batch))
            size += len(batch)
            if size >= CHUNK * 8 // max(8, held[-1].shape[1]):  # fewer rows with parities, so a worker keeps little memory
                m = np.concatenate(held)
                cut = np.flatnonzero((m[1:, : len(by)] != m[:-1, : len(by)]).any(axis=1))
                end = int(cut[-1]) + 1 if len(cut) else 0
                if end:
                    yield from solve(m[:end])
                held, size = [m[end:]], len(m) - end
        if size:
            yield from solve(np.concatenate(held))

    return rows.repartition(*by).sortWithinPartitions(*by, "n", "doc").mapInArrow(run, schema)


def _batch(m: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m[:, i])) for i in range(m.shape[1])], names=names)


def _shared(m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of keys that more than one set has."""
    same = m[1:, 0] == m[:-1, 0]
    m = m[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    if len(m):
        yield _batch(m, ["h", "n", "doc", "pos"])


def _neighbours(least: tuple[int, int]):
    """Pairs of rows in a row within a key (h, n, doc, pos) that can be similar by their sizes and what follows the common shingle."""
    num, den = least

    def solve(m: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = m[:-1], m[1:]
        rest = np.minimum(x[:, 1] - x[:, 3], y[:, 1] - y[:, 3])
        ok = (x[:, 0] == y[:, 0]) & ((num + den) * rest >= num * (x[:, 1] + y[:, 1]))
        x, y = x[ok, 2], y[ok, 2]
        if len(x):
            yield _batch(np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0), ["u", "v"])

    return solve


#: Columns of the matrix of a block, before its parities.
BLOCK = ("h", "x", "y", "n", "doc", "pos", "label")


def _fitting(m: np.ndarray, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and j of a block that can be similar like neighbours, with other labels. No row is twice in one i, nor in one j."""
    num, den = least
    n, rest, label = m[:, 3], m[:, 3] - m[:, 5], m[:, 6]
    block = np.cumsum(np.concatenate(([0], (m[1:, :3] != m[:-1, :3]).any(axis=1))))
    start = np.arange(len(m) - 1)
    for d in range(1, len(m)):
        start = start[start < len(m) - d]
        # sorted by size: a row with no fitting partner at this distance has none further on
        start = start[(block[start] == block[start + d]) & (den * n[start] >= num * n[start + d])]
        if not len(start):
            break
        i, j = start, start + d
        ok = (label[i] != label[j]) & ((num + den) * np.minimum(rest[i], rest[j]) >= num * (n[i] + n[j]))
        if ok.any():
            yield i[ok], j[ok]


def _open(least: tuple[int, int]):
    """The rows of blocks that have a partner."""

    def solve(m: np.ndarray) -> Iterator[pa.RecordBatch]:
        has = np.zeros(len(m), bool)
        for i, j in _fitting(m, least):
            has[i] = has[j] = True
        if has.any():
            yield _batch(m[has, :6], list(BLOCK[:6]))

    return solve


def _likely(least: tuple[int, int], every: bool):
    """Pairs of a block that can be similar by their parities: of each row that with the likeliest partner, or every one."""
    num, den = least

    def solve(m: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, doc, odd = m[:, 3], m[:, 4], np.ascontiguousarray(m[:, len(BLOCK) :]).view(K.U)
        best, partner = np.zeros(len(m)), np.full(len(m), -1)
        out: list[np.ndarray] = []
        for i, j in _fitting(m, least):
            size = n[i] + n[j]
            apart = np.zeros(len(i), np.int64)
            for words in (slice(0, 8), slice(8, None)):  # most pairs are told apart by few classes
                # each class of odd difference holds a shingle that only one set has
                apart += np.bitwise_count(odd[i, words] ^ odd[j, words]).sum(axis=1, dtype=np.int64)
                common = (size - apart) // 2
                ok = den * common >= num * (size - common)
                i, j, size, apart, common = i[ok], j[ok], size[ok], apart[ok], common[ok]
            if every:
                out.append(np.stack((doc[i], doc[j]), axis=1))
                continue
            share = common / (size - common)
            for one, other in ((i, j), (j, i)):
                better = share > best[one]
                best[one[better]], partner[one[better]] = share[better], other[better]
        if not every:
            one = np.flatnonzero(partner >= 0)
            out.append(np.stack((doc[one], doc[partner[one]]), axis=1))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
        if len(pairs):
            yield _batch(pairs, ["u", "v"])

    return solve


def _blocks(shared: DataFrame, label: DataFrame) -> DataFrame:
    """h, x, y, n, doc, pos, label: the rows of keys that have more than one label.

    A key of more than ``SLOT`` rows is dealt over slots, and every two slots x <= y are a block: all pairs meet in one.
    """
    labelled = _labelled(shared, label)
    keys = labelled.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c")).where("a <> b")
    keys, _ = stored(keys.select("h", F.ceil(F.col("c") / SLOT).cast("int").alias("s")), "mixed-keys")
    rows = labelled.join(F.broadcast(keys) if is_small(keys) else keys, "h")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("doc"), F.col("s")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return rows.select("h", F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"), "n", "doc", "pos", "label")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the label of their documents, which is the document itself if nothing is linked with it."""
    side = F.broadcast(label) if is_small(label, BROADCAST_ROWS) else label
    return rows.join(side.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("label", F.coalesce("root", "doc")).drop("root")


def _compared(pairs: DataFrame, docs: DataFrame, least: tuple[int, int], shingle: int, parities: bool) -> DataFrame:
    """Those of the stored ``pairs`` (u, v) that can be similar by the parities of their sets, or are by the sets."""
    num, den = least
    spark = pairs.sparkSession
    wanted, wanted_path = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct(), "wanted")
    texts = docs.join(F.broadcast(wanted) if is_small(wanted) else wanted, "doc", "left_semi")
    with batches_of(spark, BATCH):
        own, own_path = stored(_as_sets(texts, shingle, parities), "wanted-sets")
    one, other = (own.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in ("u", "v"))
    both = pairs.join(one, "u").join(other, "v")

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(3).to_numpy(zero_copy_only=False)
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            if parities:  # each class of odd difference holds a shingle that only one set has
                a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (x, y))
                common = (size - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)) // 2
            else:
                common = np.array([len(np.intersect1d(np.frombuffer(a, K.U), np.frombuffer(b, K.U), assume_unique=True)) for a, b in zip(x, y, strict=True)], np.int64)
            keep = pa.array(den * common >= num * (size - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    with batches_of(spark, BATCH):
        found, _ = stored(both.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long"), "similar")
    drop(spark, wanted_path, own_path)
    return found


def _verified(pairs: DataFrame, docs: DataFrame, least: tuple[int, int], shingle: int) -> DataFrame:
    """Those of the stored ``pairs`` (u, v) whose sets are similar."""
    return _compared(_compared(pairs, docs, least, shingle, True), docs, least, shingle, False)


def similar_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """``key``, component (least key reachable over pairs of similarity ``least`` or more). Keys are unique and not null.

    Words are as in ``simhash``; a text of fewer words than ``shingle`` is one shingle, null and texts without
    words are alike.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    with batches_of(spark, BATCH):
        facts, facts_path = stored(_digests(docs, shingle), "digests")
    classes, classes_path = stored(facts.groupBy("n", "a", "b").agg(F.min("doc").alias("least"), F.min_by("fp", "doc").alias("fp")), "classes")
    firsts = classes.where("n > 0").select(F.col("least").alias("doc"), "fp")
    # candidates by SimHash: equal fingerprints to their first document, and first documents of linked fingerprints
    heads, heads_path = stored(firsts.groupBy("fp").agg(F.min("doc").alias("head")), "heads")
    star = firsts.join(heads, "fp").where("doc <> head").select(F.col("head").alias("u"), F.col("doc").alias("v"))
    linked = link_edges(heads.select("fp"))
    linked = linked.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("x")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("y")), "v")
    by_bits = star.unionByName(linked.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))
    only = firsts.select("doc")
    own = docs.join(F.broadcast(only) if is_small(only) else only, "doc", "left_semi")
    with batches_of(spark, BATCH):
        common = _common(docs, facts.count(), shingle)
        shared, shared_path = stored(_by_key(_prefixes(own, common, least, shingle), _shared, "h long, n long, doc long, pos long"), "shared")
    first = _by_key(shared.where(F.col("pos") < NEAR_KEYS), _neighbours(least), "u long, v long")
    tried, near_path = stored(first.unionByName(by_bits).distinct(), "neighbours")
    paths = [near_path]
    links = _verified(tried, docs, least, shingle)
    label, label_path = stored(components(links), "labels")
    schema = "h long, x long, y long, n long, doc long, pos long"
    left, left_path = stored(_by_key(_blocks(shared, label), _open(least), schema, BLOCK[:3]), "open")
    wanted, wanted_path = stored(left.select("doc").distinct(), "wanted")
    texts = docs.join(F.broadcast(wanted) if is_small(wanted) else wanted, "doc", "left_semi")
    with batches_of(spark, BATCH):
        odd, odd_path = stored(_as_sets(texts, shingle, True), "parities")
    side = F.broadcast(odd.select("doc", "s")) if is_small(odd, PARITY_ROWS) else odd.select("doc", "s")
    for step in range(ROUNDS + 1):  # the last one takes all pairs that are left
        rows = _labelled(left, label).join(side, "doc").select(*BLOCK, "s")
        new = _by_key(rows, _likely(least, step == ROUNDS), "u long, v long", BLOCK[:3]).distinct().join(tried, ["u", "v"], "left_anti")
        more, path = stored(new, "others")
        paths.append(path)
        if more.isEmpty():
            continue
        tried = tried.unionByName(more)
        links = links.unionByName(_compared(more, docs, least, shingle, False))
        if step < ROUNDS:
            drop(spark, label_path)
            label, label_path = stored(components(links), "labels")
    drop(spark, shared_path, heads_path, label_path, left_path, wanted_path, odd_path, *paths)
    comp, _ = stored(components(links), "components")
    named, named_path = stored(classes.join(comp, classes.least == comp.node, "left").select("n", "a", "b", F.coalesce("root", "least").alias("component")), "classes")
    out = facts.select("doc", "n", "a", "b").join(F.broadcast(named) if is_small(named, BROADCAST_ROWS // 2) else named, ["n", "a", "b"])
    out, _ = stored(out.select(F.col("doc").alias(key), "component"), "groups")
    drop(spark, facts_path, classes_path, named_path)
    return out
