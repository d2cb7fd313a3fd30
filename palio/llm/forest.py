"""MinHash near-duplicates with an LSH forest.

Documents with equal sets of shingles are one class, and the first of each class enters the forest. A tree orders the
sets by a signature of ``LEVELS`` minima of their own hash functions, 16 bits each. A region is the stretch of an order
that shares its first minima: two at first, and one more wherever a region holds more than ``REGION`` sets, so depth follows
the density of the place. Inside a region all sets are compared by one bit of every minimum of all trees and by size.
Those with a partner go on, first with the partner of longest common prefix. Such pairs are confirmed on the full sets,
and their components label the sets. In regions that then hold several labels, sets are compared by the parities of
their shingle counts in classes, a bound that no pair of the wanted similarity fails, and the closest pairs of every two
labels are confirmed, until no two labels have a pair left that is not.

Two sets of similarity s share d minima in one of ``TREES`` trees but for a chance of (1 - s^d)^TREES, at 0.8 and depth 2
that is 2e-11, at depth 4 3e-6, at depth 6 7e-4; the test by bits leaves out a pair of similarity 0.8 with a chance under 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from ._common import BROADCAST_ROWS, DataFrame, F, SparkSession, batches_of, drop, is_small, keyed, stored, tables, unique_keys
from .similar import _compared
from .simhash import SLICE_BYTES, components, shingles_of

#: Orders, minima of a signature, sets of a region beyond which it is split, minima that a region shares at least.
TREES, LEVELS, REGION, LEAST_DEPTH = 24, 8, 512, 2
#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, SIMILARITY = 2, (4, 5)
#: Bits of 192 that sets of similarity 0.8 may differ in: 0.1 on average, five deviations more.
BITS = TREES * LEVELS
FAR = int(BITS * 0.1 + 5 * (BITS * 0.1 * 0.9) ** 0.5)
#: Closest pairs of two labels in a region that are confirmed first, and what that number grows by.
CLOSEST, GROWTH = 8, 64
#: Links (16 bytes each) up to which one task finds their components; beyond, they are contracted by joins.
TASK_LINKS = 500_000
#: Trees whose neighbours are confirmed before labels are compared.
FIRST_TREES = 3
BATCH, CHUNK = 256, 1 << 14
_SEEDS = K.constants(BITS, 29) | K.U(1)


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows i .. j - 1: the sorted hashes of each row's set, one row after another, and how many each has."""
    data, offs = K.text_buffers(column)
    for i, j in K.slices(offs, SLICE_BYTES):
        h, grams = shingles_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
        row = np.repeat(np.arange(j - i), grams)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield i, j, h[new], np.bincount(row[new], minlength=j - i)


def _digests(docs: DataFrame, shingle: int) -> DataFrame:
    """doc, n (different shingles), a, b (digest of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, n in _sets(batch.column(1), shingle):
                ends = np.concatenate(([0], np.cumsum(n)))
                sums = [np.concatenate((np.zeros(1, K.U), np.cumsum(v, dtype=K.U))) for v in (K.mix(h), K.mix(h ^ _SEEDS[0]))]
                digest = [pa.array((v[ends[1:]] - v[ends[:-1]]).view(np.int64)) for v in sums]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *digest], names=["doc", "n", "a", "b"])

    return docs.mapInArrow(run, "doc long, n long, a long, b long")


def _minima(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sets of ``n`` hashes one after another, the high 16 bits that stand with the least of each function's values."""
    head = np.cumsum(n) - n
    out = np.empty((len(n), BITS), np.uint16)
    for i, seed in enumerate(_SEEDS):
        # the least decides; what is kept of it has no part in that
        out[:, i] = (K.mix(np.minimum.reduceat(h * seed, head)) >> K.U(48)).astype(np.uint16)
    return out


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """tree, hi, lo, doc, n, b0, b1, b2: a set's signature in each tree as two words, its size, a bit of every minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, n in _sets(batch.column(1), shingle):
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                m = _minima(h, n[some])
                doc = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)[some]
                bits = np.packbits((m & 1).astype(np.uint8), axis=1).view(np.int64)
                words = m.astype(">u2").reshape(len(some) * TREES, LEVELS).view(">i8").astype(np.int64)
                cols = [np.tile(np.arange(TREES, dtype=np.int32), len(some)), words[:, 0], words[:, 1]]
                cols += [np.repeat(v, TREES) for v in (doc, n[some].astype(np.int32), bits[:, 0], bits[:, 1], bits[:, 2])]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["tree", "hi", "lo", "doc", "n", "b0", "b1", "b2"])

    return docs.mapInArrow(run, "tree int, hi long, lo long, doc long, n int, b0 long, b1 long, b2 long")


def _prefix(depth: int):
    """The first ``depth`` minima of a tree's signature as one key."""
    cut = lambda c, k: F.shiftright(F.col(c), 64 - 16 * k) if k else F.lit(0).cast("long")
    return F.xxhash64("tree", F.lit(depth), cut("hi", min(depth, 4)), cut("lo", max(0, depth - 4)))


def _dense(rows: DataFrame, prefixes: list) -> DataFrame:
    """depth, key, c of the prefixes that more than ``REGION`` sets share."""
    keys = rows.select(F.explode(F.array(*prefixes)).alias("p")).select("p.depth", "p.key")
    return keys.groupBy("depth", "key").agg(F.count("*").alias("c")).where(F.col("c") > REGION)


def _in_regions(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with their region, and what was stored. A region that is too dense is left for one of a minimum more.

    Sets of one full signature have no deeper region; if they are too many, ``k`` says in how many parts they are read.
    """
    # prefixes of more than REGION sets: the shortest first, all longer ones of what they hold at once
    counted = [F.struct(F.lit(d).alias("depth"), _prefix(d).alias("key")) for d in range(LEAST_DEPTH, LEVELS + 1)]
    first, first_path = stored(_dense(rows, counted[:1]), "dense")
    inside = rows.withColumn("key", _prefix(LEAST_DEPTH)).join(_side(first.select("key")), "key", "left_semi").drop("key")
    deeper, deeper_path = stored(_dense(inside, counted[1:]), "dense")
    many = first.unionByName(deeper)
    depths = sorted(r["depth"] for r in many.select("depth").distinct().collect())
    near = is_small(first) and is_small(deeper)
    rows, depth_of, deep = rows.withColumn("k", F.lit(1)), F.lit(LEAST_DEPTH), []
    for depth in depths:  # whatever is dense in a prefix is so in all shorter ones
        own = many.where(F.col("depth") == depth).select("key", "c")
        found = rows.withColumn("key", _prefix(depth)).join(F.broadcast(own) if near else own, "key", "left")
        if depth == LEVELS:
            rows = found.withColumn("k", F.coalesce(F.ceil(F.col("c") / REGION).cast("int"), F.lit(1))).drop("key", "c")
        else:
            rows = found.withColumn(f"deep{depth}", F.col("c").isNotNull()).drop("key", "c")
            depth_of = F.when(F.col(f"deep{depth}"), F.lit(depth + 1)).otherwise(depth_of)
            deep.append(f"deep{depth}")
    region = _prefix(LEAST_DEPTH)
    for depth in range(LEAST_DEPTH + 1, LEVELS + 1):
        region = F.when(F.col("_depth") == depth, _prefix(depth)).otherwise(region)
    return rows.withColumn("_depth", depth_of).withColumn("region", region).drop("_depth", *deep), [first_path, deeper_path]


def _groups(batches: Iterator[pa.RecordBatch], keys: int, chunk: int = CHUNK) -> Iterator[pa.Table]:
    """Tables that hold all rows of their groups (the first ``keys`` columns), which come one after another; a table is about a chunk."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= chunk:
            t = pa.Table.from_batches(held)
            m = [t.column(c).to_numpy() for c in range(keys)]
            cut = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in m]))
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield t.slice(0, end)
            held, size = t.slice(end).combine_chunks().to_batches(), len(t) - end
    if size:
        yield pa.Table.from_batches(held)


def _alike(bits: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows x and y can be near copies by their bits and sizes."""
    num, den = SIMILARITY
    far = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
    return (far <= FAR) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))


def _partners(rows: DataFrame) -> DataFrame:
    """tree, region, doc, partner of the sets that have an alike one in their region: the nearest in its order. rows: as in ``_in_regions``.

    The parts of a region that is read in several have partners of their own; all its sets go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            key, part, k, tree, doc, n = (t.column(c).to_numpy() for c in ("region", "part", "k", "tree", "doc", "n"))
            bits = np.stack([t.column(c).to_numpy() for c in ("b0", "b1", "b2")], axis=1).view(K.U)
            partner = np.full(len(key), -1, np.int64)
            start, d = np.arange(len(key)), 0
            while len(start):
                d += 1
                start = start[start < len(key) - d]
                start = start[(key[start] == key[start + d]) & (part[start] == part[start + d])]
                ok = start[_alike(bits, n, start, start + d)]
                for own, other in ((ok, ok + d), (ok + d, ok)):
                    free = partner[own] < 0
                    partner[own[free]] = other[free]
            keep = np.flatnonzero((partner >= 0) | (k > 1))
            who = np.where(partner[keep] >= 0, doc[np.maximum(partner[keep], 0)], doc[keep])
            yield pa.RecordBatch.from_arrays([pa.array(tree[keep]), pa.array(key[keep]), pa.array(doc[keep]), pa.array(who)], names=["tree", "region", "doc", "partner"])

    cols = ["region", "part", "k", "tree", "hi", "lo", "doc", "n", "b0", "b1", "b2"]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "tree"), F.col("k")).cast("int")).select(*cols)
    return rows.repartition("region", "part").sortWithinPartitions("region", "part", "hi", "lo", "doc").mapInArrow(run, "tree int, region long, doc long, partner long")


def _parities(docs: DataFrame, shingle: int) -> DataFrame:
    """doc, n, s: a bit for whether the set has an odd number of hashes in each of 8 n to 16 n classes, 512 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, n in _sets(batch.column(1), shingle):
                ends, out = np.concatenate(([0], np.cumsum(n))), []
                for k in range(j - i):
                    classes = 512
                    while classes < 8 * n[k]:
                        classes *= 2
                    odd = np.bincount((h[ends[k] : ends[k + 1]] & K.U(classes - 1)).astype(np.int64), minlength=classes) & 1
                    out.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int32)), pa.array(out, pa.binary())], names=["doc", "n", "s"])

    return docs.mapInArrow(run, "doc long, n int, s binary")


def _folded(raw: bytes, size: int) -> np.ndarray:
    """Parities in fewer classes: the halves of a set of classes are added."""
    v = np.frombuffer(raw, K.U)
    while len(v) > size:
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return v


def _passing(label: np.ndarray, part: np.ndarray, n: np.ndarray, s: list[bytes], split: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For rows by size: a row, later ones of other labels (and parts, if ``split``) that can be similar by their parities, how similar."""
    num, den = SIMILARITY
    size = np.array([len(v) // 8 for v in s])
    for words in np.unique(size):  # like sizes are compared in the classes of the smaller
        a, b = np.searchsorted(size, [words, words + 1])
        end = int(np.searchsorted(n, den * n[b - 1] // num, side="right"))
        m = np.stack([_folded(v, words) for v in s[a:end]])
        for i in range(a, b):
            j = np.arange(i + 1, int(np.searchsorted(n, den * n[i] // num, side="right")))
            j = j[label[j] != label[i]]
            if split:
                j = j[part[j] != part[i]]
            if len(j):
                both = n[i] + n[j]
                common = (both - np.bitwise_count(m[i - a] ^ m[j - a]).sum(axis=1, dtype=np.int64)) // 2
                ok = den * common >= num * (both - common)
                yield i, j[ok], common[ok] / (both[ok] - common[ok])


def _close_pairs(rows: DataFrame, closest: int) -> DataFrame:
    """u, v, more: of every two labels of a slot of a region the ``closest`` pairs that can be similar; whether there are more.

    rows: as in ``_slots``. In a slot of two parts (x < y) only pairs of both count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3, CHUNK // 8):
            key, x, y, part, doc, label, n = (t.column(c).to_numpy() for c in ("region", "x", "y", "slot", "doc", "label", "n"))
            s = t.column("s").to_pylist()
            new = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            edge = np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)])).tolist()
            out: list[tuple[int, int, bool]] = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if label[a:b].min() == label[a:b].max():
                    continue
                found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
                for i, js, alike in _passing(label[a:b], part[a:b], n[a:b].astype(np.int64), s[a:b], x[a] != y[a]):
                    for j, v in zip(js.tolist(), alike.tolist(), strict=True):
                        two = (int(label[a + i]), int(label[a + j]))
                        found.setdefault((min(two), max(two)), []).append((-v, int(doc[a + i]), int(doc[a + j])))
                for ps in found.values():
                    ps.sort()
                    out += [(min(i, j), max(i, j), len(ps) > closest) for _, i, j in ps[:closest]]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["u", "v", "more"])

    cols = ["region", "x", "y", "slot", "doc", "label", "n", "s"]
    return rows.select(*cols).repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "n").mapInArrow(run, "u long, v long, more boolean")


def _slots(rows: DataFrame) -> DataFrame:
    """``rows`` with slot, x, y: a region is in ``k`` slots, and its rows come once for each two of them."""
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumn("x", F.least("slot", "other")).withColumn("y", F.greatest("slot", "other")).drop("other", "k")


def _side(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it was counted and is small."""
    return F.broadcast(table) if is_small(table, BROADCAST_ROWS // 2) else table


def _labelled(rows: DataFrame, label: DataFrame | None, names: dict[str, str]) -> DataFrame:
    """``rows`` with the labels (least document linked) of some columns, by their new names."""
    for column, name in names.items():
        if label is None:
            rows = rows.withColumn(name, F.col(column))
        else:
            own = _side(label).select(F.col("node").alias(column), F.col("root").alias("_root"))
            rows = rows.join(own, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")
    return rows


def _roots(links: DataFrame) -> DataFrame:
    """node, root: the least node that links (u, v, stored) reach from each of their nodes."""
    if not is_small(links, TASK_LINKS):
        return components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches]
        nodes, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), return_inverse=True)
        root, (u, v) = np.arange(len(nodes)), ends.reshape(2, -1)
        while (root[u] != root[v]).any():
            x, y = root[u], root[v]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: the components of the labels that these join. links: u, v, stored."""
    if label is None:
        return _roots(links)
    joined, _ = stored(_labelled(links, label, {"u": "lu", "v": "lv"}).select(F.col("lu").alias("u"), F.col("lv").alias("v")), "joined")
    new, _ = stored(_roots(joined), "merged")
    old = label.join(_side(new).select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(new.join(_side(label), "node", "left_anti"))


def _labels(alike: DataFrame, docs: DataFrame, shingle: int) -> tuple[DataFrame, str]:
    """node, root: labels of documents by the similar pairs of all regions, and where they are stored. alike: as ``_partners``, stored."""
    spark = docs.sparkSession
    near = alike.where((F.col("tree") < FIRST_TREES) & (F.col("doc") != F.col("partner")))
    near, near_path = stored(near.select(F.least("doc", "partner").alias("u"), F.greatest("doc", "partner").alias("v")).distinct(), "neighbours")
    label, label_path = stored(_merged(None, _compared(near, docs, SIMILARITY, shingle, False)), "labels")
    wanted, wanted_path = stored(alike.select("doc").distinct(), "wanted")
    with batches_of(spark, BATCH):
        own, own_path = stored(_parities(docs.join(_side(wanted), "doc", "left_semi"), shingle), "parities")
    paths, closest, left = [near_path, wanted_path, own_path], CLOSEST, None
    while True:
        rows = _labelled(alike.select("region", "doc"), label, {"doc": "label"})
        if left is not None:  # only labels with pairs that haven't been compared
            rows = rows.join(_side(left), "label", "left_semi")
        rows, rows_path = stored(rows, "labelled")
        mixed = rows.groupBy("region").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c")).where("a <> b")
        mixed, mixed_path = stored(mixed.select("region", F.ceil(F.col("c") / REGION).cast("int").alias("k")), "mixed")
        slots = _slots(rows.join(_side(mixed), "region"))
        with batches_of(spark, BATCH):
            pairs, pairs_path = stored(_close_pairs(slots.join(own, "doc"), closest).groupBy("u", "v").agg(F.max("more").alias("more")), "close")
        paths += [rows_path, mixed_path, pairs_path]
        good = _compared(pairs.select("u", "v"), docs, SIMILARITY, shingle, False) if pairs.head(1) else None
        if good is not None and good.head(1):
            old = label_path
            label, label_path = stored(_merged(label, good), "labels")
            drop(spark, old)
        still = _labelled(pairs.where("more"), label, {"u": "lu", "v": "lv"}).where("lu <> lv")
        left, left_path = stored(still.select(F.explode(F.array("lu", "lv")).alias("label")).distinct(), "left")
        paths.append(left_path)
        if not left.head(1):
            break
        closest *= GROWTH
    drop(spark, *paths)
    return label, label_path


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key``, n (different shingles), component: the least key reachable over pairs of similarity 0.8 or more.

    Words are lower-cased (A-Z) and split at ASCII white space; a text of fewer words than ``shingle`` is one shingle, and
    a null or empty text has none and stays alone. Keys are longs. One row per input row: rows that share a key are
    documents of their own with that key, a row without a key gets the least key of the others of its component, or null.
    Texts are read whole. Other columns, whatever their names, are left out; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    unique = unique_keys(documents.select(key), key)
    own_keys = documents.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = own_keys if unique else keyed(documents, key, text)
    docs = rows.select(F.col("_id").alias("doc"), F.col("_text").alias("text"))
    with batches_of(spark, BATCH):
        facts, facts_path = stored(_digests(docs, shingle), "digests")
    classes, classes_path = stored(facts.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc").alias("least")), "classes")
    firsts = _side(classes.select(F.col("least").alias("doc")))
    own = docs.join(firsts, "doc", "left_semi")
    with batches_of(spark, BATCH):
        trees, trees_path = stored(_signatures(own, shingle), "trees")
    placed, paths = _in_regions(trees)
    alike, alike_path = stored(_partners(placed), "alike")
    drop(spark, trees_path, *paths)
    comp, comp_path = _labels(alike, own, shingle)
    drop(spark, alike_path)
    named, named_path = stored(classes.join(_side(comp), classes.least == comp.node, "left").select("n", "a", "b", F.coalesce("root", "least").alias("root")), "classes")
    out = facts.join(_side(named), ["n", "a", "b"], "left").select("doc", "n", F.coalesce("root", "doc").alias("root"))
    out, _ = stored(out, "groups")
    drop(spark, facts_path, classes_path, comp_path, named_path)
    if unique:
        return out.select(F.col("doc").alias(key), "n", F.col("root").alias("component"))
    both = out.join(rows.select(F.col("_id").alias("doc"), "_key"), "doc")  # numbers of rows follow the keys
    least = both.groupBy("root").agg(F.min("_key").alias("component"))
    return both.join(least, "root").select(F.col("_key").alias(key), "n", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_copies(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
