"""Quality classifier from weak labels.

Several labellers vote on each document (bad, fine or no vote): heuristics over its statistics, a word
list, and human labels where there are some. Expectation-maximisation over the counts of vote patterns
estimates each labeller's accuracy on both classes without knowing the truth, and so the posterior of
every pattern. The posteriors of a bounded sample train a linear scorer on hashed words and statistics,
which then scores every document whole. The two targets, toxic and of low quality, have a model each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _flat as K
from . import _tokens
from ._common import DataFrame, F, SparkSession, T, is_small, stored, tables

#: Documents that train the scorer at most, and bits of a hashed feature.
SAMPLE, BITS = 20_000, 18
TARGETS = ("toxic", "low")
SLICE_BYTES = 1 << 19
#: English insults. Two labellers look for one half each, so that no labeller's votes follow from another's.
INSULTS = ("clown idiot moron stupid worthless".split(), "disgusting loser pathetic trash".split())
#: Share of fine documents that a threshold may reject, bounds of a threshold, and the association (in
#: standard errors) from which a feature has a weight.
FALSE_ALARMS, LOWEST, HIGHEST, LEAST_Z = 0.0005, 0.05, 0.5, 4.0
#: Bins of statistics that are features of their own, above the hashed words.
_BINS = 16
_STATS = ("length", "distinct", "symbols", "upper", "marks", "bars", "digits", "word_length")
SIZE = (1 << BITS) + len(_STATS) * _BINS
NO_VOTE = -1


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = {
    "symbols": _table(b"#*$%&<>"), "marks": _table(b"!"), "bars": _table(b"|"), "digits": _table(b"0123456789"),
    "upper": _table(bytes(range(65, 91))), "lower": _table(bytes(range(97, 123))),
}


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Row and index of every distinct feature, and statistics by row."""
    low = K.LOWER[data]
    starts, ends, per = K.words(low, offs, K.ALNUM_WORD)
    n = np.diff(per)
    h = K.word_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique((row << BITS) | (h >> K.U(64 - BITS)).astype(np.int64)) >> BITS, minlength=len(n))
    key = (row << BITS) | (h >> K.U(64 - BITS)).astype(np.int64)
    # beginnings of longer words, so that inflected forms help each other
    long = np.flatnonzero(ends - starts > 5)
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate((low, np.zeros(8, np.uint8))), strides=(1,))
    begin = [K.mix(((eights[starts[long]] & K.U((1 << 8 * n) - 1)) + K.U(n << 56))) >> K.U(64 - BITS) for n in (4, 5)]
    key = np.unique(np.concatenate([key, *((row[long] << BITS) | b.astype(np.int64) for b in begin)]))
    row = key >> BITS
    count = {c: np.diff(np.concatenate(([0], np.cumsum(t[data])))[offs]) for c, t in _CLASSES.items()}
    words = np.maximum(n, 1)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    chars = np.diff(np.concatenate(([0], np.cumsum(ends - starts)))[per])
    s = {
        "length": n, "distinct": np.minimum(distinct / words, 1), "symbols": count["symbols"] / words,
        "upper": count["upper"] / letters, "marks": count["marks"] / words, "bars": count["bars"] / words,
        "digits": count["digits"] / words, "word_length": chars / words,
    }
    bins = {
        "length": np.log2(words), "distinct": s["distinct"] * 15, "symbols": s["symbols"] * 5, "upper": s["upper"] * 15,
        "marks": s["marks"] * 10, "bars": s["bars"] * 10, "digits": s["digits"] * 5, "word_length": s["word_length"],
    }
    extra = [(1 << BITS) + i * _BINS + np.clip(bins[c], 0, _BINS - 1).astype(np.int64) for i, c in enumerate(_STATS)]
    every = np.arange(len(n))
    return np.concatenate((row, *(every for _ in extra))), np.concatenate((key & ((1 << BITS) - 1), *extra)), s


def _insult_indices(half: int) -> np.ndarray:
    text = " ".join(INSULTS[half]).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM_WORD)
    return (K.word_hashes(data, starts, ends) >> K.U(64 - BITS)).astype(np.int64)


def _vote(high, low) -> np.ndarray:
    return np.where(high, 1, np.where(low, 0, NO_VOTE))


def votes(row: np.ndarray, index: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the heuristics, one column each; those on toxicity first, then on quality."""
    n = len(s["length"])
    insults = [np.bincount(row[np.isin(index, _insult_indices(half))], minlength=n) > 0 for half in (0, 1)]
    enough = s["length"] >= 20
    return np.stack([
        _vote(insults[0], enough), _vote(insults[1], enough),
        _vote(enough & (s["distinct"] < 0.25), enough & (s["distinct"] > 0.4)), _vote(s["symbols"] > 0.8, s["symbols"] < 0.2),
        _vote((s["upper"] > 0.6) & enough, s["upper"] < 0.3), _vote(s["marks"] > 0.4, s["marks"] < 0.1), _vote(s["bars"] > 0.4, s["bars"] < 0.1),
    ], axis=1)


#: Columns of ``votes`` by target.
_OWN = {"toxic": (0, 1), "low": (2, 3, 4, 5, 6)}


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of vote patterns, accuracies (vote 1 when bad, vote 0 when fine) and the share of bad.

    Votes are taken as independent given the class. Accuracies start above chance, which settles which
    class is which, and stay within 0.02 .. 0.995 by a pseudo-count.
    """
    if not len(patterns):
        return np.zeros(0), np.zeros((0, 2)), 0.0
    hit, cast = patterns == 1, patterns != NO_VOTE
    accuracy, share = np.tile([0.6, 0.95], (patterns.shape[1], 1)), 0.1
    q = np.zeros(len(patterns))
    for _ in range(rounds):
        bad = np.where(hit, np.log(accuracy[:, 0]), np.log(1 - accuracy[:, 0]))
        fine = np.where(hit, np.log(1 - accuracy[:, 1]), np.log(accuracy[:, 1]))
        z = (np.where(cast, bad - fine, 0)).sum(axis=1) + np.log(share / (1 - share))
        q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        a, b = (counts * q)[:, None], (counts * (1 - q))[:, None]
        accuracy = np.stack([((a * hit).sum(0) + 1.2) / ((a * cast).sum(0) + 2), ((b * (cast & ~hit)).sum(0) + 1.9) / ((b * cast).sum(0) + 2)], axis=1)
        accuracy = np.clip(accuracy, 0.02, 0.995)
        share = float(np.clip((counts * q).sum() / counts.sum(), 0.001, 0.5))
    return q, accuracy, share


def associated(with_pos: np.ndarray, with_all: np.ndarray, n: float, pos: float) -> np.ndarray:
    """Features whose share among bad and fine documents differs by ``LEAST_Z`` standard errors."""
    neg = max(n - pos, 1e-9)
    pos = max(pos, 1e-9)
    rate = (with_all + 1) / (n + 2)
    z = (with_pos / pos - (with_all - with_pos) / neg) / np.sqrt(rate * (1 - rate) * (1 / pos + 1 / neg))
    return (np.abs(z) >= LEAST_Z) & (with_all >= 5)


def train(row: np.ndarray, index: np.ndarray, target: np.ndarray, kept: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of the features and, last, the bias: ridge logistic regression on the ``kept`` features (a mask).

    Memory follows the occurrences of kept features: about 30 bytes each.
    """
    n = len(target)
    pos, neg = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    weights = np.zeros(SIZE + 1)
    names = np.flatnonzero(kept)
    slot = np.full(SIZE, -1, np.int32)
    slot[names] = np.arange(len(names))
    own = slot[index] >= 0
    r, c = row[own], slot[index[own]]
    w, b = np.zeros(len(names)), float(np.log(pos / neg))
    gw, gb = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):  # full gradients with a step per coordinate
        score = np.bincount(r, w[c], n) + b
        d = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target) / n
        g = np.bincount(c, d[r], len(names)) + 1e-5 * w
        gw += g * g
        w -= 0.3 * g / np.sqrt(gw)
        gb += d.sum() ** 2
        b -= 0.3 * d.sum() / np.sqrt(gb)
    weights[names], weights[-1] = w, b
    return weights


def scores(row: np.ndarray, index: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[index], n) + weights[-1], -40, 40)))


FOLDS = 3


def learn(texts: list[pa.Array], y: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Weights and threshold of each target (a column of posteriors ``y``).

    Features are extracted twice: to count them and choose, then to keep the chosen ones; so memory follows the
    texts of the sample. A threshold is a quantile of the scores that fine documents get by models of the other folds
    (``fold`` by document), with their own choice of features.
    """
    n = len(y)

    def extracted():
        at = 0
        for col in texts:
            data, offs = K.text_buffers(col)
            for i, j in K.slices(offs, SLICE_BYTES):
                r, c, _ = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield r + at + i, c
            at += len(offs) - 1

    targets = range(y.shape[1])
    every = np.zeros((FOLDS, SIZE))
    bad = np.zeros((y.shape[1], FOLDS, SIZE))
    for r, c in extracted():
        for f in range(FOLDS):
            own = fold[r] == f
            every[f] += np.bincount(c[own], minlength=SIZE)
            for t in targets:
                bad[t, f] += np.bincount(c[own], y[r[own], t], SIZE)
    size = np.bincount(fold, minlength=FOLDS).astype(float)
    weights, cuts = [], []
    masks = []
    for t in targets:
        pos = np.bincount(fold, y[:, t], FOLDS)
        whole = associated(bad[t].sum(0), every.sum(0), n, pos.sum())
        parts = [associated(bad[t].sum(0) - bad[t, f], every.sum(0) - every[f], n - size[f], pos.sum() - pos[f]) for f in range(FOLDS)]
        masks.append((whole, parts))
    used = np.zeros(SIZE, bool)
    for whole, parts in masks:
        used |= whole
        for p in parts:
            used |= p
    rows, index = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for r, c in extracted():
        own = used[c]
        rows.append(r[own].astype(np.int32))
        index.append(c[own].astype(np.int32))
    row, idx = np.concatenate(rows), np.concatenate(index)
    del rows, index
    for t in targets:
        whole, parts = masks[t]
        weights.append(train(row, idx, y[:, t], whole))
        out = np.zeros(n)
        for f in range(FOLDS):
            other = fold != f
            place = (np.cumsum(other) - 1).astype(np.int32)
            own = other[row]
            w = train(place[row[own]], idx[own], y[other, t], parts[f], rounds=100)
            out[~other] = scores(row, idx, n, w)[~other]
        fine = out[y[:, t] < 0.5]
        cuts.append(float(np.clip(np.quantile(fine, 1 - FALSE_ALARMS) * 1.05, LOWEST, HIGHEST)) if len(fine) else HIGHEST)
    return weights, cuts


def _votes_of(docs: DataFrame) -> DataFrame:
    """_row and the heuristics' votes v. docs: _row, _text."""

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_buffers(batch.column(1))
            got = [votes(*features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in K.slices(offs, SLICE_BYTES)]
            v = np.concatenate(got) if got else np.zeros((0, 7), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.int32).ravel()), v.shape[1]).cast(pa.list_(pa.int32()))], names=["k", "v"])

    return docs.mapInArrow(run, "k long, v array<int>")


def fit(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """Weights by target, labellers' accuracies and the documents used.

    ``labels``: key, toxic and quality (0 or 1). The scorer trains on at most about ``sample`` documents,
    labelled ones if there are any, chosen by a hash of the key; heuristics vote on the same sample.
    Without documents all weights are zero and nothing is rejected.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    none = F.lit(NO_VOTE)
    human = None
    if labels is not None:
        human = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.max(F.lit(1) - F.col("quality").cast("int")).alias("low"))
        human, _ = stored(human, "labels")
        if human.isEmpty():
            human = None
    total = (docs if human is None else human).count()
    part = min(1.0, sample / max(total, 1))
    chosen = F.pmod(F.xxhash64(F.col("k"), F.lit(7)), F.lit(1_000_000)) < int(part * 1_000_000)
    if human is None:
        rows = docs.where(chosen).withColumns({t: none for t in TARGETS})
    else:
        few = human.where(chosen)  # about ``sample`` rows at most
        rows = docs.join(F.broadcast(few) if is_small(few, 2 * sample + 1000) else few, "k")
    rows, _ = stored(rows, "sample")
    heuristics = _votes_of(rows.select("k", "t"))
    seen = rows.select("k", *TARGETS).distinct().join(heuristics.groupBy("k").agg(F.max("v").alias("v")), "k")
    seen, _ = stored(seen, "votes")
    posterior, accuracy = {}, {}
    for t in TARGETS:
        own = F.concat(F.array(F.coalesce(F.col(t), none)), F.array(*(F.col("v")[i] for i in _OWN[t])))
        pattern = seen.select(F.concat_ws(",", own.cast("array<string>")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers rows
        votes_ = np.array([[int(x) for x in r["p"].split(",")] for r in pattern]).reshape(len(pattern), len(_OWN[t]) + 1)
        q, accuracy[t], _ = em(votes_, np.array([r["n"] for r in pattern], float))
        posterior[t] = dict(zip((r["p"] for r in pattern), q.tolist(), strict=True))
    handle = spark.sparkContext.broadcast(posterior)

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, keys = [], [], []
        for batch in batches:
            texts.append(batch.column(1))
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            human_, v = (batch.column(2).to_pylist(), batch.column(3).to_pylist()), batch.column(4).to_pylist()
            for a, b, own in zip(*human_, v, strict=True):
                y.append([handle.value[t].get(",".join(str(x) for x in (NO_VOTE if h is None else h, *(own[i] for i in _OWN[t]))), 0.0) for t, h in zip(TARGETS, (a, b), strict=True)])
        if y:
            fold = (K.mix(np.concatenate(keys).astype(np.int64).view(K.U)) % K.U(FOLDS)).astype(np.int64)
            out, cut = learn(texts, np.array(y), fold)
            yield pa.RecordBatch.from_arrays([pa.array(list(TARGETS)), pa.array([w.astype("<f4").tobytes() for w in out], pa.binary()), pa.array(cut)], names=["target", "weights", "cut"])

    ready = rows.select("k", "t", *TARGETS).join(seen.select("k", "v"), "k")
    # the sample is bounded, so one task may hold it; an executor trains, not the driver
    trained, _ = stored(ready.coalesce(1).sortWithinPartitions("k", "t").mapInArrow(run, "target string, weights binary, cut double"), "weights")
    got = trained.collect()  # one row per target
    weights = {r["target"]: np.frombuffer(bytes(r["weights"]), "<f4") for r in got}
    cuts = {r["target"]: r["cut"] for r in got}
    nothing = np.append(np.zeros(SIZE, "<f4"), np.float32(-20))
    return {"weights": {t: weights.get(t, nothing) for t in TARGETS}, "cut": {t: cuts.get(t, HIGHEST) for t in TARGETS}, "accuracy": accuracy}


def _scorer(spark: SparkSession, model: dict):
    """A function for tasks: both probabilities (2 rows) of a column of texts, and whether each text is kept."""
    handle = spark.sparkContext.broadcast(np.stack([model["weights"][t] for t in TARGETS]))
    cut = np.array([[model["cut"][t]] for t in TARGETS])

    def of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = K.text_buffers(column)
        out = [np.zeros((2, 0))]
        for i, j in K.slices(offs, SLICE_BYTES):
            r, c, _ = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            out.append(np.stack([scores(r, c, j - i, x) for x in handle.value]))
        p = np.concatenate(out, axis=1)
        return p, (p < cut).all(axis=0)

    return of


def score(documents: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Input rows with p_toxic, p_low and kept; columns of these names are replaced. A null or empty text has statistics but no words."""
    of = _scorer(documents.sparkSession, model)
    names = [c for c in documents.columns if c not in ("p_toxic", "p_low", "kept")]
    docs = documents.select(*(F.col(f"`{c}`") for c in names))
    at = names.index(text)

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, kept = of(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[0]), pa.array(p[1]), pa.array(kept)], names=[*names, "p_toxic", "p_low", "kept"])

    kind = T.StructType([*docs.schema.fields, T.StructField("p_toxic", T.DoubleType()), T.StructField("p_low", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.mapInArrow(run, kind)


def keep(documents: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The input rows that ``score`` keeps, with all their columns and no others."""
    of = _scorer(documents.sparkSession, model)
    at = documents.columns.index(text)

    @_tokens.fresh
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(at))[1]))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All input rows with p_toxic, p_low and kept (false if either reaches its threshold).

    Rows of one key or equal rows are scored each. Keys are longs; a null key has no label. An empty table gives none.
    """
    return score(documents, fit(documents, labels, key, text, sample), text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(tables(spark, sf_dir, "documents").select("doc_id", "text"), tables(spark, sf_dir, "labels")).select("doc_id", "p_toxic", "p_low", "kept")
