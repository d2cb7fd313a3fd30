"""Rankers that need one graph's matrix: one graph per group, in NumPy.

A ranker takes a dense matrix (a[i, j]: how much i beats j) and a seeded generator and returns scores, larger
is better. Where the published method's implementation departs from its paper, the implementation counts
("as run"); the departure is named and a switch gives the other where both make sense.
"""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palio.operators import grouped, mfas
from palio.operators.iterate import stored

Ranker = Callable[[np.ndarray, np.random.RandomState], np.ndarray]
#: Nodes of a graph that is handed to a dense ranker at most; larger ones get a row with status "too large".
MOST_NODES = 6000


def spring_rank(a: np.ndarray, rng=None, alpha: float = 0.0, l0: float = 1.0, l1: float = 1.0) -> np.ndarray:
    """Solves the spring system. At alpha 0 the last node's springs are added to every row, which pins the mean."""
    n = len(a)
    won, lost = a.sum(axis=1), a.sum(axis=0)
    both = a + a.T
    if alpha:
        m = -both
        m[np.diag_indices(n)] += alpha + won + lost
        b = alpha * l0 + l1 * (won - lost)
    else:
        m = -(both + both[n - 1])
        m[np.diag_indices(n)] += won + lost
        b = l1 * (won - lost) + l1 * (won[n - 1] - lost[n - 1])
    try:
        return np.linalg.solve(m, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(m, b, rcond=None)[0]


def david_score(a: np.ndarray, rng=None) -> np.ndarray:
    total = a + a.T
    p = np.divide(a, total, out=np.zeros_like(a), where=total != 0)
    np.fill_diagonal(p, 0)
    w, l = p.sum(axis=1), p.sum(axis=0)  # noqa: E741
    return w + p @ w - l - p.T @ l


def page_rank(a: np.ndarray, rng=None, damping: float = 0.8, tolerance: float = 1e-12) -> np.ndarray:
    n, lost = len(a), a.sum(axis=0)
    m = a / np.where(lost == 0, 1.0, lost)
    v = np.full(n, 1.0 / n)
    while True:
        new = damping * (m @ v) + (1 - damping) / n * v.sum()
        new /= np.abs(new).sum()
        if np.linalg.norm(new - v) <= tolerance:
            return new
        v = new


def bradley_terry(a: np.ndarray, rng=None, tolerance: float = 1e-3, rounds: int = 10_000) -> np.ndarray:
    """Zermelo's iteration as run: nodes update one after another in place, and the stop test compares the
    sweep's result before and after normalising. Starts at random; nodes without matches get 0."""
    rng = rng or np.random.RandomState(0)
    a = a.copy()
    np.fill_diagonal(a, 0)
    n, won, played = len(a), a.sum(axis=1) + 1e-6, a + a.T
    g = rng.uniform(size=n)
    rng.uniform(size=n)
    idle = played.sum(axis=0) == 0
    for _ in range(rounds):
        for i in range(n):
            if idle[i]:
                g[i] = 0.0
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                q = played[i] / (g[i] + g)
            q[i] = 0.0
            g[i] = won[i] / np.nansum(q)
        new = g / g.sum()
        gap = np.linalg.norm(new - g)
        g = new
        if gap <= tolerance:
            break
    return g


def _leading(m: np.ndarray) -> np.ndarray:
    """Eigenvector of the eigenvalue of largest magnitude, its largest component real and positive."""
    values, vectors = np.linalg.eig(m)
    v = vectors[:, np.argmax(np.abs(values))]
    return v * np.exp(-1j * np.angle(v[np.argmax(np.abs(v))]))


def eigenvector_centrality(a: np.ndarray, rng=None) -> np.ndarray:
    return np.real(_leading(a + 1e-6))


def rank_centrality(a: np.ndarray, rng=None, compat: bool = True) -> np.ndarray:
    """Stationary scores of a walk from losers to winners. As run (``compat``) the transition matrix stays
    unnormalised, with 1 minus the row sum on the diagonal; else each row is divided by the largest degree."""
    b = a.T.copy()
    np.fill_diagonal(b, 0)
    b += 1
    if not compat:
        b = b / (b + b.T)
        np.fill_diagonal(b, 0)
        b /= max(len(b), 1)
    np.fill_diagonal(b, 0)
    np.fill_diagonal(b, 1 - b.sum(axis=1))
    return np.real(_leading(b.T))


def serial_matrix(a: np.ndarray) -> np.ndarray:
    c = np.sign(a.T - a)
    s = c @ c.T / 2
    return np.where(s != 0, s + len(a) / 2, 0.0)


def serial_rank(a: np.ndarray, rng=None) -> np.ndarray:
    """Second vector of the similarity's Laplacian."""
    s = serial_matrix(a)
    values, vectors = np.linalg.eigh(np.diag(s.sum(axis=1)) - s)
    v = vectors[:, np.argsort(np.abs(values), kind="stable")[1]] if len(a) > 1 else np.zeros(len(a))
    return v * (1.0 if v[np.argmax(np.abs(v))] >= 0 else -1.0)


def _angles(a: np.ndarray) -> np.ndarray:
    n = len(a)
    c = np.sign(a.T - a)
    h = np.where(c != 0, np.exp(1j * np.pi * c / max(n - 1, 1)), 0)
    degree = np.abs(h).sum(axis=0)
    return np.angle(_leading(h / np.where(degree == 0, 1.0, degree)[:, None]))


def _shift(a: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, int]:
    """Order 1 .. n by angle, and the cyclic shift with the least weight above the diagonal (offsets as run)."""
    n, t = len(a), a.T
    order = np.empty(n)
    order[np.argsort(angle, kind="stable")] = np.arange(1, n + 1)
    best, least = 0, np.inf
    for k in range(n):
        place = ((order + k - 2) % n).astype(int)
        by = np.empty(n, int)
        by[place] = np.arange(n)
        cost = np.triu(t[np.ix_(by, by)]).sum()
        if cost < least:
            best, least = k, cost
    return order, best


def sync_rank(a: np.ndarray, rng=None) -> np.ndarray:
    """Ranks (1 is best) by angular synchronisation, negated to be scores."""
    order, best = _shift(a, _angles(a))
    return -(((order + best - 2) % len(a)) + 1)


def sync_rank_angle(a: np.ndarray, rng=None) -> np.ndarray:
    angle = _angles(a)
    return angle - angle[_shift(a, angle)[1]]


def _from_plane(h: np.ndarray, basis: np.ndarray, normal: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The direction in the plane of two singular vectors that is orthogonal to ``normal``'s projection, scaled by the median slope."""
    coeff = normal @ basis
    inside = basis @ coeff
    inside /= np.linalg.norm(inside) or 1.0
    second = basis[:, 1] - (inside @ basis[:, 1]) * inside
    second /= np.linalg.norm(second) or 1.0
    score = scale * second
    # as run, differences are taken to the sum of all scores, not pairwise
    gap = np.broadcast_to((score - score.sum())[:, None], h.shape)
    used = h != 0
    with np.errstate(divide="ignore", invalid="ignore"):
        tau = np.median(h[used] / gap[used]) if used.any() else 0.0
    return tau * (score - score.mean())


def svd_rs(a: np.ndarray, rng=None) -> np.ndarray:
    h, n = a - a.T, len(a)
    u = np.linalg.svd(h)[0][:, :2]
    return _from_plane(h, u, np.full(n, n**-0.5), np.ones(n))


def svd_nrs(a: np.ndarray, rng=None) -> np.ndarray:
    h = a - a.T
    d = 1 / np.maximum(np.sqrt(np.abs(h).sum(axis=0)), 1 / 999999999)
    u = np.linalg.svd(d[:, None] * h * d)[0][:, :2]
    return _from_plane(h, u, d / (np.linalg.norm(d) or 1.0), d)


def _backward(a: np.ndarray, order: np.ndarray) -> float:
    return float(np.tril(a[np.ix_(order, order)], -1).sum())


def minimum_violations(a: np.ndarray, rng=None, samples: int = 5) -> np.ndarray:
    """Local search over orders by random swaps, from ``samples`` starts, each until n^2 swaps in a row gain nothing; negated ranks.

    This compares true violation counts; the published code drops an element of each slice and so isn't a descent.
    """
    rng = rng or np.random.RandomState(0)
    n = len(a)
    best, least = np.arange(n), np.inf
    net = a - a.T
    for _ in range(samples):
        order = np.arange(n)

        def gain(i: int, j: int, order=order) -> float:
            """Change of the weight of backward edges if places i < j swap."""
            u, v, mid = order[i], order[j], order[i + 1 : j]
            return float(net[u, mid].sum() + net[mid, v].sum() + net[u, v])

        fails = 0
        while fails < n * n and n > 1:
            i, j = sorted(rng.choice(n, 2, replace=False).tolist())
            if gain(i, j) < -1e-12:
                order[[i, j]] = order[[j, i]]
                fails = 0
            else:
                fails += 1
        cost = _backward(a, order)
        if cost < least:
            best, least = order.copy(), cost
    out = np.empty(n)
    out[best] = -np.arange(n, dtype=float)
    return out


def _mfas(passes: int, swaps: bool = True) -> Ranker:
    def run(a: np.ndarray, rng=None) -> np.ndarray:
        src, dst = np.nonzero(a > 0)
        return mfas.rank(len(a), src, dst, a[src, dst], passes=passes, swaps=swaps).scores

    return run


#: Rankers by name. ``register`` adds more.
RANKERS: dict[str, Ranker] = {
    "SpringRank": spring_rank, "davidScore": david_score, "PageRank": page_rank, "btl": bradley_terry,
    "eigenvectorCentrality": eigenvector_centrality, "rankCentrality": rank_centrality, "serialRank": serial_rank,
    "syncRank": sync_rank, "syncRank_angle": sync_rank_angle, "SVD_RS": svd_rs, "SVD_NRS": svd_nrs,
    "mvr": minimum_violations, "MFAS_INS1": _mfas(1), "MFAS_INS2": _mfas(2), "MFAS_INS3": _mfas(3), "MFAS": _mfas(3),
    "MFAS_INS3_noswap": _mfas(3, swaps=False),
}
PRESETS = {
    "baselines_shorter": ["SpringRank", "davidScore", "PageRank", "eigenvectorCentrality", "SVD_RS", "SVD_NRS"],
    "baselines_full": ["SpringRank", "syncRank", "serialRank", "btl", "davidScore", "eigenvectorCentrality", "PageRank", "rankCentrality", "SVD_RS", "SVD_NRS"],
    "all_MFAS": ["MFAS_INS1", "MFAS_INS2", "MFAS_INS3"],
}


def register(name: str, ranker: Ranker) -> None:
    RANKERS[name] = ranker


def expand(methods: list[str]) -> list[str]:
    """Method names with presets replaced; an unknown name raises KeyError."""
    out: list[str] = []
    for m in methods:
        out += PRESETS.get(m, [m])
    for m in out:
        if m not in RANKERS:
            raise KeyError(f"unknown method {m}")
    return list(dict.fromkeys(out))


class TimeIsUp(Exception):
    """A ranker took longer than it may."""


@contextmanager
def time_limit(seconds: float | None):
    """Raises ``TimeIsUp`` inside the block after so many seconds; works in the main thread, where Spark's Python workers run tasks."""
    if seconds is None:
        yield
        return

    def stop(*_):
        raise TimeIsUp

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


SCHEMA = "dataset string, method string, trial int, node long, score double, runtime_sec double, status string"


def rank(edges: DataFrame, methods: list[str], trials: int = 1, seed: int = 10, most_nodes: int = MOST_NODES, deadline: float | None = None) -> DataFrame:
    """Scores of every dataset by every method and trial: one task group per (dataset, method, trial).

    A method that fails gives rows of null scores and its status. One that exceeds ``deadline`` seconds is stopped, and
    then all its trials on that dataset are null with status "timeout", so that results count as missing. Graphs
    beyond ``most_nodes`` are not densified.
    """
    names = expand(methods)
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(t).alias("trial")) for m in names for t in range(trials))))
    jobs = edges.select("dataset", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double"), grid.alias("job")).select("dataset", "src", "dst", "w", "job.method", "job.trial")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dataset, method, trial = key
        nodes, flat = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        flat = flat.reshape(-1, 2)
        n, status, took = len(nodes), "ok", None
        scores = np.full(n, np.nan)
        if n > most_nodes:
            status = "too large"
        else:
            a = np.zeros((n, n))
            np.add.at(a, (flat[:, 0], flat[:, 1]), pdf["w"].to_numpy())
            began = time.perf_counter()
            try:
                with time_limit(deadline):
                    scores = np.asarray(RANKERS[method](a, np.random.RandomState(seed + trial)), float)
                took = time.perf_counter() - began
            except TimeIsUp:
                status = "timeout"
            except (np.linalg.LinAlgError, FloatingPointError, ValueError) as e:
                status = type(e).__name__
        return pd.DataFrame({"dataset": dataset, "method": method, "trial": np.int32(trial), "node": nodes, "score": scores, "runtime_sec": took, "status": status}).astype({"runtime_sec": float})

    out = jobs.groupBy("dataset", "method", "trial").applyInPandas(run, SCHEMA)
    out = out.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in ("score", "runtime_sec")})
    if deadline is None:
        return out
    out = stored(out)  # a second run could end otherwise
    late = out.where("status = 'timeout'").select("dataset", "method", F.lit(True).alias("_late")).distinct()
    out = out.join(late, ["dataset", "method"], "left")
    none = {c: F.when(F.col("_late").isNull(), F.col(c)) for c in ("score", "runtime_sec")}
    return out.withColumns({**none, "status": F.when(F.col("_late"), "timeout").otherwise(F.col("status"))}).drop("_late")


def acyclic(edges: DataFrame, passes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Scores of acyclic orderings with several numbers of add-back passes; the cycles of a graph are peeled once for all."""
    kinds = {"dataset": pa.string(), "method": pa.string(), "trial": pa.int32(), "node": pa.int64(), "score": pa.float64(), "status": pa.string()}

    def run(key: dict, g: grouped.Graph) -> Iterator[pa.RecordBatch]:
        n = len(g.nodes)
        peeled, known = mfas.peel_cycles(n, g.src, g.dst, g.w), {}
        for p in passes:
            # what a pass keeps, the next one keeps too: as many edges are the same edges
            kept = int(mfas.put_back(n, g.src, g.dst, g.w, peeled[0], p)[0].sum())
            if kept not in known:
                known[kept] = mfas.rank(n, g.src, g.dst, g.w, passes=p, peeled=peeled).scores
            yield grouped.table({"dataset": key["dataset"], "method": f"MFAS_INS{p}", "trial": 0, "node": g.nodes, "score": known[kept], "status": "ok"}, kinds, n)

    return grouped.per_graph(edges.where("w > 0"), run, "dataset string, method string, trial int, node long, score double, status string")


def mfas_reports(edges: DataFrame, variants: dict[str, dict]) -> DataFrame:
    """``mfas_report`` for several sets of options, by name in ``variant``; the cycles of a graph are peeled once for all."""
    kind = "variant string, dataset string, n int, m int, cycles int, removed_peeling int, kept_peeled int, kept_final int, reinserted array<int>, stop string, kept_mask array<boolean>, scores array<double>"

    def listed(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))

    def run(key: dict, g: grouped.Graph) -> Iterator[pa.RecordBatch]:
        n, m = len(g.nodes), len(g.src)
        peeled = mfas.peel_cycles(n, g.src, g.dst, g.w)
        for name, options in variants.items():
            r = mfas.rank(n, g.src, g.dst, g.w, peeled=peeled, **options)
            held = int(r.kept_peeled.sum())
            numbers = {"n": n, "m": m, "cycles": r.cycles, "removed_peeling": m - held, "kept_peeled": held, "kept_final": int(r.kept.sum())}
            columns = {"variant": pa.array([name]), "dataset": pa.array([key["dataset"]]), **{c: pa.array([v], pa.int32()) for c, v in numbers.items()}}
            columns |= {"reinserted": listed(np.array(r.reinserted, np.int32)), "stop": pa.array([r.stop]), "kept_mask": listed(r.kept), "scores": listed(r.scores)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return grouped.per_graph(edges.where("w > 0"), run, kind)


def mfas_report(edges: DataFrame, **options) -> DataFrame:
    """One row per dataset: sizes, cycles peeled, edges removed and kept, edges put back per pass, why it stopped."""
    return mfas_reports(edges, {"": options}).drop("variant")


__all__ = ["MOST_NODES", "PRESETS", "RANKERS", "acyclic", "expand", "mfas_report", "mfas_reports", "rank", "register"]
