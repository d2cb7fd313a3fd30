"""Acyclic ordering against a search that begins anew for every cycle, and on graphs that don't fit a dense matrix."""

import time

import numpy as np
import pytest

from palio.operators import mfas, rank_dense
from palio.plans import inputs as I
from palio.plans import queries  # noqa: F401  registers its queries
from palio.plans import registry as Q


def peeled_anew(n, src, dst, w):
    """The first back edge's cycle of a new search, again and again."""
    left, alive, count = w.copy(), np.ones(len(w), bool), 0

    def search(here, path, state):
        state[here] = 1
        for e in np.nonzero((src == here) & alive)[0].tolist():
            if state[dst[e]] == 1:
                whole = [*path, e]
                return whole[next(k for k, x in enumerate(whole) if src[x] == dst[e]) :]
            if state[dst[e]] == 0 and (found := search(dst[e], [*path, e], state)):
                return found
        state[here] = 2
        return None

    while True:
        state = [0] * n
        cycle = next((c for v in range(n) if not state[v] and (c := search(v, [], state))), None)
        if cycle is None:
            return alive, count
        low = min(left[cycle])
        left[cycle] -= low
        alive[[e for e in cycle if left[e] <= mfas.ZERO]] = False
        count += 1


@pytest.mark.parametrize("seed", range(12))
def test_peeling_goes_on_where_a_new_search_would_come(seed):
    rng = np.random.RandomState(seed)
    n = 14
    a = np.where(rng.uniform(size=(n, n)) < 0.1 + 0.05 * seed, rng.randint(1, 9, (n, n)), 0).astype(float)
    src, dst = np.nonzero(a)
    have, want = mfas.peel_cycles(n, src, dst, a[src, dst]), peeled_anew(n, src, dst, a[src, dst])
    assert have[0].tolist() == want[0].tolist() and have[1] == want[1]


def test_peeling_many_cycles_takes_time_by_their_edges():
    n = 30_000
    src = np.arange(n)
    dst = src ^ 1  # pairs that beat each other
    began = time.perf_counter()
    alive, count = mfas.peel_cycles(n, src, dst, np.where(src % 2, 1.0, 2.0))
    assert count == n // 2 and alive.tolist() == [True, False] * (n // 2)
    assert time.perf_counter() - began < 10  # minutes, if every search began anew


def test_phases_share_a_peel_and_equal_single_reports(spark):
    rng = np.random.RandomState(5)
    rows = [(g, i, j, float(rng.randint(1, 9))) for g in "ab" for i in range(12) for j in range(12) if i != j and rng.rand() < 0.4]
    e = spark.createDataFrame([*rows, rows[0]], "dataset string, src long, dst long, w double")  # an edge twice
    options = {"A": {"add_back": False, "refine_ratio": False}, "B": {"passes": 2}}
    got = {(r["variant"], r["dataset"]): r for r in rank_dense.mfas_reports(e, options).collect()}
    for name, o in options.items():
        for r in rank_dense.mfas_report(e, **o).collect():
            assert r.asDict() == {k: v for k, v in got[name, r["dataset"]].asDict().items() if k != "variant"}
            assert r["m"] == len({x[:3] for x in rows if x[0] == r["dataset"]}) and len(r["scores"]) == r["n"]


def test_passes_are_compared_on_graphs_beyond_a_dense_matrix(spark, monkeypatch):
    n = rank_dense.MOST_NODES + 10
    rows = spark.range(n - 1).selectExpr("'g' dataset", "id src", "id + 1 dst", "1.0D w")
    monkeypatch.setattr(I, "h2h_edges", lambda *_: rows)
    assert [tuple(r) for r in Q.QUERIES["evl14_pass_equivalence"](spark, "").collect()] == [("g", True, True)]
