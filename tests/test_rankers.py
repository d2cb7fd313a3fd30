"""Rankers and metrics on graphs small enough to know the answer."""

import numpy as np
import pytest

from palio.operators import gnn, graph, iterate, metrics, mfas, rank_dense, rank_rel, spectral, suites
from palio.sources import generate

CYCLE = [(0, 1, 3.0), (1, 2, 2.0), (2, 0, 1.0)]


def edges(spark, rows, dataset="g"):
    return spark.createDataFrame([(dataset, *r) for r in rows], "dataset string, src long, dst long, w double")


def arrays(rows):
    rows = sorted(rows)
    return tuple(np.array([r[i] for r in rows]) for i in range(3))


def scores(df):
    return {r["node"]: r["score"] for r in df.collect()}


def random_graph(seed, n=12, share=0.4):
    rng = np.random.RandomState(seed)
    a = np.where(rng.uniform(size=(n, n)) < share, rng.randint(1, 9, (n, n)), 0).astype(float)
    np.fill_diagonal(a, 0)
    return a


def test_cycle_loses_its_lightest_edge():
    src, dst, w = arrays(CYCLE)
    r = mfas.rank(3, src, dst, w, swaps=False, refine_ratio=False)
    assert r.kept.tolist() == [True, True, False]
    assert r.scores.tolist() == [3.0, 2.0, 1.0]
    assert r.cycles == 1


@pytest.mark.parametrize("seed", range(4))
def test_acyclic_order_properties(seed):
    a = random_graph(seed)
    src, dst = np.nonzero(a)
    w = a[src, dst]
    runs = [mfas.rank(len(a), src, dst, w, passes=p, swaps=False, refine_ratio=False) for p in (1, 2, 3)]
    for r in runs:
        assert mfas.topological(len(a), src[r.kept], dst[r.kept]) is not None
        assert (~r.kept_peeled | r.kept).all()
        assert (r.scores[src[r.kept]] > r.scores[dst[r.kept]]).all()
        assert len(set(r.scores)) == len(a)
    assert (~runs[0].kept | runs[1].kept).all() and (~runs[1].kept | runs[2].kept).all()
    full = mfas.rank(len(a), src, dst, w, swaps=False)
    assert np.argsort(full.scores).tolist() == np.argsort(runs[2].scores).tolist()
    i, j, m3 = mfas.pair_arrays(src, dst, w)

    def loss(s):
        return np.mean((m3 - (s[i] - s[j]) / (s[i] + s[j])) ** 2)

    assert loss(full.scores) <= loss(runs[2].scores) + 1e-9


def test_swaps_never_raise_the_backward_weight():
    a = random_graph(9)
    src, dst = np.nonzero(a)
    w = a[src, dst]
    s = mfas.scores_of(len(a), src, dst, np.zeros(len(src), bool))
    t = mfas.swap_neighbours(len(a), src, dst, w, s)
    assert w[t[src] <= t[dst]].sum() <= w[s[src] <= s[dst]].sum()


def test_david_score_agrees_with_the_dense_one(spark):
    a = random_graph(3)
    src, dst = np.nonzero(a)
    e = edges(spark, [(int(i), int(j), float(a[i, j])) for i, j in zip(src, dst)])
    have, want = scores(rank_rel.david_score(e)), rank_dense.david_score(a)
    assert all(abs(have[i] - want[i]) < 1e-9 for i in have)


def test_page_rank_agrees_with_the_dense_one(spark):
    a = random_graph(5)
    src, dst = np.nonzero(a)
    e = edges(spark, [(int(i), int(j), float(a[i, j])) for i, j in zip(src, dst)])
    have, want = scores(rank_rel.page_rank(e, rounds=40, tolerance=1e-10)), rank_dense.page_rank(a)
    assert all(abs(have[i] - want[i]) < 1e-7 for i in have)


def test_spring_rank_solves_its_system():
    a = random_graph(1)
    s = rank_dense.spring_rank(a)
    won, lost, both = a.sum(1), a.sum(0), a + a.T
    # springs balance at every node up to the pinning of the last
    lap = np.diag(won + lost) - both
    gap = lap @ s - (won - lost)
    assert np.allclose(gap - gap[0], 0, atol=1e-6)


@pytest.mark.parametrize("name", sorted(set(rank_dense.RANKERS) - {"mvr"}))
def test_rankers_order_a_chain(name):
    """Everyone beats all that come later, so any sane ranker orders the chain, up to direction."""
    n = 6
    a = np.triu(np.ones((n, n)), 1)
    s = np.asarray(rank_dense.RANKERS[name](a, np.random.RandomState(0)), float)
    assert np.isfinite(s).all()
    if name in ("SpringRank", "davidScore", "PageRank", "btl", "SVD_RS", "SVD_NRS", "MFAS_INS1", "MFAS_INS3"):
        order = np.argsort(-s).tolist()
        assert order in (list(range(n)), list(range(n))[::-1])


def test_ranks_many_graphs_and_reports_failures(spark):
    e = edges(spark, CYCLE, "a").unionByName(edges(spark, [(5, 7, 1.0)], "b"))
    got = rank_dense.rank(e, ["davidScore", "MFAS_INS1"], trials=2).collect()
    assert len(got) == (3 + 2) * 2 * 2 and {r["status"] for r in got} == {"ok"}
    small = rank_dense.rank(e, ["davidScore"], most_nodes=2).collect()
    assert {(r["dataset"], r["status"]) for r in small} == {("a", "too large"), ("b", "ok")}
    assert all(r["score"] is None for r in small if r["dataset"] == "a")
    with pytest.raises(KeyError):
        rank_dense.expand(["nobody"])


def test_upsets_of_a_perfect_and_a_reversed_order(spark):
    e = edges(spark, [(0, 1, 2.0), (1, 2, 2.0), (0, 2, 2.0)])
    s = spark.createDataFrame([("g", "good", i, 3.0 - i) for i in range(3)] + [("g", "bad", i, 1.0 + i) for i in range(3)] + [("g", "tied", i, 1.0) for i in range(3)], "dataset string, method string, node long, score double")
    got = {r["method"]: r for r in metrics.upsets(e, s).collect()}
    assert (got["good"]["upset_simple"], got["good"]["upset_naive"]) == (0.0, 0.0)
    assert (got["bad"]["upset_simple"], got["bad"]["upset_naive"]) == (4.0, 1.0)
    assert (got["tied"]["upset_simple"], got["tied"]["upset_naive"]) == (1.0, 1.0)
    turned = {r["method"]: r for r in metrics.evaluated(e, s).collect()}
    assert turned["bad"]["flipped"] and turned["bad"]["upset_simple"] == 0.0


def test_balanced_pairs_and_single_precision(spark):
    e = edges(spark, [(0, 1, 2.0), (1, 0, 2.0), (0, 2, 0.1 + 0.1 + 2.0), (2, 0, 1.1 + 1.1), (1, 2, 1.0)])
    assert [(r["i"], r["j"]) for r in graph.decided(e).collect()] == [(1, 2)]


def test_shift_or_logistic(spark):
    s = spark.createDataFrame([("g", "a", 0, -0.5), ("g", "a", 1, 0.5), ("g", "b", 0, -2.0), ("g", "b", 1, 0.0), ("g", "c", 0, 0.0), ("g", "c", 1, 2.0)], "dataset string, method string, node long, score double")
    got = {(r["method"], r["node"]): r["score"] for r in metrics.shifted(s).collect()}
    assert got["a", 0] == 0.25 and got["b", 1] == 0.5 and got["c", 1] == 2.0


def test_components_and_trim(spark):
    e = edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0), (8, 9, 1.0)])
    c = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert c == {0: 0, 1: 0, 2: 0, 3: 0, 8: 8, 9: 8}
    assert graph.largest_component(e).count() == 4
    assert sorted((r["src"], r["dst"]) for r in graph.trim(e, 2).collect()) == [(0, 1), (1, 2), (2, 0)]


def test_empty_graph(spark):
    e = edges(spark, [(0, 1, 1.0)]).where("w > 5")
    assert rank_rel.david_score(e).count() == 0
    assert graph.profile(e).count() == 0
    assert graph.components(e).count() == 0


def test_training_lowers_the_loss():
    a = random_graph(2, n=15)
    for kind in gnn.MODELS:
        _, losses = gnn.train_one(a, kind, 80)
        assert min(losses) < losses[0]


def test_gradient_of_the_ratio_loss():
    rng = np.random.RandomState(0)
    s = rng.uniform(0.2, 0.9, (5, 1))
    i, j, share, gap = np.array([0, 1, 3]), np.array([2, 4, 0]), np.array([0.5, 1.0, 0.2]), np.array([1.0, 2.0, 3.0])
    _, g = gnn.ratio_loss(s, i, j, share, gap, 0.3, 1.0, 0.5)
    for k in range(5):
        d = np.zeros_like(s)
        d[k] = 1e-6
        num = (gnn.ratio_loss(s + d, i, j, share, gap, 0.3, 1.0, 0.5)[0] - gnn.ratio_loss(s - d, i, j, share, gap, 0.3, 1.0, 0.5)[0]) / 2e-6
        assert abs(num - g[k, 0]) < 1e-5


def test_synthetic_graphs_are_seeded(spark):
    a, rank = generate.ero_matrix(40, 0.3, 0.0, "uniform", 10)
    b, _ = generate.ero_matrix(40, 0.3, 0.0, "uniform", 10)
    assert (a == b).all() and not (a * a.T).any()
    src, dst = np.nonzero(a)
    assert (rank[src] < rank[dst]).all()
    e, labels = generate.ero(spark, [(20, 0.5, 0.1, "gamma", 3)])
    assert labels.count() == 20 and e.count() > 0


def test_spectral(spark):
    a = random_graph(7)
    x = spectral.hermitian(a, 2)
    assert x.shape == (len(a), 4) and np.allclose(x.mean(0), 0)
    assert all(np.isclose(v, 1) or v < 1e-9 for v in x.std(0))
    assert len(set(spectral.k_means(np.array([[0.0], [0.1], [5.0], [5.1]]), 2)[[0, 2]])) == 2


def test_settled_stops(spark):
    df = spark.createDataFrame([(1,), (9,)], "x int")
    assert sorted(r["x"] for r in iterate.settled(df, lambda d: d.selectExpr("least(x + 1, 10) x"), 50).collect()) == [10, 10]


def test_refinement_keeps_the_order_and_lowers_the_loss():
    for seed in range(4):
        a = random_graph(seed)
        src, dst = np.nonzero(a)
        w = a[src, dst]
        start = mfas.scores_of(len(a), src, dst, np.zeros(len(src), bool))
        end = mfas.refine(src, dst, w, start)
        i, j, share = mfas.pair_arrays(src, dst, w)
        loss = lambda s: np.mean((share - (s[i] - s[j]) / (s[i] + s[j])) ** 2)
        assert (np.argsort(end, kind="stable") == np.argsort(start, kind="stable")).all()
        assert loss(end) < loss(start) and (np.diff(np.sort(end)) > 0).all()


def test_refinement_finds_the_least_ratio_error():
    # two nodes that met at 3:1; the upper one may rise to 1 above, and 3:1 is within reach of the grid
    s = mfas.refine(np.array([0, 1]), np.array([1, 0]), np.array([3.0, 1.0]), np.array([2.5, 1.0]), passes=1)
    assert abs(s[0] / s[1] - 3) < 1e-2


def test_a_slow_ranker_is_stopped_and_all_its_trials_are_missing(spark):
    import time

    def slow(a, rng=None):
        if rng.randint(1 << 30) % 2:
            time.sleep(60)
        return np.arange(len(a), dtype=float)

    rank_dense.register("slow", slow)
    try:
        began = time.perf_counter()
        got = rank_dense.rank(edges(spark, [(0, 1, 1.0), (1, 2, 1.0)]), ["slow", "davidScore"], trials=4, deadline=1.0).collect()
        assert time.perf_counter() - began < 50
        assert {r["status"] for r in got if r["method"] == "slow"} == {"timeout"}
        assert all(r["score"] is None for r in got if r["method"] == "slow")
        assert {r["status"] for r in got if r["method"] == "davidScore"} == {"ok"}
    finally:
        del rank_dense.RANKERS["slow"]


def test_variants_share_a_peel(spark):
    rng = np.random.RandomState(3)
    rows = [("g", i, j, float(rng.randint(1, 9))) for i in range(14) for j in range(14) if i != j and rng.rand() < 0.4]
    e = spark.createDataFrame(rows, "dataset string, src long, dst long, w double")
    methods = ["MFAS_INS1", "MFAS_INS2", "MFAS_INS3"]
    want = {(r["method"], r["node"]): r["score"] for r in rank_dense.rank(e, methods).collect()}
    assert {(r["method"], r["node"]): r["score"] for r in rank_dense.acyclic(e).collect()} == want


def test_a_suite_of_another_size_is_an_error(spark):
    rows = spark.createDataFrame([("a", "m", "c", 0.5, 0.5, 0.5, 1.0)], "dataset string, method string, config string, upset_simple double, upset_ratio double, upset_naive double, runtime_sec double")
    assert suites.method_table(rows, ["m"], rows, expected=1).count() == 1
    with pytest.raises(suites.UnexpectedSize):
        suites.method_table(rows, ["m"], rows, expected=80)
