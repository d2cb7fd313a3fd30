"""Spectra of graphs in components, dense in a task or by Krylov spaces, and medians without a sort."""

import numpy as np
import pytest

from palio.operators import krylov, order, rank_dense, rank_iter
from palio.operators.iterate import stored


@pytest.mark.parametrize("seed", range(3))
def test_medians_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    values = {"a": rng.normal(size=1001) * 1e-3, "b": np.round(rng.normal(size=1500), 1), "c": np.concatenate((np.full(50, -3.25), np.full(50, 7.0))), "d": np.array([-0.0]), "e": -np.exp(rng.normal(size=777) * 40), "f": np.array([-1.0, 1.0])}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["median"] for r in order.medians(df, ["g"], "v").collect()}
    assert got == {g: float(np.median(v)) for g, v in values.items()}


def test_a_median_sorts_no_rows(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("'g' g", "CAST(id AS DOUBLE) v")
    seen, ranges = [], order._ranges
    monkeypatch.setattr(order, "_ranges", lambda rows, *a: seen.append(rows.count()) or ranges(rows, *a))
    assert order.medians(rows, ["g"], "v").first()["median"] == 499.5 and max(seen) < 400


@pytest.mark.parametrize("name", ["svd_rs", "svd_nrs", "hermitian_features", "spectral_gaps", "sync_rank", "sync_rank_angle"])
@pytest.mark.parametrize("dense_nodes", [rank_iter.DENSE_NODES, 20])
def test_components_have_their_own_spectra(spark, monkeypatch, name, dense_nodes):
    """Two components, alone and as one graph: the one with the larger values decides."""
    rng, rows = np.random.default_rng(8), []
    for first, n, size in ((0, 25, 9), (100, 12, 3)):
        rows += [("g", first + i, first + j, float(rng.integers(1, size))) for i in range(n) for j in range(n) if i != j and rng.random() < 0.4]
    e = stored(spark.createDataFrame(rows, "dataset string, src long, dst long, w double"))
    leading, used = rank_iter._leading, []
    monkeypatch.setattr(rank_iter, "_leading", lambda *a: leading(*a, dense_nodes=dense_nodes))
    spaces = krylov.leading
    monkeypatch.setattr(krylov, "leading", lambda *a, **o: used.append(1) or spaces(*a, **o))
    f = {"hermitian_features": lambda d: rank_iter.hermitian_features(d, 1), "spectral_gaps": lambda d: rank_iter.spectral_gaps(d, 4)}.get(name, getattr(rank_iter, name))
    got = sorted(tuple(r) for r in f(e).collect())
    assert bool(used) == (dense_nodes == 20)
    if name == "spectral_gaps":
        a = np.zeros((120, 120))
        for _, i, j, w in rows:
            a[i, j] = w
        want = np.linalg.svd(a - a.T, compute_uv=False)
        assert [r[2] for r in got] == pytest.approx(want[:4].tolist(), abs=1e-6)
    elif name == "svd_rs":
        a = np.zeros((37, 37))
        ids = sorted({v for r in rows for v in r[1:3]})
        for _, i, j, w in rows:
            a[ids.index(i), ids.index(j)] = w
        assert [r[3] for r in got] == pytest.approx(rank_dense.svd_rs(a).tolist(), abs=1e-6)
    else:
        assert len(got) == 37
