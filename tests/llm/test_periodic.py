"""Periodic runs against a plain version."""

import hashlib
import zlib

import numpy as np
import pytest

from palio.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain_runs(x, least=1):
    """Every maximal stretch with a smallest period that it holds three times: all periods are tried."""
    n, out = len(x), {}
    for q in range(1, n // 3 + 1):
        t = 0
        while t + q < n:
            if x[t] != x[t + q]:
                t += 1
                continue
            s = t
            while t + q < n and x[t] == x[t + q]:
                t += 1
            if t + q - s >= max(least, 3 * q):
                out.setdefault((s, t + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def words_of_kind(kind, rng):
    n = int(rng.integers(1, 220))
    if kind == 0:
        return rng.integers(0, int(rng.integers(1, 4)), n)
    if kind == 1:
        parts = [np.tile(rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 30))), int(rng.integers(1, 8))) for _ in range(5)]
        return np.concatenate(parts)
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    x = np.array(b)
    if rng.random() < 0.5:
        x[rng.integers(0, len(x))] = 2
    return x


@pytest.mark.parametrize("kind", range(3))
def test_runs_equal_plain_ones(kind):
    rng = np.random.default_rng(kind)
    for _ in range(120):
        x = words_of_kind(kind, rng)
        got = sorted(zip(*(v.tolist() for v in periodic.runs_in(np.append(x, -1), len(x))), strict=True))
        assert got == plain_runs(x.tolist())


def test_runs_of_texts_of_several_lengths():
    rng = np.random.default_rng(9)
    xs = [words_of_kind(k % 3, rng) for k in range(60)] + [np.zeros(0, int), np.tile(np.arange(500), 7)]
    _, runs = periodic.runs_of_texts([" ".join(map(str, x)).encode() for x in xs])
    for x, r in zip(xs, runs, strict=True):
        assert [tuple(v) for v in r.tolist()] == plain_runs(x.tolist(), 24)


def test_rows_without_words_repeated_rows_and_clashing_names(spark):
    t = "a b " * 12 + "end"
    rows = [(None, t, 1), (3, t, 2), (3, t, 3), (4, None, 4), (5, "", 5), (6, " \t\n", 6), (7, "x " * 23, 7), (8, "  " * 24, 8), (9, "long" + " w" * 300_000, 9)]
    got = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["rest"]))
    assert by[3] == [(25, [(0, 24, 2)], "a b end")] * 2 and by[None] == by[3][:1]
    assert by[4] == by[5] == by[6] == [(0, [], "")]
    assert by[7][0][1] == [] and by[8] == [(24, [(0, 24, 1)], " ")]
    assert by[9] == [(300_001, [(1, 300_000, 1)], "long w")]
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    found = 0
    for d in docs:
        w = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        number = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs = plain_runs([number[x] for x in w], 24) if n < 3000 else None
        r = got[d["doc_id"]]
        if runs is None:
            continue
        found += len(runs)
        best = min(runs, key=lambda v: (-v[1] / v[2], v[0], v[2]), default=(None,) * 3)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
    assert found > 5
