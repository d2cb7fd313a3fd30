"""Near copies of the LSH forest against all pairs."""

import numpy as np

from palio.llm import forest


def plain_groups(docs):
    sets = []
    for _, t in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[top(i)] = min(k, least.get(top(i), k))
    return {k: (len(sets[i]), least[top(i)]) for i, (k, _) in enumerate(docs)}


def groups(spark, docs):
    return {r[0]: (r[1], r[2]) for r in forest.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def chains(rng, n, start):
    """Copies of copies around the wanted similarity, and unrelated texts."""
    out, words = [], [f"v{i}" for i in range(300)]
    for g in range(n):
        text = [words[i] for i in rng.integers(0, 300, int(rng.integers(3, 80)))]
        for _ in range(int(rng.integers(1, 7))):
            text = [words[int(rng.integers(0, 300))] if rng.random() < 0.045 else w for w in text]
            out.append((start + len(out), " ".join(text)))
        out.append((start + len(out), out[-1][1].upper()))
    return out


def test_groups_equal_those_of_all_pairs(spark):
    docs = chains(np.random.default_rng(1), 60, 10)
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "one two"), (5006, "long " + "tail end " * 50_000), (5007, "long tail end long")]
    assert groups(spark, docs) == plain_groups(docs)


def test_dense_regions_are_split_and_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(forest, "REGION", 8)
    monkeypatch.setattr(forest, "CLOSEST", 1)
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(70)]
    docs = [(i, " ".join(f"x{rng.integers(0, 99)}" if rng.random() < 0.08 else w for w in base)) for i in range(60)]
    docs += [(100 + i, " ".join(base) + f" end{i}") for i in range(40)]
    assert groups(spark, docs) == plain_groups(docs)


def test_repeated_and_null_keys_and_empty_tables(spark):
    t = " ".join(f"k{i}" for i in range(30))
    rows = [(None, t, 1), (7, t, 2), (7, t + " more", 3), (9, t, 4), (None, "other words", 5), (8, None, 6)]
    got = forest.near_copies(spark.createDataFrame(rows, "doc_id long, text string, component int")).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got if r[2] is not None) == [("7", 29, 7), ("7", 30, 7), ("8", 0, 8), ("9", 29, 7), ("None", 29, 7)]
    assert [(r[0], r[1]) for r in got if r[2] is None] == [(None, 1)]
    assert forest.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
