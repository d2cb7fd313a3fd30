"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter

import numpy as np

from palio.llm import lexical

from . import fixtures as X


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(X.LOWER))


def plain_search(docs, items, top=10):
    tf = [(k, Counter(terms(t))) for k, t in docs]
    tf = [(k, c) for k, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for k, c in tf:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s:
                scores.append((-s, k))
        out += [(item, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in lexical.search(d, q, **more).select("item_id", "rank", "doc_id", "score").collect())


def test_search_with_ties_and_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["Ünd", "ß9"]
    text = lambda n: " ".join(words[min(int(rng.exponential(12)), 61)] + rng.choice(["", ".", "_"]) for _ in range(n))
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(400)] + [(1000 + i, "w1 w2 w50") for i in range(30)] + [(2000, None), (2001, ""), (2002, "?!")]
    items = [(i, text(int(rng.integers(0, 12)))) for i in range(20)] + [(90, "w1 W2 w50 w50"), (91, None), (92, "nothing"), (93, "w61 ünd")]
    want = plain_search(docs, items)
    monkeypatch.setattr(lexical, "FIRST", 4)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, top=3) == plain_search(docs, items, 3)


def test_blocks_keep_the_bound_strict():
    doc, impact = np.arange(40), np.full(40, 7)
    block = lexical.Block(doc, np.arange(41), np.zeros(40, np.int64), impact, 1)
    rows, score = block.best(np.array([0]), np.array([3]), np.array([3]), 2, 1)
    assert sorted(rows.tolist()) == list(range(40)) and set(score.tolist()) == {21}


def test_small_blocks(spark, monkeypatch):
    docs = [(i, f"a b{i % 7} c{i % 11} " * (1 + i % 3)) for i in range(120)]
    items = [(1, "a b1 c3"), (2, "b2 b2 c0 zz")]
    # tasks read the constant from the module that they import, so blocks are made here
    d, want = [(k, Counter(terms(t))) for k, t in docs], plain_search(docs, items)
    vocabulary = sorted({t for _, c in d for t in c})
    at = {t: i for i, t in enumerate(vocabulary)}
    n, total = len(d), sum(sum(c.values()) for _, c in d)
    for item, text in items:
        asked = [(at[t], q) for t, q in Counter(terms(text)).items() if t in at]
        own = np.array([t for t, _ in asked])
        have: list = []
        for lo in range(0, 120, 30):
            part = d[lo : lo + 30]
            entries = [(i, at[t], (10**9 * c) // (1000 * c + 8 * (25 + (75 * sum(cs.values()) * n) // total))) for i, (_, cs) in enumerate(part) for t, c in sorted(cs.items())]
            ends = np.concatenate(([0], np.cumsum([len(cs) for _, cs in part])))
            block = lexical.Block(np.array([k for k, _ in part]), ends, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), len(vocabulary))
            w = np.array([q * math.floor(1000 * math.log((2 * n + 2) / (2 * sum(vocabulary[t] in c for _, c in d) + 1))) for t, q in asked])
            every = np.full(len(vocabulary), -1)
            every[own] = w
            rows, score = block.best(own, w, every, 10, have[-1][0] * -1 if len(have) >= 10 else 1)
            have = sorted([*have, *zip((-score).tolist(), block.doc[rows].tolist(), strict=True)])[:10]
        assert [(item, r + 1, k, -s) for r, (s, k) in enumerate(have)] == [w for w in want if w[0] == item]


def test_no_documents_no_items_and_repeated_keys(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []
    docs = [(None, "a b"), (2, "a b"), (2, "a b"), (3, "c d e f"), (4, "g")]
    rows = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, score int")
    got = lexical.search(rows, spark.createDataFrame([(5, "a"), (None, "c")], "item_id long, text string")).collect()
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"])) for r in got) == [("5", 1, "None"), ("5", 2, "2"), ("5", 3, "2"), ("None", 1, "3")]
