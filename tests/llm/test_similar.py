import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import fixtures as X  # noqa: E402


def plain_groups(docs, shingle=5):
    sets = {}
    for i, t, *_ in docs:
        w = X.words(t, X.SPACE, True)
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    label = {i: i for i in sets}
    again = True
    while again:
        again = False
        for a in sets:
            for b in sets:
                if label[b] > label[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[b], again = label[a], True
    return label


def test_near_copies_of_similarity_four_fifths_go(spark):
    r = random.Random(3)
    docs = [(i, t, lang, source, n) for i, t, lang, source, n in X.corpus(n=40)]
    for group in range(6):  # chains of copies with more and more words changed
        w = [f"w{r.randrange(5000)}" for _ in range(200)]
        for k in range(8):
            w = list(w)
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            docs.append((1000 + 10 * group + k, " ".join(w), "en", "s", 1))
    frame = spark.createDataFrame(docs, X.SCHEMA).repartition(3)
    label = plain_groups(docs)
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert kept == {i for i, c in label.items() if i == c}
    assert len(kept) < len(docs) - 20


@pytest.mark.parametrize("slot", [4096, 16])
def test_pairs_below_the_limit_are_told_apart_before_they_are_written(spark, monkeypatch, slot):
    from palio.llm import similar

    made, real = [], similar.stored

    def watched(df, name):
        out = real(df, name)
        if name == "others":
            made.append(out[0].count())
        return out

    monkeypatch.setattr(similar, "stored", watched)
    monkeypatch.setattr(similar, "SLOT", slot, raising=False)
    r, base = random.Random(5), [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):  # three words changed: two of them have a similarity of about 0.73
        w = list(base)
        for at in r.sample(range(10, 190), 3):
            w[at] = f"x{i}_{at}"
        docs.append((i, " ".join(w)))
        if i % 10 == 0:
            docs.append((100 + i, " ".join(w[:-1])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component"] for x in similar.similar_groups(frame).collect()}
    assert got == plain_groups(docs)
    assert sum(made) < 2 * len(docs)
