"""The operators against plain versions on a small corpus with odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from palio.llm import _flat as K
from palio.llm import _tokens, decontaminate, licenses, outliers, packing, rangecoder, simhash, substring, suffix, urltree, weaklabel

from . import fixtures as X

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain_ids():
    """Ids of a text by a tokenizer of the test's own."""
    own = tokenizers.Tokenizer.from_file(_tokens.default_path())
    return lambda t: own.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs():
    return X.corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, X.SCHEMA).repartition(3)


def test_substring(spark, docs, frame):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["rest"]) for r in substring.dedup_substrings(spark, frame).collect()}
    assert got == X.plain_substring(docs)
    assert any(v[1] for v in got.values())


def test_substring_texts_and_other_columns(spark, docs, frame):
    got = substring.dedup_substrings(spark, frame, texts=True, carry=("lang", "source")).collect()
    by = {d[0]: d for d in docs}
    assert len(got) == len(docs)
    for r in got:
        assert r["carried"]["lang"] == by[r["doc_id"]][2]
        if not r["n_removed"]:
            assert r["rest"] == by[r["doc_id"]][1]


def test_repeats_are_read_again_at_both_places(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "x " + " ".join(w)), (3, " ".join(w[:30]) + " other words")], "_id long, _text string")
    good, wrong = (2, 1, 21, 1, 0), (3, 0, 13, 1, 0)  # the second claims two words too many
    paths, _ = substring.stored(spark.createDataFrame([good, wrong, (3, 0, 11, 1, 0)], "id long, a int, n int, src_id long, src_a int"), "test")
    assert sorted(tuple(r) for r in substring.verified(docs, paths).collect()) == [good, (3, 0, 11, 1, 0)]


def test_paths_compact_without_a_join(spark):
    # a chain of three, one with a gap, a branch to another source, another diagonal
    edges = [(5, 0, 4, 1, 10), (5, 4, 2, 1, 14), (5, 6, 1, 1, 16), (5, 9, 3, 1, 19), (5, 12, 3, 2, 0), (5, 15, 2, 2, 4), (6, 7, 2, 5, 7)]
    paths = substring.compact(spark.createDataFrame(edges, "id long, a int, n int, src_id long, src_a int"))
    assert sorted(tuple(r) for r in paths.collect()) == [(5, 0, 7, 1, 10), (5, 9, 3, 1, 19), (5, 12, 3, 2, 0), (5, 15, 2, 2, 4), (6, 7, 2, 5, 7)]
    assert "Join" not in paths._jdf.queryExecution().executedPlan().toString()


def test_substring_without_broadcasts(spark, docs, frame, monkeypatch):
    monkeypatch.setattr(substring, "split_by_ids", lambda *a: None)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["rest"]) for r in substring.dedup_substrings(spark, frame).collect()}
    assert got == X.plain_substring(docs)


@pytest.mark.parametrize("group", [1, 300])
def test_suffix(spark, docs, frame, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)  # 1: every group is split down to single windows
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["rest"].decode()) for r in suffix.dedup_bytes(spark, frame).collect()}
    assert got == X.plain_bytes(docs)


@pytest.mark.parametrize("seed", range(5))
def test_suffix_order_is_sorted(seed):
    r = np.random.default_rng(seed)
    data = np.append(r.integers(97, 97 + seed + 1, 400), 0).astype(np.uint8)
    order = suffix.suffix_order(data, 400)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t, "x"), (1, t, "x"), (2, t + " end", "x"), (None, "start " + t, "x"), (2, "other", "x")]
    f = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.dedup_substrings(spark, f).collect()), key=str)
    # the null key comes first and keeps its words
    assert got == sorted([(None, 61, 0), (1, 60, 60), (1, 60, 60), (2, 61, 60), (2, 1, 0)], key=str)
    removed = sorted((r["n_bytes"], r["n_removed"]) for r in suffix.dedup_bytes(spark, f, window=200).collect())
    assert len(removed) == 5
    assert len(simhash.near_duplicates(f).collect()) == 5
    assert len(licenses.scan(f).collect()) == 5
    assert len(packing.pack(f, _tokens.default_path()).collect()) == 5
    assert len(outliers.judge(f.selectExpr("doc_id", "text", "n_words", "'a' lang", "'b' source")).collect()) == 5
    assert len(decontaminate.find_contamination(f, f.selectExpr("doc_id item_id", "text")).collect()) == 5


def test_empty_tables(spark, frame):
    none = frame.where("false")
    assert substring.dedup_substrings(spark, none).count() == 0
    assert suffix.dedup_bytes(spark, none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert outliers.judge(none).count() == 0
    assert packing.pack(none, _tokens.default_path()).count() == 0
    assert weaklabel.classify(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(frame, bench).where("n_hit > 0").count() == 0
    assert urltree.judge(spark.createDataFrame([], "page_id long, url string, bad int")).count() == 0


def test_contamination(spark, docs, frame, monkeypatch):
    items = [(1, docs[0][1]), (2, "one very common line"), (3, ""), (4, None), (5, "never seen words " * 5), (6, "X"), (6, " ".join((docs[5][1] or "").split()[3:14]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = X.plain_contamination(docs, items)
    for size in (1_000_000, 0):  # with lists of test fingerprints, then all are joined
        monkeypatch.setattr(decontaminate, "LIST_ROWS", size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(frame, bench).collect()}
        assert got == want


def test_simhash(spark, docs, frame, monkeypatch):
    want = X.plain_simhash(docs)
    for slot in (4096, 2):  # plain keys, then all dealt out to slots
        monkeypatch.setattr(simhash, "SLOT", slot)
        got = {r["doc_id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(frame).collect()}
        assert got == want


def test_links_within_radius():
    r = np.random.default_rng(0)
    f = r.integers(0, 2**63, 40).astype(np.uint64)
    f = np.concatenate([f, f[:20] ^ np.uint64(0b1111), f[:20] ^ np.uint64(0b11111)])
    u, v = simhash.links(np.zeros(len(f), int), f)
    assert (np.bitwise_count(u ^ v) <= 4).all()
    linked = {frozenset((int(a), int(b))) for a, b in zip(u, v)}
    assert all(frozenset((int(x), int(x ^ np.uint64(15)))) in linked for x in f[:20])


def test_xxh64_of_all_lengths():
    import xxhash

    raw = bytes(np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8))
    data = np.frombuffer(raw, np.uint8)
    size = np.arange(0, 140)
    have = simhash.xxh64(data, size % 7, size)
    assert have.tolist() == [xxhash.xxh64_intdigest(raw[s % 7 : s % 7 + s], 42) for s in size.tolist()]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(e).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_statistics(spark, docs, frame):
    got = {r["doc_id"]: tuple(r)[1:6] for r in outliers.judge(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {d[0]: X.plain_statistics(d[1]) for d in docs}


def test_outliers_are_found_and_the_rest_kept(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join("".join(r.choice(list("abcde"), r.integers(2, 8))) for _ in range(120)), "en", "s") for i in range(80)]
    rows += [(100 + i, " ".join("".join(r.choice(list("abcde"), 5)) + "%%%" for _ in range(120)), "en", "s") for i in range(5)]
    got = {x["doc_id"]: x["kept"] for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(80)) and not any(got[100 + i] for i in range(5))


def test_chi_square():
    assert abs(outliers.chi2_quantile(0.95, 4) - 9.4877) < 1e-3


def test_tokens_are_those_of_whole_texts(docs, plain_ids):
    e = _tokens.Encoder(_tokens.default_path(), units=40)
    assert not e.whole
    r = random.Random(4)
    odd = ["".join(r.choice("ab Z'\n.,1\t\u00e9\u00a0\u3000\u65e5\x1c\x85\u0394\u0301") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts = [d[1] for d in docs] + odd + ["x" * 5000 + " " + "y," * 3000, "a  b", " lead", "it's 'so'", "word.\nNext, word's", "日B's"]
    texts += ["<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|><|endoftext|>b", "<|endoftext|>", "no <|endof text|> here"]
    for _ in range(2):  # the second time from the caches
        for some in (texts[:30], texts[30:]):
            ids, at = e.encode(pa.array(some, pa.string()))
            have = [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]
            assert have == [plain_ids(t) for t in some]


def test_words_of_letters_need_the_model_only(plain_ids, monkeypatch):
    e = _tokens.Encoder(_tokens.default_path())
    texts = ["Plain words only words", "Zq aB", "", None]
    monkeypatch.setattr(e, "_raw", None)  # what cuts texts is not called
    ids, at = e.encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [plain_ids(t) for t in texts]


def test_files_that_change_letters_are_encoded_by_their_rules(tmp_path):
    texts = ["Plain WORDS only", "it's Two\nlines", " Zq"]
    for k, change in enumerate((lambda t: setattr(t, "normalizer", tokenizers.normalizers.Lowercase()), lambda t: setattr(t, "pre_tokenizer", tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=True)))):
        own = tokenizers.Tokenizer.from_file(_tokens.default_path())
        change(own)
        own.save(path := f"{tmp_path}/{k}.json")
        ids, at = _tokens.Encoder(path).encode(pa.array(texts))
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_guide_of_the_decoder_finds_every_id():
    r = np.random.default_rng(8)
    model = rangecoder.Model(5000)
    for ids in (r.integers(0, 5000, 9000), np.full(4000, 4999), r.zipf(1.3, 90_000) % 5000):
        model.missed.append(ids)
        model._refresh()
        goal = np.concatenate((r.integers(0, model.total, 5000), [0, model.total - 1], model.below[:-1], model.below[1:] - 1)).astype(model.kind)
        assert np.array_equal(model._locate(goal), np.searchsorted(model.below, goal, side="right") - 1)


def test_added_tokens_in_packed_and_written_texts(spark, plain_ids, tmp_path):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "plain words", None, "many " * 900 + "<|endoftext|>" * 300]
    want = {i: np.array([*plain_ids(t), 2], "<u4") for i, t in enumerate(texts)}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    length = {}
    for r in packing.pack(frame, _tokens.default_path()).collect():
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
    assert length == {i: len(v) for i, v in want.items()} and length[0] == 5
    rangecoder.write_ids(frame, f"file://{tmp_path}/marked", _tokens.default_path())
    got = {r["doc_id"]: bytes(r["ids"]) for r in rangecoder.read_ids(spark, f"file://{tmp_path}/marked").collect()}
    assert got == {i: v.tobytes() for i, v in want.items()}


@pytest.mark.parametrize("n", [0, 1, 3, 255, 256, 3000, 40_000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.where(r.uniform(size=n) < 0.5, 7, r.integers(0, 50257, n)).astype("<u4")
    raw = rangecoder.encode_block([5, None], [n, 0], ids, 50257)
    keys, counts, back = rangecoder.decode_block(raw)
    assert keys == [5, None] and counts.tolist() == [n, 0] and (back == ids).all()
    if n > 1000:
        bad = bytearray(raw)
        bad[-9] ^= 4
        with pytest.raises(ValueError):
            rangecoder.decode_block(bytes(bad))


def test_blocks_are_smaller_than_order_0_entropy():
    """Predictions of order 1 and 2 must gain on the best code without context."""
    import duckdb

    texts = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    ids, _ = _tokens.encoder(_tokens.default_path()).encode_with_end(pa.array([t for (t,) in texts]), 2)
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    raw = rangecoder.encode_block([1], [len(ids)], ids, 50257)
    assert 8 * len(raw) < 0.95 * len(ids) * -(share * np.log2(share)).sum()


def test_files_round_trip(spark, docs, frame, plain_ids, tmp_path):
    path = f"file://{tmp_path}/ids"
    rangecoder.write_ids(frame, path, _tokens.default_path(), block_tokens=3000)
    rows = {r["doc_id"]: r for r in rangecoder.read_ids(spark, path).collect()}
    at = 0
    for d in docs:
        ids = np.array([*plain_ids(d[1]), 2], "<u4").tobytes()
        r = rows[d[0]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(tokens=64, documents=3, score="dot"), packing.Capacity(tokens=100, attention=5200)])
def test_plan_respects_every_capacity(cap):
    r = np.random.default_rng(3)
    hist = {int(k): int(v) for k, v in zip(*np.unique(r.integers(1, 60, 3000), return_counts=True))}
    bins, placed = {}, {k: set() for k in hist}
    for length, lo, hi, seq, offset in packing.plan(hist, cap):
        for k in range(lo, hi):
            assert k not in placed[length]
            placed[length].add(k)
            bins.setdefault(seq + k - lo, []).append((offset, length))
    assert all(len(placed[k]) == n for k, n in hist.items())
    for items in bins.values():
        items.sort()
        assert len(items) <= cap.documents and sum(n * n for _, n in items) <= cap.attention
        at = 0
        for offset, n in items:
            assert offset == at
            at += n
        assert at <= cap.tokens


def test_packing(spark, docs, frame, plain_ids):
    ids = {d[0]: np.array([*plain_ids(d[1]), 2], "<u4").tobytes() for d in docs}
    pieces, bins = {}, {}
    for r in packing.pack(frame, _tokens.default_path()).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    for d, rows in pieces.items():
        rows.sort(key=lambda r: r["piece"])
        assert b"".join(ids[d][4 * r["start"] : 4 * (r["start"] + r["length"])] for r in rows) == ids[d]
        assert all(zlib.crc32(ids[d][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in rows)
        assert all(r["length"] == 1024 for r in rows[1:])
    for rows in bins.values():
        rows.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in rows])
        assert ends[-1] <= 1024 and [r["offset"] for r in rows] == [0, *ends[:-1].tolist()]
    total = sum(len(v) // 4 for v in ids.values())
    assert len(bins) <= -(-total // 1024) + 2


def test_url_rules_and_templates(spark):
    rows = [(i, f"http://a.example.org/good/{i}", 0) for i in range(40)] + [(100 + i, f"http://a.example.org/bad/{i}.html", 1) for i in range(40)]
    rows += [(200, None, None), (201, "no scheme", 1), (202, "http://X.COM/en/1", None), (203, "http://example.com/en/7?x", None), (204, "http://b.example.net/de/8", None), (205, "http://xorg/es/", None), (206, "http://a.example.org/bad/999.html#t", None)]
    got = {r["page_id"]: r for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).collect()}
    assert (got[200]["host"], got[200]["path"], got[200]["rule"], got[200]["verdict"]) == ("", "", None, "allow")
    assert (got[202]["host"], got[202]["rule"], got[202]["verdict"]) == ("x.com", "com/en/", "block")
    assert (got[203]["rule"], got[203]["verdict"]) == ("example.com/en/7", "allow")
    assert (got[204]["rule"], got[204]["verdict"]) == ("example.net/de/8", "block")
    assert got[205]["rule"] is None
    assert got[206]["verdict"] == "block" and got[3]["verdict"] == "allow" and got[103]["verdict"] == "block"


def test_of_equally_long_rules_the_first_wins(spark):
    from pyspark.sql import functions as F

    pair = [("block", "b.c", "/x"), ("allow", "c", "/x/y")]
    for rules in (pair, pair[::-1]):
        name, verdict = urltree.rule_of(F.lit("a.b.c"), F.lit("/x/yz"), [*rules, ("block", "c", "/")])
        r = spark.range(1).select(name.alias("n"), verdict.alias("v")).first()
        assert (r["n"], r["v"]) == (rules[0][1] + rules[0][2], rules[0][0])


def test_a_bad_branch_is_found_deep_in_the_tree_and_among_many_sections(spark):
    rows, i = [], 0
    for section in range(70):  # more sections than any share of siblings would keep
        for k in range(33):
            i += 1
            bad = int(section == 41)
            rows.append((i, f"http://one.example.org/s{section}/a/b/c/d/{'evil' if bad else 'good'}/{k}.html", bad if k < 30 else None))
    for k in range(40):  # bad at the sixth level only
        i += 1
        rows.append((i, f"http://two.example.org/a/b/c/d/e/{'x' if k % 2 else 'y'}/f/{k}", k % 2))
    got = {r["page_id"]: r["verdict"] for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).collect()}
    assert all((got[n] == "block") == ("evil" in u or "/x/" in u) for n, u, _ in rows)


def test_licenses(spark, docs, frame):
    got = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    for i, t, *_ in docs:
        w = X.words(t, X.ALNUM, True)
        at = [(label, s) for phrase, label in licenses.PHRASES for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
        places = [s for _, s in at]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for x, _ in at}))
    rows = [(1, "This work is\nlicensed under CC BY-NC 4.0 ok"), (2, "licensed under the Apache License, Version 2.0"), (3, "licensed apache under version the 2 license 0"), (4, "nothing")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "cc-by-nc-4.0" and got[2]["labels"] == "apache,apache-2.0" and got[3]["labels"] == "" and got[4]["score"] == 0.0


def test_expectation_maximisation_recovers_accuracies():
    r = np.random.default_rng(0)
    truth = r.uniform(size=6000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.85])
    v = np.where(r.uniform(size=(6000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[r.uniform(size=v.shape) < 0.3] = weaklabel.NO_VOTE
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    q, accuracy, share = weaklabel.em(patterns, counts.astype(float))
    assert np.abs(accuracy.mean(axis=1) - right).max() < 0.08 and abs(share - 0.3) < 0.06


def test_classifier_catches_held_out_bad_documents(spark):
    r = np.random.default_rng(2)
    vocab = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(300)]

    def text(toxic):
        w = r.choice(vocab, 80).tolist()
        if toxic:
            for k in r.integers(0, 80, 3):
                w[k] = str(r.choice(["vexor", "grimly", "stupid"]))
        return " ".join(w)

    truth = {i: int(r.uniform() < 0.3) for i in range(900)}
    frame = spark.createDataFrame([(i, text(t)) for i, t in truth.items()] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in truth.items() if i < 600], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in weaklabel.classify(frame, labels).collect()}
    held = [i for i in truth if i >= 600]
    assert np.mean([not got[i] for i in held if truth[i]]) > 0.95
    assert np.mean([got[i] for i in held if not truth[i]]) > 0.99
    assert len(got) == 902


def test_words_at_row_borders():
    data = np.frombuffer(b"ab cdef  gh", np.uint8)
    s, e, per = K.words(data, np.array([0, 4, 4, 9, 11]), K.SPACE_WORD)
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == [b"ab", b"c", b"def", b"gh"] and per.tolist() == [0, 2, 2, 3, 4]


def test_texts_longer_than_a_slice(spark, plain_ids):
    """One text of 700 KB, longer than any run of rows that is handled at once, beside a short copy of its middle."""
    r = random.Random(6)
    w = [f"v{r.randrange(30_000)}" for _ in range(110_000)]
    docs = [(1, " ".join(w), "en", "s", 1), (2, " ".join(w[50_000:50_200]), "en", "s", 1), (3, "short", "en", "s", 1)]
    f = spark.createDataFrame(docs, X.SCHEMA)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.dedup_substrings(spark, f).collect()} == {1: (110_000, 0), 2: (200, 200), 3: (1, 0)}
    removed = {r["doc_id"]: r["n_removed"] for r in suffix.dedup_bytes(spark, f).collect()}
    assert removed[2] <= removed[1] <= removed[2] + 2  # the blanks around may repeat too
    assert removed[2] == len(docs[1][1].encode()) and removed[3] == 0
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_contamination(f, f.where("doc_id = 2").selectExpr("doc_id item_id", "text")).collect()}
    assert hits == {1: 200, 2: 200, 3: 0}
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan(f).collect()} == {1: 110_000, 2: 200, 3: 1}
    assert {r["doc_id"]: r["n_words"] for r in outliers.judge(f).collect()} == {1: 110_000, 2: 200, 3: 1}
    want = X.plain_simhash(docs)
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(f).collect()} == want
    assert weaklabel.classify(f).count() == 3
    n = len(plain_ids(docs[0][1])) + 1
    pieces = [r for r in packing.pack(f, _tokens.default_path()).collect() if r["doc_id"] == 1]
    assert len(pieces) == -(-n // 1024) and sum(r["length"] for r in pieces) == n
