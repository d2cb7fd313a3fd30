"""Every query on the smallest tables: against SQL where there is some, else against plain versions."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from palio.llm import _tokens, licenses, queries, urltree

from . import fixtures as X

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("select doc_id, text, lang, source, n_chars from documents order by doc_id").fetchall()


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    have, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(have.columns) == cols and len(have) == len(want)
    a, b = (x.sort_values(cols, ignore_index=True)[cols] for x in (have, want))
    for c in cols:
        assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


def test_outliers_query(spark, docs):
    got = rows(spark, "op1_robust_outliers")
    for i, t, *_ in docs:
        n, chars, symbols, lines, repeats = X.plain_statistics(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def ids_of(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(_tokens.default_path())
    return {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, *_ in docs}


def test_range_coder_query(spark, docs):
    got, at = rows(spark, "op2_range_coder"), 0
    for i, ids in sorted(ids_of(docs).items()):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_classifier_query(spark, docs, duck):
    got = rows(spark, "op4_weak_label_classifier")
    assert set(got) == {d[0] for d in docs}
    fine = {i for (i,) in duck.sql("select doc_id from labels group by doc_id having min(quality) = 1 and max(toxic) = 0").fetchall()}
    assert np.mean([got[i]["kept"] for i in fine if i in got]) > 0.97


def test_packing_query(spark, docs):
    ids, bins, pieces = ids_of(docs), {}, {}
    for r in queries.QUERIES["op5_best_fit_packing"](spark, SF).collect():
        bins.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[i])
        assert all(r["length"] == 1024 for r in own[1:])
    assert set(pieces) == set(ids)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own]).tolist()
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= -(-sum(map(len, ids.values())) // 1024) + 3


def test_simhash_query(spark, docs):
    want = X.plain_simhash(docs)
    got = {i: (r["fingerprint"], r["component_id"]) for i, r in rows(spark, "op6_simhash_dedup").items()}
    assert got == {i: (f"{fp:016x}", component) for i, (fp, component) in want.items()}


def test_url_query(spark, duck):
    got = rows(spark, "op7_url_template_tree", "page_id")
    urls = duck.sql("select page_id, url from pages").fetchall()
    assert set(got) == {i for i, _ in urls}
    for i, url in urls:
        host, path, rule, verdict = "", "", None, None
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = host.translate(X.LOWER)
        for v, h, p in sorted(urltree.RULES, key=lambda r: len(r[1] + r[2])):
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                rule, verdict = h + p, v
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_license_query(spark, docs):
    got = rows(spark, "op8_license_scan")
    for i, t, *_ in docs:
        w = X.words(t, X.ALNUM, True)
        at = [(label, s) for phrase, label in licenses.PHRASES for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
        places, base = [s for _, s in at], {x for x, _ in at}
        # every notice that stands there in full is found
        notices = [(label, notice.split()) for label, notice, _ in licenses.NOTICES]
        more = {label for label, n in notices if any(w[s : s + len(n)] == n for s in range(len(w)))}
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(base))
        assert base | more <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 if base else True)


def test_suffix_query(spark, docs):
    want = X.plain_bytes(docs)
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in rows(spark, "op9_suffix_dedup").items()}
    assert got == want
