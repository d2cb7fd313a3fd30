"""The path-template tree against a plain one, level by level."""

import math
import random
import re
from collections import Counter

import pytest

from palio.llm import urltree


def variable(s):
    if re.fullmatch(r"[0-9]+", s):
        return "<number>"
    if re.fullmatch(r"[0-9]+\.[A-Za-z0-9]+", s):
        return "<number>." + s.rsplit(".", 1)[1]
    return "<hex>" if re.fullmatch(r"[0-9a-fA-F-]{8,}", s) else s


def wildcard(s):
    if re.match(r"<(number|hex)", s):
        return s
    return "<name>." + s.rsplit(".", 1)[1] if re.fullmatch(r".+\.[A-Za-z0-9]{1,5}", s) else "<any>"


def plain(pages, settings):
    """(template, labels, rate) of every (host, path) by following each level, then merging from the deepest one up."""
    rows = {}
    for host, path, bad in pages:
        r = rows.setdefault((host, tuple(variable(x) for x in path.split("/") if x)), [0, 0, 0, ()])
        r[0] += 1
        r[1] += bad is not None
        r[2] += bad or 0
    depth = max(len(k[1]) for k in rows)
    for level in range(depth):
        count = Counter()
        for (host, s), r in rows.items():
            if level < len(s):
                count[host, r[3], s[level]] += r[0]
        for (host, s), r in rows.items():
            if level < len(s):
                r[3] += (s[level] if count[host, r[3], s[level]] >= settings.literal_rows else wildcard(s[level]),)
    for level in range(depth - 1, -1, -1):
        n, b, kids = Counter(), Counter(), {}
        for (host, _), r in rows.items():
            if level < len(r[3]):
                at = (host, r[3][:level])
                kids.setdefault(at, set()).add(r[3][level])
                n[at, r[3][level]] += r[1]
                b[at, r[3][level]] += r[2]
        alike = set()
        for at, names in kids.items():
            for o in names if len(names) > 1 else ():
                n1, b1 = n[at, o], b[at, o]
                n2, b2 = sum(n[at, x] for x in names) - n1, sum(b[at, x] for x in names) - b1
                p1, p2 = (b1 + 1) / (n1 + 2), (b2 + 1) / (n2 + 2)
                if abs(p1 - p2) / math.sqrt(p1 * (1 - p1) / (n1 + 2) + p2 * (1 - p2) / (n2 + 2)) < settings.merge_z:
                    alike.add((at, o))
        for (host, _), r in rows.items():
            if level < len(r[3]) and ((host, r[3][:level]), r[3][level]) in alike:
                r[3] = r[3][:level] + ("<merged>",) + r[3][level + 1 :]
    base = (sum(r[2] for r in rows.values()) + 1) / (sum(r[1] for r in rows.values()) + 2)
    hn, hb, tn, tb = Counter(), Counter(), Counter(), Counter()
    for (host, _), r in rows.items():
        hn[host] += r[1]
        hb[host] += r[2]
        tn[host, r[3]] += r[1]
        tb[host, r[3]] += r[2]
    out = {}
    for (host, s), r in rows.items():
        own = (hb[host] + settings.prior * base) / (hn[host] + settings.prior)
        t = (host, r[3])
        out[host, s] = ("/" + "/".join(r[3]), tn[t], (tb[t] + settings.prior * own) / (tn[t] + settings.prior))
    return out


def test_templates_equal_those_of_a_plain_tree(spark):
    rng, pages = random.Random(4), []
    for host in ("a.example.com", "b.example.com", "c.example.com"):
        for _ in range(300):
            size = rng.choice([0, 1, 2, 3, 4, 6])
            path = "".join("/" + rng.choice(["x", "y", "z", "x", "x", "7", "12.html", "deadbeef", "p.html", f"r{rng.randrange(60)}", "<any>"]) for _ in range(size))
            pages.append((host, path, rng.choice([None, 0, 0, int("/y" in path)])))
        pages += [(host, "/deep" * 30 + end, 1) for end in ("/q", "/q", "/q", "/s", "/s/t", "/s")]
        pages += [(host, "/rare" + f"/k{host[0]}" * 40, 0)]
    settings = urltree.Settings()
    frame = spark.createDataFrame([(i, f"http://{h}{p}", b) for i, (h, p, b) in enumerate(pages)], "page_id long, url string, bad int")
    want = plain(pages, settings)
    got = {r["page_id"]: r for r in urltree.judge(frame, rules=[]).collect()}
    assert len(got) == len(pages)
    for i, (h, p, _) in enumerate(pages):
        template, n, rate = want[h, tuple(variable(x) for x in p.split("/") if x)]
        assert (got[i]["template"], got[i]["n_labels"]) == (template, n), p
        assert got[i]["rate"] == pytest.approx(rate, abs=1e-12)
        assert got[i]["verdict"] == ("block" if n >= settings.least and rate >= settings.reject else "allow")


def test_long_paths_take_no_round_of_their_own(spark, monkeypatch):
    from palio.llm import _common

    def rounds(segments):
        written = []
        monkeypatch.setattr(urltree, "stored", lambda df, name: written.append(name) or _common.stored(df, name))
        rows = [(i, f"http://a.example.org/s/{i}", 0) for i in range(50)] + [(50 + i, "http://a.example.org/s" + "/t" * segments, None) for i in range(6)]
        assert urltree.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).count() == 56
        return len(written)

    assert rounds(1000) == rounds(3)
