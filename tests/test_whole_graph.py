"""Queries without SQL rank the whole graph of events."""

import os

import pytest

from palio.plans import inputs as I
from palio.plans import queries, reports  # noqa: F401  register their queries
from palio.plans import registry as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["rnk01_spring_rank", "rnk04_btl", "rnk10_svd_rs", "rnk14_dimpa_forward"])
def test_every_node_has_a_score(spark, name):
    e = I.h2h_edges(spark, SF)
    nodes = {r[0] for r in e.select("src").union(e.select("dst")).distinct().collect()}
    assert {r["node"] for r in Q.QUERIES[name](spark, SF).collect()} == nodes


def test_largest_component_by_brute_force(spark):
    graphs = {}
    for r in I.match_edges(spark, SF).collect():
        graphs.setdefault(r["dataset"], []).append((r["src"], r["dst"]))
    want = set()
    for dataset, edges in graphs.items():
        label = {n: n for e in edges for n in e}
        again = True
        while again:
            again = False
            for a, b in edges:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    again = True
        roots = list(label.values())
        largest = max(set(roots), key=lambda r: (roots.count(r), -r))
        want |= {(dataset, *e) for e in edges if label[e[0]] == largest}
    assert {(r["dataset"], r["src"], r["dst"]) for r in Q.QUERIES["grf04_largest_component"](spark, SF).collect()} == want
