"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from palio.plans import queries, reports  # noqa: F401  register their queries
from palio.plans import registry as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(float(v), 4) if isinstance(v, float) else str(v) if not hasattr(v, "item") else float(v) for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    have, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLE[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert len(have) == len(want)
    cols = sorted(have.columns)
    a, b = have.sort_values(cols, ignore_index=True)[cols], want.sort_values(cols, ignore_index=True)[cols]
    for c in cols:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            gap = (a[c].astype(float) - b[c].astype(float)).abs()
            assert (gap.isna() == (a[c].isna() | b[c].isna())).all() and (gap.fillna(0) < 1e-4).all(), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() > 0
