"""Every registered query against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from melisma.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = db.execute(sql)
    cols = [x[0] for x in want.description]
    assert sorted(cols) == sorted(df.columns)
    rows = [tuple(plain(v) for _, v in sorted(zip(cols, r, strict=True))) for r in want.fetchall()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def outer_order(sql: str) -> bool:
    """Whether a statement's own rows are ordered (not only those of a subquery or window)."""
    depth, flat = 0, []
    for c in sql:
        depth += (c == "(") - (c == ")")
        flat.append(c if depth == 0 and c not in "()" else " ")
    return "ORDER BY" in "".join(flat)


ORDERED = sorted(k for k, v in registry.oracle_sql().items() if outer_order(v) and k != "srt07_locale_sort")


@pytest.mark.parametrize("name", ORDERED)
def test_order(spark, db, name):
    df = registry.queries()[name](spark, SF)
    want = db.execute(registry.oracle_sql()[name])
    place = [df.columns.index(x[0]) for x in want.description]
    assert [[plain(r[i]) for i in place] for r in df.collect()] == [[plain(v) for v in r] for r in want.fetchall()]


def test_some_queries_are_ordered():
    assert {"srt01_mixed_sort", "srt03_nullable_sort", "srt05_timeline_page", "agg06_decades"} <= set(ORDERED)


def test_period_reaches_the_scan(spark):
    plan = registry.queries()["srt05_timeline_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
