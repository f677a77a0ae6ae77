"""Every query with SQL against DuckDB on the tables of sf0.01."""

import glob
import math
import os

import duckdb
import pytest

from gridweave.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}".replace("-0.000000", "0.000000") if hasattr(v, "__float__") else str(v)


def rows(records, names):
    return sorted(tuple(plain(r[n]) for n in sorted(names)) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    cur = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert rows([r.asDict() for r in df.collect()], names) == rows(want, names)


@pytest.mark.parametrize("name", ["moran_null", "join_count_null", "patch_null", "hsmm_decode", "lda_topics", "hotspots", "emergent_clusters"])
def test_query_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 0
