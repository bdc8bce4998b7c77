"""Every registered query with SQL against DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from cellweave.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    try:
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    out = con.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in out.fetchall())
    assert got == want and got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_band_join_of_all_libraries(spark):
    """Each library's pairs against brute force."""
    from cellweave.plans.views import view

    reads = view(spark, SF, "reads").select("sm", "contig", "ds", "is_reverse").collect()
    want = sorted((a.sm, a.contig, a.ds, b.ds) for a in reads if not a.is_reverse for b in reads if b.is_reverse and a.sm == b.sm and a.contig == b.contig and 0 < b.ds - a.ds < 300)
    got = sorted(tuple(r) for r in QUERIES["band_join"](spark, SF).select("sm", "contig", "fwd", "rev").collect())
    assert got == want and {r[0][:4] for r in got} == {"LIB0", "LIB1", "LIB2"}
