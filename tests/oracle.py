"""Compare a query with its SQL on DuckDB."""

import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def compare(spark, con, sf_dir, query, sql):
    want = con.sql(sql).df()
    got = query(spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(want.columns)
    want, got = (x[names].sort_values(names).reset_index(drop=True) for x in (want, got))
    assert len(got) == len(want)
    for c in names:
        a, b = got[c], want[c]
        assert a.dtype.kind == b.dtype.kind, (c, a.dtype, b.dtype)
        assert (a.isna() == b.isna()).all(), c
        bad = (a != b) & a.notna()
        assert not bad.any(), (c, a[bad].head().tolist(), b[bad].head().tolist())
