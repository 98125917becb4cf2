from __future__ import annotations

import duckdb
import pytest

from tessera.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(r[n]) for n in names) for r in values), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    con.sql("set timezone = 'UTC'")
    wanted = con.sql(ORACLE[name])
    names = sorted(wanted.columns)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == names
    expected = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, expected)
