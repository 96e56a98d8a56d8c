"""Every query runs on the smallest tables, and agrees with its SQL where it has one."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from tessera.plans import core

QUERIES, ORACLES = core.queries(), core.oracle_sql()


def plain(v):
    return None if v is None else round(float(v), 7) if isinstance(v, float) and not math.isnan(v) else v


def test_entry_has_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in ORACLES:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        r = con.execute(ORACLES[name])
        cols = [x[0] for x in r.description]
        assert sorted(cols) == sorted(df.columns)
        want = [tuple(plain(row[cols.index(c)]) for c in sorted(cols)) for row in r.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
