"""The subpackage's queries run over the smallest tables."""

import glob
import os

import pytest

from tessera.llm import bpe, queries

QUERIES = queries.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name.startswith(("p8", "p9")) and not os.path.exists(bpe.VOCABULARY):
        pytest.skip("no vocabulary here")
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})
    if name in queries.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        assert sorted(map(tuple, rows)) == sorted(con.execute(queries.oracle_sql()[name]).fetchall())
