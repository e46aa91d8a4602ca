import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def test_queries_and_sql_fit():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_own_queries_match_sql(spark):
    import duckdb

    from recollect.plans.oracle import ORACLE_SQL
    from recollect.plans.queries import QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    assert set(QUERIES) == set(ORACLE_SQL)
    for name in QUERIES:
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = con.execute(ORACLE_SQL[name])
        at = [[d[0] for d in want.description].index(c) for c in cols]
        assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name
