import os

import __spark_entry__ as entry
import pytest

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 2 and "ic_mean" in df.columns


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["daily_ic", "decile_returns_daily", "asof_rows", "realized_moments", "upsert_combine_first"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SMALL}/{t}'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert _rows(got) == _rows(want)


def _rows(d):
    """Rows as sorted tuples of comparable values, columns by name."""
    plain = lambda x: str(x)[:10] if hasattr(x, "year") else None if x is None or x != x else float(x) if isinstance(x, (int, float)) else x
    return sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
