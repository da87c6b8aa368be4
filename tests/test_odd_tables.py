"""Queries against their SQL on small tables with odd rows."""

import datetime as dt

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from quantloom.session import scratch_dir


def equal_to_sql(spark, name, path):
    """Whether a query's rows are those of its SQL over the tables at path."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("lineitem", "events"):
        con.execute(f"create view {table} as select * from read_parquet('{path.removeprefix('file://')}/{table}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    plain = lambda x: str(x)[:10] if hasattr(x, "year") else x if x is None or isinstance(x, (str, bool)) else str(float(x) + 0.0)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=str)
    got = rows(entry.queries()[name](spark, path).select(*columns).collect())
    assert got, "no rows"
    return got == rows(want.fetchall())


@pytest.fixture(scope="module")
def tables(spark):
    path = scratch_dir(spark, "odd")
    # suppliers 1 and 1001 share the code 688001; their bars are on different dates and far apart in price
    lines = [(n, 1, s, 1, 10.0, 10.0 * price, 0.01, 0.02, dt.datetime(2000, 1, d)) for n, (s, d, price) in enumerate([(1, 3, 10.0), (1001, 4, 500.0), (1, 5, 12.0), (1001, 6, 510.0), (1, 7, 11.0), (1, 10, 13.2), (1001, 11, 520.0)])]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{path}/lineitem.parquet")
    # user 1 has prices of zero within a day, twice in a row too; the last price of user 2's first day is zero, the first late one of the second
    ticks = {
        (1, 2): [3.0, 0.0, 2.0, 5.0, 4.0, 6.0], (1, 3): [1.0, 0.0, 0.0, 2.0, 3.0, 2.0], (1, 4): [2.0, 3.0, 4.0, 5.0, 6.0, 8.0], (1, 5): [7.0, 3.0, 5.0, 6.0, 2.0, 8.0],
        (2, 2): [3.0, 4.0, 2.0, 5.0, 4.0, 0.0], (2, 3): [3.0, 4.0, 2.0, 0.0, 4.0, 5.0], (2, 4): [2.0, 3.0, 4.0, 1.0, 6.0, 5.0],
        (3, 2): [1.0, 4.0, 2.0, 5.0, 3.0, 2.0], (3, 3): [6.0, 4.0, 2.0, 3.0, 4.0, 5.0], (3, 4): [2.0, 9.0, 4.0, 1.0, 6.0, 3.0],
    }
    rows = [(u, d, i, v) for (u, d), values in ticks.items() for i, v in enumerate(values)]
    events = [(n, dt.datetime(2024, 1, d, 4 * i, 7 * i), u, v, f'{{"k": {1 + (3 * n) % 5}}}') for n, (u, d, i, v) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{path}/events.parquet")
    return path


def test_instruments_that_share_a_code_keep_their_own_closes(spark, tables):
    assert equal_to_sql(spark, "board_limits", tables)


@pytest.mark.parametrize("name", ["jump_beta", "realized_moments", "realized_moments_5m", "rolling_within_day", "intraday_momentum", "stability", "tail_momentum", "vol_ratio", "vol_ratio_zscore"])
def test_prices_of_zero_give_what_the_sql_gives(spark, tables, name):
    assert equal_to_sql(spark, name, tables)
