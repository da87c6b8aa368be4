"""Upserts by period equal joining and filling all rows, and read and write only what they need."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import ingest as I
from quantloom.plans import upsert as UP
from quantloom.session import scratch_dir

SCHEMA = "instrument string, trade_date date, close double, volume double, pct_chg double, pre_close double"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def rows(rng, dates, share=0.6, gaps=0.3):
    return [(s, d, None if rng.random() < gaps else round(rng.uniform(5, 9), 2), rng.choice([None, 1.0, 2.0]), None, None) for s in "abcdef" for d in dates if rng.random() < share]


def values(df, columns):
    return sorted(str(tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 3])
def test_equals_the_whole_join(spark, seed):
    rng = random.Random(seed)
    old = rows(rng, [day(n) for n in range(0, 400, 3)], gaps=0.6 if seed == 3 else 0.3)
    stored = spark.createDataFrame(old, SCHEMA)
    path = scratch_dir(spark, "panel")
    schema = UP.write_panel(stored, path)
    table = I.fill_derived(stored)
    for dates in ([day(n) for n in range(401, 420)], [day(n) for n in (30, 31, 33, 150, 151, 420)], [day(n) for n in range(-40, -30)]):
        new = spark.createDataFrame([(*r[:4], "x") for r in rows(rng, dates, 0.7)] or [("a", dates[0], 1.0, None, "x")], "instrument string, trade_date date, close double, volume double, note string")
        done = UP.upsert_panel(spark, path, schema, new)
        table = spark.createDataFrame(I.fill_derived(I.upsert_combine_first(new, table)).collect(), table.schema.add("note", "string") if "note" not in table.columns else table.schema)
        schema = done.schema
        assert values(UP.read_panel(spark, path, schema), table.columns) == values(table, table.columns)


def test_reads_and_writes_only_what_it_needs(spark):
    old = [(s, day(n), 5.0 + n % 7, 1.0, None, None) for s in "ab" for n in range(0, 700)] + [("c", day(n), None if n < 600 else 1.0, 1.0, None, None) for n in range(0, 700)]
    path = scratch_dir(spark, "panel")
    schema = UP.write_panel(spark.createDataFrame(old, SCHEMA), path)
    assert len(UP.stored_periods(spark, path)) == 23
    # the last month and a new one: nothing before is needed but one row for lag, which is in the last month
    new = spark.createDataFrame([("a", day(n), 9.0) for n in range(698, 702)], "instrument string, trade_date date, close double")
    done = UP.upsert_panel(spark, path, schema, new)
    assert done.written == {"2021-11", "2021-12"} and done.read <= {"2021-11", "2021-12", "2021-10"}
    # a close of an instrument that had none reaches forward to its next close, a year and a half on
    new = spark.createDataFrame([("c", day(40), 3.0)], "instrument string, trade_date date, close double")
    done = UP.upsert_panel(spark, path, done.schema, new)
    assert min(done.written) == "2020-02" and max(done.written) == "2021-08"
    got = {r.trade_date: r for r in UP.read_panel(spark, path, done.schema).where("instrument = 'c'").collect()}
    assert got[day(41)].pre_close == 3.0 and got[day(600)].pre_close == 3.0 and got[day(600)].pct_chg == pytest.approx((1 / 3 - 1) * 100) and got[day(601)].pre_close == 1.0 and got[day(40)].pre_close is None
    # of instruments whose neighbours have closes, the neighbouring months are enough
    new = spark.createDataFrame([("a", day(320), 4.0), ("b", day(321), None)], "instrument string, trade_date date, close double")
    done = UP.upsert_panel(spark, path, done.schema, new)
    assert done.written == {"2020-11"} and done.read <= {"2020-10", "2020-11", "2020-12"}
    plan = UP.read_panel(spark, path, done.schema, ["2020-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and len(UP.read_panel(spark, path, done.schema, ["2020-02"]).where(F.col("period") == "2020-02").inputFiles()) > 0
