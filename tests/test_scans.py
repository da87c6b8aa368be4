"""Work by ranges of dates equals the same work on an instrument's whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import scans as SC
from quantloom.plans import user_functions as U


def series(spark, seed=1, days=700, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s, share in (("hot", 1.0), ("b", 0.3), ("c", 0.02), ("none", 0.1)):
        for d in range(days):
            if rng.random() < share:
                x = None if s == "none" or gaps and rng.random() < 0.3 else float("nan") if gaps and rng.random() < 0.05 else float(rng.normal())
                rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=d), x, d, "z"))
    rows.append(("one", dt.date(2021, 1, 1), 2.0, 1, "z"))
    return spark.createDataFrame(rows, "instrument string, trade_date date, close double, seq int, rows string").repartition(3)


@pytest.mark.parametrize(("span", "days"), [(5, 7), (5, 256), (1, 30), (60, 10_000), (20, 1)])
def test_ema_equals_pandas_for_any_range(spark, span, days):
    df = series(spark)
    out = SC.ema(df, "close", span, days=days)
    assert out.columns == [*df.columns, "ema"]
    got = out.toPandas().sort_values(["instrument", "trade_date"]).reset_index(drop=True)
    want = df.toPandas().sort_values(["instrument", "trade_date"]).reset_index(drop=True)
    assert (got["seq"] == want["seq"]).all()
    y = want.groupby("instrument")["close"].transform(lambda x: x.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(got["ema"].to_numpy(float), y.to_numpy(float), rtol=1e-9, equal_nan=True)


def test_ema_spreads_an_instrument_and_needs_no_python(spark):
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        out = SC.ema(series(spark).where("instrument = 'hot'"), "close", 5, days=20)
        assert out.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    finally:
        spark.conf.set(conf, before)
    assert SC.ema(series(spark).limit(0), "close", 5).count() == 0


@pytest.mark.parametrize(("lookback", "days"), [(0, 9), (1, 9), (5, 9), (40, 9), (40, 500), (3, 1)])
def test_halo_is_the_last_rows_before_a_range(spark, lookback, days):
    df = series(spark, 2, 120)
    got = SC.with_halo(df, lookback, days).toPandas()
    rows = df.toPandas().sort_values("trade_date")
    rows["r"] = [(d - dt.date(1970, 1, 1)).days // days for d in rows["trade_date"]]
    want = set()
    for s, g in rows.groupby("instrument"):
        for r in set(g["r"]):
            want |= {(s, d, r, True) for d in g[g["r"] == r]["trade_date"]}
            want |= {(s, d, r, False) for d in g[g["r"] < r]["trade_date"].tolist()[-lookback or len(g) :]}
    assert {*zip(got["instrument"], got["trade_date"], got["_range"], got["_own"], strict=True)} == want and len(got) == len(want)


@pytest.mark.parametrize("days", [1, 9, 64, 10_000])
def test_user_functions_do_not_depend_on_ranges(spark, days):
    df = series(spark, 3, 90).select("instrument", "trade_date", "seq")
    whole = df.toPandas().sort_values(["instrument", "trade_date"])
    by = whole.groupby("instrument")["seq"]
    keyed = lambda out: {(r.factor_name, r.instrument, r.trade_date): r.value for r in out.collect()}
    places = list(zip(whole["instrument"], whole["trade_date"], strict=True))

    def want(name, values):
        return {(name, s, d): v for (s, d), v in zip(places, values, strict=True)}

    got = U.daily_slices(df, lambda rows, day, stock: {"sum": rows["seq"].sum(), "n": len(rows)}, 6, days=days)
    assert got.where("error is not null").count() == 0
    assert keyed(got) == want("sum", by.transform(lambda x: x.rolling(7, 1).sum())) | want("n", by.transform(lambda x: x.rolling(7, 1).count()))
    got = U.daily_series(df, "s", lambda rows, stock: rows["seq"].rolling(12, 1).max(), errors=False, lookback=11, days=days)
    assert keyed(got) == want("s", by.transform(lambda x: x.rolling(12, 1).max()))

    def add(rows, state, stock):
        sums = rows["seq"].cumsum() + (state or 0)
        return sums, int(sums.iloc[-1])

    assert keyed(U.daily_scan(df, "c", add, lambda a, b: a + b, errors=False, days=days)) == want("c", by.cumsum())


def test_failing_ranges_leave_the_others(spark):
    df = series(spark, 3, 90).select("instrument", "trade_date", "seq").where("instrument = 'hot'")
    bad = df.orderBy("trade_date").collect()[40].trade_date

    def f(rows, day, stock):
        if day == bad:
            raise ValueError("bad")
        return {"n": len(rows)}

    out = U.daily_slices(df, f, 3, days=10)
    errors = out.where("error is not null").collect()
    assert [r.error for r in errors] == ["ValueError: bad"] and errors[0].trade_date <= bad and 80 <= out.where("error is null").count() < 90

    def g(rows, state, stock):
        if bad in rows["trade_date"].tolist():
            raise ValueError("bad")
        return rows["seq"] * 0, 0

    out = U.daily_scan(df, "g", g, max, days=10)
    messages = [r.error for r in out.where("error is not null").orderBy("trade_date").collect()]
    assert messages[0] == "ValueError: bad" and len(messages) > 3 and all("a range before it failed: ValueError: bad" in m for m in messages[1:])
    assert 30 <= out.where("error is null").count() <= 40
    with pytest.raises(Exception, match="bad"):
        U.daily_scan(df, "g", g, max, errors=False, days=10).collect()
