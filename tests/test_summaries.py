"""Mergeable summaries equal windows over whole series, however they are cut."""

import datetime as dt

import numpy as np
import pytest

from quantloom.operators import evaluate as E, summaries as SU


def series(spark, seed, days=900):
    rng = np.random.default_rng(seed)
    rows = [(f, dt.date(2018, 1, 1) + dt.timedelta(days=int(d)), float(rng.normal(0, 0.05))) for f, share in (("a", 0.8), ("b", 0.02), ("c", 0.5)) for d in range(days) if rng.random() < share]
    return spark.createDataFrame([*rows, ("one", dt.date(2019, 5, 5), -0.3), ("up", dt.date(2019, 5, 5), 0.3), ("up", dt.date(2019, 5, 6), 0.3)], "factor_name string, trade_date date, ls double").repartition(3)


@pytest.mark.parametrize("cut", [dt.date(2010, 1, 1), dt.date(2018, 7, 1), dt.date(2019, 12, 31), dt.date(2030, 1, 1)])
def test_drawdowns_merge(spark, cut):
    ls = series(spark, 5)
    rows = lambda d: {r.factor_name: r.long_short_max_drawdown for r in d.collect()}
    want = rows(E.max_drawdown(ls))
    assert rows(SU.drawdown(SU.drawdown_summary(ls))) == pytest.approx(want)
    stored = SU.drawdown_summary(ls.where(ls.trade_date < cut))
    again = SU.extend_drawdown(stored, ls)  # days that it has already are left out
    assert rows(SU.drawdown(again)) == pytest.approx(want) and want["up"] == 0 and want["one"] == 0
    assert rows(SU.drawdown(SU.extend_drawdown(again, ls))) == pytest.approx(want)


def test_running_sums_go_on_from_stored_ones(spark):
    ls = series(spark, 6)
    pdf = ls.toPandas().sort_values("trade_date")
    want = {(r.factor_name, r.trade_date): c for r, c in zip(pdf.itertuples(), pdf.groupby("factor_name")["ls"].cumsum(), strict=True)}
    rows = lambda d: {(r.factor_name, r.trade_date): r.cum for r in d.collect()}
    whole = SU.running_sums(ls, ["factor_name"], "ls")
    assert rows(whole) == pytest.approx(want)
    cut = dt.date(2019, 3, 3)
    old = SU.running_sums(ls.where(ls.trade_date < cut), ["factor_name"], "ls")
    new = SU.running_sums(ls.where(ls.trade_date >= cut), ["factor_name"], "ls", SU.last_sums(old, ["factor_name"]))
    assert rows(old.unionByName(new)) == pytest.approx(want)


def test_quantiles_of_any_level_and_their_sketches(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from quantloom.operators import windows as W

    rng = np.random.default_rng(11)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), float(x)) for d in range(30) for x in np.round(rng.exponential(3, 700 if d else 5), 2)]
    df = spark.createDataFrame([*rows, (dt.date(2020, 1, 2), None), (dt.date(2021, 1, 1), None)], "trade_date date, x double").repartition(4)
    levels = [0.0, 0.07, 0.5, 0.93, 1.0]
    want = {(d, q): v for d, g in pd.DataFrame(rows, columns=["d", "x"]).groupby("d")["x"] for q, v in zip(levels, g.quantile(levels), strict=True)}
    assert {(r.trade_date, r.level): r.value for r in W.quantiles_cs(df, "x", levels).collect()} == pytest.approx(want)
    months = W.quantile_sketches(df, "x", 200).withColumn("all", F.lit(1))
    got = W.sketch_quantiles(months, levels, ["all"]).collect()
    every = np.sort([x for _, x in rows])
    assert {r.n for r in got} == {len(rows)}
    for r in got:
        below, upto = np.searchsorted(every, r.value, "left") / len(every), np.searchsorted(every, r.value, "right") / len(every)
        assert below <= r.level + 2 * W.rank_error(200) and upto >= r.level - 2 * W.rank_error(200)
    assert 0.012 < W.rank_error(200) < 0.02 and W.rank_error(2000) < 0.003
