"""Hand-made panels with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.operators import evaluate as E, ingest as I, minute as M, panel_joins as J, quality as Q, risk as R, windows as W
from quantloom.plans import events as EV, factors as P, incremental as N, user_functions as U, walk_forward as WF
from quantloom.sources import panels as S


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def panel(spark, stocks=3, days=6, seed=1, skip=()):
    rng = np.random.default_rng(seed)
    rows = [(str(s), day(d), float(rng.uniform(5, 15)), float(rng.integers(1, 100)), float(rng.uniform(0, 1))) for s in range(1, stocks + 1) for d in range(days) if (s, d) not in skip]
    return spark.createDataFrame(rows, "instrument string, trade_date date, close double, volume double, turnover_rate double")


def long(spark, values, rets=None, date=0, name="f"):
    rows = [(name, day(date), str(i), None if v is None else float(v), float((rets or values)[i] or 0)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "factor_name string, trade_date date, instrument string, value double, ret_next double")


def test_codes(spark):
    df = spark.createDataFrame([("000001",), ("1",), ("300725",), ("0",)], "c string").select(C.strip_code(F.col("c")).alias("s"), C.pad_code(F.col("c")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [("1", "000001"), ("1", "000001"), ("300725", "300725"), ("0", "000000")]


def test_finite_and_ic_of_constants(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,), (math.nan,), (None,)], "x double").select(C.finite(F.col("x")).alias("x"))
    assert [r.x for r in df.collect()] == [1.0, None, None, None, None]
    assert E.daily_ic(long(spark, [2, 2, 2, 2], [1, 2, 3, 4])).first().ic is None
    assert E.daily_ic(long(spark, [1, 2])).count() == 0


@pytest.mark.parametrize("n,want", [(10, [1] * 10), (11, [2] + [1] * 9), (15, [2, 1, 2, 1, 2, 1, 1, 2, 1, 2]), (101, None)])
def test_decile_sizes_equal_pandas(spark, n, want):
    got = W.decile(long(spark, list(range(n)))).groupBy("decile").count().orderBy("decile").collect()
    sizes = [r["count"] for r in got]
    bins = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False).value_counts().sort_index().tolist()
    assert sizes == bins and (want is None or sizes == want)


def test_deciles_need_ten_rows_and_break_ties_by_instrument(spark):
    assert E.decile_returns_daily(long(spark, list(range(9)))).count() == 0
    ties = W.rank_first(long(spark, [1] * 12)).orderBy("rank").select("instrument").collect()
    assert [r[0] for r in ties] == sorted(map(str, range(12)))


def test_ic_against_pandas(spark):
    rng = np.random.default_rng(3)
    v, r = rng.integers(0, 5, 40).tolist(), rng.standard_normal(40).tolist()
    df = long(spark, v, r)
    assert E.daily_ic(df).first().ic == pytest.approx(pd.Series(v).corr(pd.Series(r)))
    assert E.daily_rank_ic(df).first().rank_ic == pytest.approx(pd.Series(v).rank().corr(pd.Series(r).rank()))


def test_drawdown_and_summary(spark):
    ls = spark.createDataFrame([("f", day(i), x) for i, x in enumerate([0.1, -0.2, 0.05])], "factor_name string, trade_date date, ls double")
    assert E.max_drawdown(ls).first().long_short_max_drawdown == pytest.approx(-0.2)
    s = E.long_short_summary(ls).first()
    assert s.long_short_sharpe == pytest.approx(np.mean([0.1, -0.2, 0.05]) / np.std([0.1, -0.2, 0.05], ddof=1) * 252**0.5)
    one = E.ic_summary(spark.createDataFrame([("f", day(0), 0.3)], "factor_name string, trade_date date, ic double")).first()
    assert one.ic_std == 0 and one.ic_ir is None


def test_next_return_drops_last_row(spark):
    df = panel(spark, 1, 3)
    close = [r.close for r in df.orderBy("trade_date").collect()]
    got = [r.ret_next for r in W.next_return(df).orderBy("trade_date").collect()]
    assert got == pytest.approx([close[1] / close[0] - 1, close[2] / close[1] - 1])


def test_asof_has_rows_on_suspended_days(spark):
    df = panel(spark, 3, 6, skip={(2, 4)})
    out = J.asof_rows(df, S.calendar_of(df)).where("instrument = '2'").orderBy("trade_date").collect()
    assert len(out) == 6 and out[4].bar_date == day(3) and out[4].close == out[3].close


def test_lookback_frames(spark):
    df = panel(spark, 1, 8).join(S.calendar_of(panel(spark, 1, 8)), "trade_date")
    n = F.count(F.lit(1))
    got = df.select("trade_date", *[n.over(J.lookback_frame(k, m)).alias(f"{k}{m}") for k, m in (("daily", 2), ("cross_section", 2), ("cross_section", 0), ("minute", 0), ("minute", 500))]).orderBy("trade_date").collect()[-1]
    assert tuple(got)[1:] == (3, 2, 8, 1, 8)


def test_merge_and_keep_last(spark):
    df = spark.createDataFrame([("1", day(0), 1, None, 2.0), ("1", day(0), 2, 3.0, None), ("1", day(0), 3, 4.0, 5.0)], "instrument string, trade_date date, o int, a double, b double")
    assert tuple(I.merge_dup_dates(df, ["o"]).first())[2:] == (3.0, 2.0)
    assert tuple(I.dedup_keep_last(df, I.KEYS, ["o"]).first())[2:] == (3, 4.0, 5.0)
    assert not I.no_duplicates(df) and I.duplicate_report(df).first().duplicates == 2


def test_reconcile(spark):
    df = spark.createDataFrame([("1", day(0), 10.0), ("000001", day(0), 11.0), ("000001", day(1), 12.0), ("000007", day(0), 1.0), ("300725", day(0), 2.0)], "instrument string, trade_date date, close double")
    out, dropped = I.reconcile_codes(df, [])
    assert sorted((r.instrument, r.close) for r in out.collect()) == [("1", 11.0), ("1", 12.0), ("300725", 2.0)]
    assert [r.instrument for r in dropped.collect()] == ["000007"]


def test_board_events(spark):
    closes = [10.0, 11.0, 10.5, 10.6]
    rows = [("600001", day(i), c * 0.99, c, c * 0.98, c) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "instrument string, trade_date date, open double, high double, low double, close double")
    df = df.withColumn("pre_close", F.lag("close").over(C.by_instrument()))
    out = EV.close_position(EV.board_events(df)).orderBy("trade_date").collect()
    assert [r.first_board for r in out] == [False, True, False, False] and [r.anchor for r in out] == [False, False, False, True]
    assert out[3].value == pytest.approx((10.5 - 10.5 * 0.98) / (10.5 - 10.5 * 0.98))


@pytest.mark.parametrize("code,limit", [("830001", 0.3), ("688001", 0.2), ("300001", 0.2), ("1", 0.1)])
def test_board_limit(spark, code, limit):
    assert spark.createDataFrame([(code,)], "c string").select(C.board_limit(F.col("c"))).first()[0] == limit


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 3))
    y = 0.5 + x @ [1, -2, 0.0] + 0.1 * rng.standard_normal(40)
    rows = [("f", *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "factor_name string, a double, b double, c double, y double")
    got = {r.name: r for r in R.ols_exposure(df, "y", ["a", "b", "c"]).collect()}
    full = np.c_[np.ones(40), x]
    coef, rss, _, _ = np.linalg.lstsq(full, y, rcond=None)
    se = np.sqrt(rss[0] / 36 * np.diag(np.linalg.inv(full.T @ full)))
    for i, n in enumerate(["alpha", "a", "b", "c"]):
        assert got[n].coef == pytest.approx(coef[i], abs=1e-5) and got[n].tstat == pytest.approx(coef[i] / se[i], abs=1e-3)
    assert got["a"].n_days == 40 and R.ols_exposure(df.limit(29), "y", ["a"]).count() == 0
    # known values of the t distribution
    assert R.t_pvalue(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and R.t_pvalue(0.0, 5) == pytest.approx(1.0)
    marks = R.significant_exposures(R.exposure_map(R.ols_exposure(df, "y", ["a", "b", "c"]))).first().significant
    assert marks["a"] == "**" and "c" not in marks


def test_incremental_equals_full(spark):
    df = panel(spark, 4, 30)
    build = lambda p: P.compute([P.FactorSpec("m3", "series", 3, lambda: W.momentum("close", 3))], p).where("value is not null")
    full = build(df)
    stored = build(df.where(F.col("trade_date") <= F.lit(day(20))))
    got = N.incremental_update(stored, df, S.calendar_of(df), 3, build)
    assert got.exceptAll(full).isEmpty() and full.exceptAll(got).isEmpty()


def test_no_look_ahead_and_row_order(spark):
    df = panel(spark, 3, 40)
    specs = P.standard_specs()[:3]
    cut = day(30)
    a = P.compute(specs, df).where(F.col("trade_date") <= F.lit(cut))
    b = P.compute(specs, df.where(F.col("trade_date") <= F.lit(cut)).repartition(7).orderBy(F.rand(1)))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    single = P.compute(specs[:1], df)
    assert P.compute(specs, df).where("factor_name = 'momentum_5'").exceptAll(single).isEmpty()


def test_minute_windows_stay_in_days(spark):
    rows = [(s, dt.datetime(2024, 1, d, 9, 30 + i), float(10 + i + d), float(i + 1)) for s in "12" for d in (2, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "instrument string, datetime timestamp, close double, volume double")
    df = df.withColumns({"trade_date": F.to_date("datetime"), "vwap": F.col("close"), "high": F.col("close"), "low": F.col("close")})
    r = M.bar_returns(df)
    assert r.where("ret is null").count() == 4
    v = M.vwap_deviation(df).where("instrument = '1'").orderBy("trade_date").first().value
    closes = [12.0 + i for i in range(12)]
    assert v == pytest.approx(np.mean(closes[-5:]) / (np.mean(closes) + 1e-6) - 1)
    assert M.bars(df, 5).count() == 2 * 2 * 3
    seg = df.where(C.in_session(F.col("datetime"), "09:30", "09:35")).count()
    assert seg == 2 * 2 * 5 and df.where(C.in_session(F.col("datetime"), "09:30", "09:35", closed=True)).count() == 2 * 2 * 6


def test_user_functions_isolate_failures(spark):
    df = panel(spark, 2, 5)

    def f(rows, stock):
        if stock == "2":
            raise ValueError("bad")
        return rows["close"]

    out = U.daily_series(df, "x", f)
    assert out.where("error is null").count() == 5 and U.error_report(out).first().n == 1
    with pytest.raises(Exception, match="bad"):
        U.daily_series(df, "x", f, errors=False).collect()


def test_walk_forward_does_not_see_its_year(spark):
    rng = np.random.default_rng(0)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 1000, 2)]
    rows = [(s, d, float(10 + rng.uniform()), float(rng.uniform())) for s in "123" for d in days]
    df = spark.createDataFrame(rows, "instrument string, trade_date date, close double, turnover_rate double")
    changed = df.withColumn("close", F.when(F.year("trade_date") == 2022, F.col("close") * 3).otherwise(F.col("close")))
    a, b = (WF.walk_forward(WF.features(x)).where("year(trade_date) = 2021").toPandas().sort_values(["instrument", "trade_date"]) for x in (df, changed))
    assert len(a) and np.allclose(a["value"], b["value"])


def test_frame_hash_granularity_and_gate(spark):
    df = panel(spark)
    h = Q.frame_hash(df).first()
    assert h == Q.frame_hash(df.orderBy(F.rand(3)).select(*reversed(df.columns))).first()
    assert h != Q.frame_hash(df.withColumn("close", F.col("close") + 1)).first()
    assert Q.infer_granularity(df, "trade_date").first()[0] == "daily" and Q.infer_granularity(df.limit(1), "trade_date").first()[0] == "unknown"


def test_wide_round_trip(spark):
    df = panel(spark).select("trade_date", "instrument", F.col("close").alias("value"))
    wide = S.factor_wide(df, S.calendar_of(df), ["1", "2", "3"])
    back = S.wide_to_long(wide)
    assert back.exceptAll(df).isEmpty() and back.count() == df.count()
    odd = spark.createDataFrame([("20240101", "000001", "x"), ("2024-01-01", "1", "2.5")], "Date string, Code string, v string")
    assert [tuple(r) for r in S.wide_to_long(odd).collect()] == [(day(0), "1", 2.5)]


def test_series_of_names_and_failing_first_stages(spark):
    import pandas as pd

    from quantloom.plans import user_functions as U

    rows = [("1", "2024-01-02", f"2024-01-02 09:3{i}:00", float(i)) for i in range(3)] + [("2", "2024-01-02", "2024-01-02 09:30:00", 5.0)]
    df = spark.createDataFrame(rows, "instrument string, trade_date string, datetime string, close double").withColumn("trade_date", F.to_date("trade_date"))
    got = {(r.instrument, r.factor_name): r.value for r in U.minute_days(df, "x", lambda b, s: pd.Series({"hi": b["close"].max(), "n": float(len(b))})).collect()}
    assert got == {("1", "hi"): 2.0, ("1", "n"): 3.0, ("2", "hi"): 5.0, ("2", "n"): 1.0}
    last = {r.instrument: (r.factor_name, r.value) for r in U.minute_days(df, "x", lambda b, s: b["close"].cumsum()).collect()}
    assert last == {"1": ("x", 3.0), "2": ("x", 5.0)}

    def raw(bars, stock):
        if stock == "2":
            raise ValueError("odd")
        return {"hi": bars["close"].max()}

    out = U.minute_cross_sections(df, raw, lambda wide, day: {s: {"v": x} for s, x in zip(wide["instrument"], wide["hi"])}).collect()
    assert sorted((r.instrument, r.value, r.error) for r in out) == [("1", 2.0, None), ("2", None, "ValueError: odd")]


def test_many_factors_are_updated_to_the_full_run(spark):
    import datetime as dt

    from quantloom.plans import factors as P, incremental as N
    from quantloom.sources import panels as S

    rows = [(str(s), dt.date(2024, 1, 1) + dt.timedelta(d), 10.0 + s + d * d % 7) for s in range(3) for d in range(40)]
    daily = spark.createDataFrame(rows, "instrument string, trade_date date, close double")
    specs = [s for s in P.standard_specs() if s.kind == "series"]
    full = P.compute(specs, daily)
    stored = full.where("factor_name = 'momentum_5' and trade_date <= '2024-01-25' or factor_name = 'reversal_1' and trade_date <= '2024-02-01'")
    key = lambda df: sorted((r.factor_name, r.trade_date, r.instrument, r.value) for r in df.where("value is not null").collect())
    assert key(N.update_factors(stored, specs, daily, S.calendar_of(daily))) == key(full)
    assert key(N.update_factors(full, specs, daily, S.calendar_of(daily))) == key(full)


def test_tail_rows_hold_the_last_dates_and_read_no_more(spark):
    from quantloom.plans import incremental as N

    # one instrument trades daily, one paused for long, one has few rows, one none
    rows = [("a", day(n), float(n)) for n in range(1000)] + [("b", day(n), float(n)) for n in (*range(100), 990)] + [("c", day(980), 1.0)]
    df = spark.createDataFrame(rows, "instrument string, trade_date date, close double")
    names = spark.createDataFrame([(s,) for s in "abcd"], "instrument string")
    got = {s: sorted(r.trade_date for r in N.tail_rows(df, names, day(995), 5).where(F.col("instrument") == s).collect()) for s in "abcd"}
    for s, least in (("a", [day(n) for n in range(991, 996)]), ("b", [day(n) for n in (96, 97, 98, 99, 990)]), ("c", [day(980)]), ("d", [])):
        assert got[s][-len(least) :] == least or not least and not got[s]
    assert len(got["a"]) <= 10  # the long search for b and c is theirs alone
    assert N.tail_rows(df, names, day(995), 0).count() == 0 and N.tail_rows(df, names.limit(0), day(995), 5).count() == 0


def test_review_in_one_call(spark):
    from quantloom.plans import factors as P, review as RV

    df = panel(spark, 12, 60)
    factors = P.compute([s for s in P.standard_specs() if s.name == "momentum_5"], df)
    factors = factors.unionByName(df.select(F.lit("flat").alias("factor_name"), "trade_date", "instrument", F.lit(1.0).alias("value"))).unionByName(df.select(F.lit("none").alias("factor_name"), "trade_date", "instrument", F.lit(None).cast("double").alias("value")))
    styles = df.groupBy("trade_date").agg(F.avg("volume").alias("a"), F.avg("turnover_rate").alias("b"))
    out = {r.factor_name: r for r in RV.review(factors, df, styles, ["a", "b"]).collect()}
    assert set(out) == {"momentum_5", "flat", "none"} and out["momentum_5"].passes and not out["flat"].passes and out["flat"].constant and out["none"].empty
    m = out["momentum_5"]
    assert set(m.exposures) == {"alpha", "a", "b"} and m.non_null == 12 * 55 and m.rows == 60 and m.n_dates == 54 and m.long_short_days == 54
    assert "weak ic" not in out["none"].reasons and out["none"].exposures is None and RV.accepted(RV.review(factors, df, styles, ["a", "b"])).where("factor_name <> 'momentum_5'").isEmpty()


def test_one_series_is_aligned_without_a_window(spark):
    a = spark.createDataFrame([(day(n), 1.0) for n in range(40)], "trade_date date, x double")
    b = spark.createDataFrame([(day(n), 2.0) for n in range(5, 60)], "trade_date date, y double")
    out = J.align_series(a, b, 30)
    assert out.count() == 35 and out.columns == ["trade_date", "x", "y"] and J.align_series(a, b, 36).count() == 0
    assert "Window" not in out._jdf.queryExecution().toString()
