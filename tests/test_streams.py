import datetime as dt

from pyspark.sql import functions as F

from quantloom.session import scratch_dir
from quantloom.streaming import minute_stream as ST


def rows(spark, stamps, add=0.0, seq=0):
    data = [("1", dt.datetime(2024, 1, d, h, m), 10.0 + d + add, 1.0, seq + i) for i, (d, h, m) in enumerate(stamps)]
    df = spark.createDataFrame(data, "instrument string, datetime timestamp, close double, volume double, seq long")
    return df.withColumns({"high": F.col("close"), "low": F.col("close")})


def test_keep_last_is_idempotent(spark):
    path, out, state, staging = (scratch_dir(spark, n) for n in ("in", "out", "state", "staging"))
    a = rows(spark, [(1, 9, 30), (1, 9, 31), (2, 9, 30)])
    a.write.parquet(path)
    ST.ingest_keep_last(ST.read_stream(spark, path, a.schema), out, state, staging=staging).awaitTermination()
    rows(spark, [(1, 9, 31)], 5.0, 100).write.mode("append").parquet(path)
    ST.ingest_keep_last(ST.read_stream(spark, path, a.schema), out, state, staging=staging).awaitTermination()
    got = {(r.datetime.day, r.datetime.minute): r.close for r in spark.read.parquet(out).collect()}
    assert got == {(1, 30): 11.0, (1, 31): 16.0, (2, 30): 12.0}


def test_late_rows_are_cut_off(spark):
    path, out, state = (scratch_dir(spark, n) for n in ("in", "out", "state"))
    a = rows(spark, [(1, 9, 30), (5, 9, 30)])
    a.write.parquet(path)
    run = lambda: ST.append_stream(ST.stream_day_bars(ST.read_stream(spark, path, a.schema), "1 day", "1 hour").withColumn("trade_date", F.to_date("start")), out, state).awaitTermination()
    run()
    rows(spark, [(1, 9, 45), (9, 9, 30)], seq=10).write.mode("append").parquet(path)
    run()
    got = {r.trade_date.day: r.n for r in spark.read.parquet(out).collect()}
    assert got == {1: 1, 5: 1}


def test_keep_last_in_state_restarts_and_stays_bounded(spark):
    path, out, state = (scratch_dir(spark, n) for n in ("in", "out", "state"))
    a = rows(spark, [(1, 9, 30), (1, 9, 31), (2, 9, 30)])
    a.write.parquet(path)
    kept = lambda: ST.keep_last_stream(ST.read_stream(spark, path, a.schema), "1 hour")
    run = lambda: ST.append_stream(kept(), out, state).awaitTermination()
    found = lambda df: sorted((r.datetime.day, r.datetime.minute, r.close, r.seq) for r in df.collect())
    written = lambda: found(spark.read.schema(kept().schema).parquet(out))
    run()
    # the first day is closed by the second one; the second is open
    assert written() == [(1, 30, 11.0, 0), (1, 31, 11.0, 1)] and found(ST.open_rows(spark, state)) == [(2, 30, 12.0, 2)]
    # after a restart: a correction of the open day, one that is older than what is held, one of a closed day, a new day
    rows(spark, [(2, 9, 30)], 5.0, 100).unionByName(rows(spark, [(2, 9, 30)], 9.0, -5)).unionByName(rows(spark, [(1, 9, 30)], 7.0, 200)).write.mode("append").parquet(path)
    run()
    assert written() == [(1, 30, 11.0, 0), (1, 31, 11.0, 1)] and found(ST.open_rows(spark, state)) == [(2, 30, 17.0, 100)]
    for day in range(3, 9):
        rows(spark, [(day, 9, 30), (day, 9, 31)], 0.0, 10 * day).write.mode("append").parquet(path)
        run()
        assert len(found(ST.open_rows(spark, state))) == 2  # one day, however many have passed
    assert [d for d, *_ in written()] == [1, 1, 2, *(d for d in range(3, 8) for _ in range(2))] and (2, 30, 17.0, 100) in written()


def test_whole_numbers_stay_whole_beside_missing_ones():
    import pandas as pd
    from pyspark.sql import types as T

    assert [type(v) for v in ST._plain(pd.Series([1.0, None]), T.LongType())] == [int, type(None)]
    assert ST._plain(pd.Series([dt.datetime(2024, 1, 1), None])) == [dt.datetime(2024, 1, 1), None]


def test_day_factor_in_one_stream_equals_the_table(spark):
    path, out, state = (scratch_dir(spark, n) for n in ("in", "out", "state"))
    a = rows(spark, [(d, 9, m) for d in (1, 2, 4) for m in (30, 40)])
    a.write.parquet(path)
    factor = lambda: ST.stream_day_factor(ST.read_stream(spark, path, a.schema), F.sum("close"), 2, "0 seconds")
    ST.append_stream(factor(), out, state).awaitTermination()
    for d in (5, 6, 8):
        rows(spark, [(d, 9, m) for m in (30, 40, 50)], seq=100 * d).write.mode("append").parquet(path)
        ST.append_stream(factor(), out, state).awaitTermination()
    got = {r.trade_date.day: r.value for r in spark.read.schema(factor().schema).parquet(out).collect()}
    day = {d: n * (10.0 + d) for d, n in ((1, 2), (2, 2), (4, 2), (5, 3), (6, 3))}
    days = sorted(day)
    assert got == {d: (day[d] + day[days[i - 1]]) / 2 if i else day[d] for i, d in enumerate(days)}
