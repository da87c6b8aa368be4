import datetime as dt

from quantloom.session import scratch_dir
from quantloom.streaming import minute_stream as ST


def test_bars_of_open_days_do_not_pass_through_python(spark):
    path, out, state = (scratch_dir(spark, n) for n in ("in", "out", "state"))
    at = lambda d, m: dt.datetime(2024, 1, d, 9, m)
    a = [("1", at(1, 30), 1.0, None), ("1", at(1, 30), 2.0, 5), ("1", at(1, 31), 3.0, None), ("2", at(1, 30), 4.0, -1), ("2", at(1, 30), 5.0, -2), (None, at(1, 30), 6.0, 1), ("1", at(5, 30), 7.0, 9)]
    schema = "instrument string, datetime timestamp, close double, seq long"
    spark.createDataFrame(a, schema).repartition(1).write.parquet(path)
    kept = ST.keep_last_stream(ST.read_stream(spark, path, spark.createDataFrame(a, schema).schema), "1 hour")
    assert "TransformWithState" not in kept._jdf.queryExecution().analyzed().toString()
    assert kept.columns == ["instrument", "datetime", "close", "seq", "trade_date"]
    ST.append_stream(kept, out, state).awaitTermination()
    rows = lambda df: sorted(((r.instrument or "", r.datetime.day, r.datetime.minute, r.close, r.seq) for r in df.collect()), key=str)
    assert rows(spark.read.schema(kept.schema).parquet(out)) == [("", 1, 30, 6.0, 1), ("1", 1, 30, 2.0, 5), ("1", 1, 31, 3.0, None), ("2", 1, 30, 4.0, -1)]
    assert rows(ST.open_rows(spark, state)) == [("1", 5, 30, 7.0, 9)]
