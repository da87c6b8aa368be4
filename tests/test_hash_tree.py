"""Hash trees name exactly the dates that differ, and only those are written again."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from quantloom.plans import hash_tree as HT
from quantloom.session import scratch_dir

SCHEMA = "factor_name string, trade_date date, instrument string, value double"


def table(rows):
    rng = random.Random(len(rows))
    rows = list(rows)
    rng.shuffle(rows)
    return rows


def base():
    return {(f, dt.date(2019, 11, 1) + dt.timedelta(days=n), s): float(n + ord(s)) for f in ("m", "r", "same") for n in range(90) for s in "abc"}


def test_names_exactly_the_changed_dates(spark):
    a, b = base(), base()
    d = lambda n: dt.date(2019, 11, 1) + dt.timedelta(days=n)
    b["m", d(3), "a"] += 1
    b["m", d(70), "b"] = None
    del b["r", d(5), "c"]
    for s in "abc":
        del b["r", d(80), s]
        b["r", d(95), s] = 1.0
    b["m", d(7), "a"], b["m", d(7), "b"] = b["m", d(7), "b"], b["m", d(7), "a"]
    one, two = (spark.createDataFrame(table([(*k, v) for k, v in x.items()]), SCHEMA) for x in (a, b))
    paths = [scratch_dir(spark, "tree") for _ in range(3)]
    HT.write_tree(one, paths[0])
    HT.write_tree(two, paths[1])
    HT.write_tree(one.repartition(7).select("value", "instrument", "trade_date", "factor_name"), paths[2])
    got = {tuple(r) for r in HT.changed_dates(spark, paths[1], paths[0]).collect()}
    assert got == {("m", d(3), "changed"), ("m", d(70), "changed"), ("m", d(7), "changed"), ("r", d(5), "changed"), ("r", d(80), "removed"), ("r", d(95), "added")}
    assert HT.changed_dates(spark, paths[2], paths[0]).isEmpty()
    # a row twice is not the row
    twice = one.unionByName(one.where(F.col("instrument") == "a").where(F.col("trade_date") == F.lit(d(1))).where("factor_name = 'm'"))
    HT.write_tree(twice, paths[2])
    assert [tuple(r) for r in HT.changed_dates(spark, paths[2], paths[0]).collect()] == [("m", d(1), "changed")]


def test_sync_writes_only_changed_dates(spark):
    path = scratch_dir(spark, "factors")
    a = base()
    rows = lambda x: spark.createDataFrame(table([(*k, v) for k, v in x.items()]), SCHEMA)
    stored = lambda: {(r.factor_name, r.trade_date, r.instrument): r.value for r in spark.read.parquet(f"{path}/table").collect()}
    a = {k: v for k, v in a.items() if k[0] != "r" and k[1].day < 4}
    assert HT.sync_factors(rows(a), path).where("change = 'added'").count() == len({k[:2] for k in a}) and stored() == a
    local = path.removeprefix("file://")
    files = lambda: {f"{root}/{f}" for root, _, fs in os.walk(f"{local}/table") for f in fs if f.endswith(".parquet")}
    before = files()
    b = dict(a)
    b["m", dt.date(2019, 12, 2), "a"] = 7.5
    gone = [k for k in b if k[:2] == ("same", dt.date(2020, 1, 1))]
    for k in gone:
        del b[k]
    assert {tuple(r) for r in HT.sync_factors(rows(b), path).collect()} == {("m", dt.date(2019, 12, 2), "changed"), ("same", dt.date(2020, 1, 1), "removed")}
    assert stored() == b
    moved = before ^ files()
    assert moved and all("trade_date=2019-12-02" in f and "factor_name=m" in f or "trade_date=2020-01-01" in f and "factor_name=same" in f for f in moved)
    assert HT.sync_factors(rows(b), path).isEmpty() and before ^ files() == moved
