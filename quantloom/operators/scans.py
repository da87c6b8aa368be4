"""Work along an instrument's dates that is spread over ranges of dates, so that no instrument is the work of one task.

Rows meet by (instrument, range). What a range needs of the ones before it is either a halo, the last rows before it, or
a state that is carried: each range gives a summary of its own, summaries are composed along the ranges of an instrument
(one row for each range), and each range then runs with what came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Days of a range.
DAYS = 256


def date_range(date: str | Column = "trade_date", days: int = DAYS) -> Column:
    """The number of a date's range."""
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / days)


def with_halo(df: DataFrame, lookback: int, days: int = DAYS) -> DataFrame:
    """df (one row for each instrument and date) with _range and _own: each row in its own range, and once more (not _own)
    in each later range that has it among the last `lookback` rows before it. Only the tails of ranges are copied."""
    base = df.withColumn("_range", date_range(days=days))
    own = base.withColumn("_own", F.lit(True))
    if lookback <= 0:
        return own
    # the ranges behind each one, and how many rows lie between
    ahead = F.collect_list(F.struct("_range", "_n")).over(Window.partitionBy("instrument").orderBy("_range").rowsBetween(1, lookback))
    sizes = base.groupBy("instrument", "_range").agg(F.count("*").alias("_n")).withColumn("_ahead", ahead)
    between = lambda i: F.aggregate(F.slice("_ahead", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + x["_n"])
    targets = F.transform("_ahead", lambda x, i: F.struct(x["_range"].alias("to"), between(i).alias("between")))
    sizes = sizes.select("instrument", "_range", targets.alias("_targets"))
    after = F.row_number().over(Window.partitionBy("instrument", "_range").orderBy(F.desc("trade_date"))) - 1
    tails = base.withColumn("_after", after).where(F.col("_after") < lookback).join(sizes, ["instrument", "_range"])
    near = F.filter("_targets", lambda t: t["between"] + F.col("_after") < lookback)
    copies = tails.withColumn("_to", F.explode(near)).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_to.to").alias("_range"), F.lit(False).alias("_own"))
    return own.unionByName(copies)


def ema(df: DataFrame, column: str, span: int, out: str = "ema", days: int = DAYS) -> DataFrame:
    """Exponential moving average of an instrument's rows by date, without adjustment: y = (1 - p) x + p y of the row
    before, where p is 1 - 2 / (span + 1) without gaps. Missing values repeat y and let its weight fade; before the first
    value there is none. Built-ins only.

    In a range of dates, all after its first value is an affine map of y there. Ranges are composed in order, which gives
    each the y and the number of missing values that came in, and its rows follow from these.
    """
    alpha = 2.0 / (span + 1)
    x = F.col(f"`{column}`").cast("double")
    row = F.struct(F.col("trade_date").alias("d"), F.when(~F.isnan(x), x).alias("x"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    parts = df.select("instrument", date_range(days=days).alias("_range"), row.alias("r")).groupBy("instrument", "_range").agg(F.sort_array(F.collect_list("r")).alias("rows"))

    def weight(gaps: Column) -> Column:
        """Of the old y, after so many missing values."""
        w = F.pow(F.lit(1.0 - alpha), gaps + 1)
        return w / (w + alpha)

    def fields(**values: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in values.items()])

    none, zero = F.lit(None).cast("double"), F.lit(0)

    # lead: missing values before the first one; gaps: after the last; y at the end is a * (y at the first value) + c
    def shorten(s: Column, r: Column) -> Column:
        p, seen = weight(s["gaps"]), s["first"].isNotNull()
        missing = fields(lead=F.when(seen, s["lead"]).otherwise(s["lead"] + 1), gaps=F.when(seen, s["gaps"] + 1).otherwise(zero), first=s["first"], a=s["a"], c=s["c"])
        first = fields(lead=s["lead"], gaps=zero, first=r["x"], a=F.lit(1.0), c=F.lit(0.0))
        later = fields(lead=s["lead"], gaps=zero, first=s["first"], a=p * s["a"], c=p * s["c"] + (1 - p) * r["x"])
        return F.when(r["x"].isNull(), missing).when(seen, later).otherwise(first)

    start = fields(lead=zero, gaps=zero, first=none, a=F.lit(1.0), c=F.lit(0.0))
    maps = parts.select("instrument", F.struct("_range", F.aggregate("rows", start, shorten).alias("m")).alias("p"))

    def meet(y: Column, p: Column, value: Column) -> Column:
        return F.when(y.isNull(), value).otherwise(p * y + (1 - p) * value)

    def compose(s: Column, b: Column) -> Column:
        m = b["m"]
        came = F.array_append(s["out"], fields(_range=b["_range"], y=s["y"], gaps=s["gaps"]))
        y = m["a"] * meet(s["y"], weight(s["gaps"] + m["lead"]), m["first"]) + m["c"]
        return F.when(m["first"].isNull(), fields(out=came, y=s["y"], gaps=s["gaps"] + m["lead"])).otherwise(fields(out=came, y=y, gaps=m["gaps"]))

    begin = fields(out=F.array().cast("array<struct<_range:bigint,y:double,gaps:int>>"), y=none, gaps=zero)
    chains = maps.groupBy("instrument").agg(F.sort_array(F.collect_list("p")).alias("all"))  # a row for each range
    came = chains.select("instrument", F.inline(F.aggregate("all", begin, compose, lambda s: s["out"])))

    def follow(s: Column, r: Column) -> Column:
        y = F.when(r["x"].isNull(), s["y"]).otherwise(meet(s["y"], weight(s["gaps"]), r["x"]))
        return fields(out=F.array_append(s["out"], y), y=y, gaps=F.when(r["x"].isNull(), s["gaps"] + 1).otherwise(zero))

    values = F.aggregate("rows", fields(out=F.array().cast("array<double>"), y=F.col("y"), gaps=F.col("gaps")), follow, lambda s: s["out"])
    rows = parts.join(came, ["instrument", "_range"]).select(F.explode(F.arrays_zip(F.col("rows.row").alias("row"), values.alias("value"))).alias("z"))
    return rows.select(*[F.col("z.row").getField(c).alias(c) for c in df.columns], F.col("z.value").alias(out))
