"""Evaluation of factors. Input: (factor_name, trade_date, instrument, value, ret_next), both values present.

All statistics are by factor_name, so that many factors share one pass and no window spans a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import TRADING_DAYS, average_rank, correlation
from .windows import decile

DAY = ["factor_name", "trade_date"]


def daily_ic(df: DataFrame, least: int = 3) -> DataFrame:
    """(factor_name, trade_date, ic): Pearson correlation of value and ret_next; null for constant input."""
    out = df.groupBy(*DAY).agg(correlation(F.col("value"), F.col("ret_next")).alias("ic"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("n")


def daily_rank_ic(df: DataFrame, least: int = 3) -> DataFrame:
    """The same of average ranks."""
    ranked = df.select(*DAY, average_rank(F.col("value"), DAY).alias("value"), average_rank(F.col("ret_next"), DAY).alias("ret_next"))
    return daily_ic(ranked, least).withColumnRenamed("ic", "rank_ic")


def ic_summary(ic: DataFrame, column: str = "ic") -> DataFrame:
    """mean, sample std (0 for one day), ratio of both (null for std 0), days, share of positive days."""
    c = F.col(column)
    std = F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))
    return ic.where(c.isNotNull()).groupBy("factor_name").agg(
        F.avg(c).alias(f"{column}_mean"), std.alias(f"{column}_std"), F.try_divide(F.avg(c), F.nullif(std, F.lit(0.0))).alias(f"{column}_ir"),
        F.count(c).alias(f"{column}_days"), F.avg((c > 0).cast("double")).alias(f"{column}_positive_ratio"),
    )


def decile_returns_daily(df: DataFrame, least: int = 10, q: int = 10) -> DataFrame:
    """(factor_name, trade_date, decile, mean_ret) of dates with enough rows; decile 1 has the lowest values."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*DAY))
    dealt = decile(df.withColumn("_n", n).where(F.col("_n") >= least), q, ["factor_name"])
    return dealt.groupBy(*DAY, (F.col("decile") + 1).alias("decile")).agg(F.avg("ret_next").alias("mean_ret"))


def decile_summary(daily: DataFrame) -> DataFrame:
    """Mean and sample std over dates for each decile."""
    return daily.groupBy("factor_name", "decile").agg(F.avg("mean_ret").alias("mean"), F.stddev_samp("mean_ret").alias("std"))


def decile_wide(daily: DataFrame, q: int = 10) -> DataFrame:
    """One row for each factor: D1_mean, D1_std, ..."""
    parts = [f(F.when(F.col("decile") == k, F.col("mean_ret"))).alias(f"D{k}_{n}") for k in range(1, q + 1) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return daily.groupBy("factor_name").agg(*parts)


def long_short_daily(daily: DataFrame, q: int = 10) -> DataFrame:
    """(factor_name, trade_date, ls): the first decile's mean return less the last one's."""
    side = lambda k: F.avg(F.when(F.col("decile") == k, F.col("mean_ret")))
    return daily.groupBy(*DAY).agg((side(1) - side(q)).alias("ls")).where("ls is not null")


def long_short_summary(ls: DataFrame) -> DataFrame:
    """mean, Sharpe ratio of a year (null for std 0) and days."""
    std = F.stddev_samp("ls")
    return ls.groupBy("factor_name").agg(F.avg("ls").alias("long_short_mean"), F.when(std > 0, F.avg("ls") / std * TRADING_DAYS**0.5).alias("long_short_sharpe"), F.count("*").alias("long_short_days"))


def max_drawdown(ls: DataFrame) -> DataFrame:
    """The deepest fall of the compounded curve below its peak so far; windows are by factor."""
    w = Window.partitionBy("factor_name").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    curve = ls.withColumn("_cum", F.product(1 + F.col("ls")).over(w)).withColumn("_peak", F.max("_cum").over(w))
    return curve.groupBy("factor_name").agg(F.min(F.try_divide("_cum", "_peak") - 1).alias("long_short_max_drawdown"))


def observation_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("factor_name").agg(F.count("*").alias("n_observations"), F.countDistinct("trade_date").alias("n_dates"))


def annualized(ls: DataFrame) -> DataFrame:
    """Mean times 252 and population std times its root."""
    return ls.groupBy("factor_name").agg((F.avg("ls") * TRADING_DAYS).alias("annual_return"), (F.stddev_pop("ls") * TRADING_DAYS**0.5).alias("annual_vol"))


def cum_decile_curve(daily: DataFrame, q: int = 10) -> DataFrame:
    """Additive cumulative return of each decile, and of first less last as decile 0."""
    ls = long_short_daily(daily, q).select(*DAY, F.lit(0).alias("decile"), F.col("ls").alias("mean_ret"))
    w = Window.partitionBy("factor_name", "decile").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*DAY, "decile", "mean_ret").unionByName(ls).withColumn("cum_ret", F.sum("mean_ret").over(w)).drop("mean_ret")


def evaluate(df: DataFrame) -> DataFrame:
    """One row for each factor with all summaries. df is used several times and best a stored or cached table."""
    daily = decile_returns_daily(df)
    ls = long_short_daily(daily)
    parts = [ic_summary(daily_ic(df)), ic_summary(daily_rank_ic(df), "rank_ic"), decile_wide(daily), long_short_summary(ls), max_drawdown(ls)]
    out = observation_counts(df)
    for p in parts:
        out = out.join(p, "factor_name", "left")
    return out


def industry_stats(df: DataFrame, column: str = "value") -> DataFrame:
    """Mean, rank and neutralized value within (trade_date, industry)."""
    w = Window.partitionBy("trade_date", "industry")
    c: Column = F.col(column)
    return df.withColumns({"industry_mean": F.avg(c).over(w), "industry_rank": F.rank().over(w.orderBy(c)), "neutral": c - F.avg(c).over(w)})
