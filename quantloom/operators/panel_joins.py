"""Joins of panels: labels, as-of rows, look-back slices, aligned series and index returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import correlation, simple_return
from ..sources.panels import grid


def join_label(factor: DataFrame, label: DataFrame) -> DataFrame:
    """Rows with a factor value and a label."""
    return factor.join(label.where("ret_next is not null"), ["trade_date", "instrument"]).where("value is not null")


def asof_rows(panel: DataFrame, calendar: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """For each calendar date the last row of each instrument at or before it; bar_date is that row's own date.

    Grid rows are merged into the instrument's rows by date, so there is no inequality join.
    """
    others = [c for c in panel.columns if c not in ("instrument", "trade_date")]
    rows = panel.select("instrument", "trade_date", F.struct(F.col("trade_date").alias("bar_date"), *others).alias("_bar"), F.lit(0).alias("_grid"))
    days = grid(calendar, panel if universe is None else universe).select("instrument", "trade_date", F.lit(None).cast(rows.schema["_bar"].dataType).alias("_bar"), F.lit(1).alias("_grid"))
    w = Window.partitionBy("instrument").orderBy("trade_date", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.union(days).withColumn("_bar", F.last("_bar", ignorenulls=True).over(w)).where("_grid = 1 and _bar is not null")
    return out.select("instrument", "trade_date", "_bar.*")


def lookback_frame(kind: str, n: int, order: str = "trade_date") -> WindowSpec:
    """The rows that a factor may see: daily and model n + 1 rows, cross_section n rows (0: all before), minute the
    rows of n days, today included, clamped to 1..120, by the calendar ordinal idx."""
    if kind == "minute":
        days = min(max(n, 1), 120)
        return Window.partitionBy("instrument").orderBy("idx").rangeBetween(-(days - 1), 0)
    w = Window.partitionBy("instrument").orderBy(order)
    if kind == "cross_section":
        return w.rowsBetween(Window.unboundedPreceding if n == 0 else -(n - 1), 0)
    if kind in ("daily", "model"):
        return w.rowsBetween(-n, 0)
    raise ValueError(kind)


def align_series(a: DataFrame, b: DataFrame, least: int = 30, group: list[str] | None = None) -> DataFrame:
    """Two date series on their common dates; groups with fewer than `least` dates are left out."""
    both = a.join(b, "trade_date")
    if not group:  # one number for all rows, without bringing them together
        enough = both.agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
        return both.join(F.broadcast(enough), F.lit(True)).drop("_n")
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return both.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def index_join(stock: DataFrame, index: DataFrame) -> DataFrame:
    """Stock returns (ret) with the index's return of the date (index_ret) and the excess; the index has a row a date."""
    return stock.join(F.broadcast(index.select("trade_date", "index_ret")), "trade_date").withColumn("excess", F.col("ret") - F.col("index_ret"))


def equal_weight_index(panel: DataFrame, ret: Column | str = "ret") -> DataFrame:
    return panel.groupBy("trade_date").agg(F.avg(ret).alias("index_ret"))


__all__ = ["align_series", "asof_rows", "correlation", "equal_weight_index", "index_join", "join_label", "lookback_frame", "simple_return"]
