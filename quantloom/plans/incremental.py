"""Incremental runs: high-water marks, input windows, merges, resuming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.ingest import dedup_keep_last
from ..session import staged
from .factors import FactorSpec, compute, mask_limit_up


def high_water_mark(stored: DataFrame, calendar: DataFrame) -> DataFrame:
    """(factor_name, last_date, latest, todo): what is stored against the newest date of the calendar."""
    latest = calendar.agg(F.max("trade_date")).first()[0]
    last = stored.groupBy("factor_name").agg(F.max("trade_date").alias("last_date"))
    return last.withColumn("latest", F.lit(latest)).withColumn("todo", F.col("last_date") < F.col("latest"))


def incremental_window(calendar: DataFrame, start, lookback: int) -> DataFrame:
    """Calendar dates from max(0, place of start - lookback) on."""
    first = calendar.where(F.col("trade_date") >= F.lit(start)).agg(F.min("idx")).first()[0]
    return calendar.where(F.col("idx") >= max(0, (first or 0) - lookback)) if first is not None else calendar.limit(0)


def merge_incremental(stored: DataFrame, new: DataFrame, last) -> DataFrame:
    """Stored rows and new ones after `last`; late rows up to it are ignored, of equal keys the new one stays."""
    later = new if last is None else new.where(F.col("trade_date") > F.lit(last))
    both = stored.withColumn("_new", F.lit(0)).unionByName(later.withColumn("_new", F.lit(1)))
    return dedup_keep_last(both, ["factor_name", "trade_date", "instrument"], ["_new"]).drop("_new")


def incremental_update(stored: DataFrame, panel: DataFrame, calendar: DataFrame, lookback: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored factor extended to the panel's dates. build: panel -> long factor rows.

    Only the dates of the look-back are read, so a build that needs more than `lookback` rows of history for an
    instrument that pauses must declare a longer one. Equal to a full run on the same panel.
    """
    last = stored.agg(F.max("trade_date")).first()[0]
    if last is None:
        return build(panel)
    nxt = calendar.where(F.col("trade_date") > F.lit(last)).agg(F.min("trade_date")).first()[0]
    if nxt is None:
        return stored
    days = incremental_window(calendar, nxt, lookback)
    first = days.agg(F.min("trade_date")).first()[0]
    return merge_incremental(stored, build(panel.where(F.col("trade_date") >= F.lit(first))), last)


def update_factors(stored: DataFrame, specs: list[FactorSpec], daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """The stored table of many daily factors extended to the calendar's last date, equal to a full run.

    What is stored stays as it is. daily has a row on each of the dates that a look-back counts (as-of rows, if bars are
    missing).
    """
    days = daily.join(calendar.select("trade_date"), "trade_date", "left_semi")
    return stored.unionByName(extend_factors(stored, specs, days))


def tail_rows(rows: DataFrame, instruments: DataFrame, cut: dt.date, n: int) -> DataFrame:
    """Rows of the instruments up to the date `cut` that hold the last n dates of each, or all that it has.

    Stretches of dates are read backwards, each four times as long as all before it and for those instruments only that
    still lack dates, so an instrument that pauses does not make the others' history be read.
    """
    out, need, days, to = rows.limit(0), staged(instruments.select("instrument").withColumn("_need", F.lit(n)), "need"), max(7, 2 * n), cut
    while n > 0:
        since = cut - dt.timedelta(days=days)
        piece = rows.where((F.col("trade_date") > F.lit(since)) & (F.col("trade_date") <= F.lit(to))).join(need.select("instrument"), "instrument", "left_semi")
        out = out.unionByName(piece)
        got = piece.groupBy("instrument").agg(F.countDistinct("trade_date").alias("_got"))
        need = staged(need.join(got, "instrument", "left").select("instrument", (F.col("_need") - F.coalesce("_got", F.lit(0))).alias("_need")).where("_need > 0"), "need")
        if need.isEmpty() or rows.where(F.col("trade_date") <= F.lit(since)).isEmpty():
            break
        days, to = 5 * days, since
    return out


def extend_factors(stored: DataFrame, specs: list[FactorSpec], daily: DataFrame | None = None, minute: DataFrame | None = None, limit_up: DataFrame | None = None) -> DataFrame:
    """The rows that the stored table of factors lacks at its end: what compute() (and the mask, with limit_up) would give
    for each factor on the dates behind its last stored one.

    Each source is planned by itself: of its new dates all rows, and before them as many dates of each instrument as the
    longest look-back of its specs, stages included, counts; minute bars by days. Factors are computed from the earliest
    of their last dates on, and those without any from the beginning, so a source is read for two branches at most.
    """
    ends = {r["factor_name"]: r["last_date"] for r in stored.groupBy("factor_name").agg(F.max("trade_date").alias("last_date")).collect()}  # a row for each factor
    parts: list[DataFrame] = []
    for source, kinds in (("daily", ("series", "cross_section")), ("minute", ("minute",))):
        mine = [s for s in specs if s.kind in kinds]
        rows = daily if source == "daily" else minute
        if mine and rows is None:
            raise ValueError(f"{source} bars are needed")
        begun, new = [s for s in mine if s.name in ends], [s for s in mine if s.name not in ends]
        if new:
            parts.append(compute(new, **{source: rows}))
        if begun:
            cut = min(ends[s.name] for s in begun)
            late = rows.where(F.col("trade_date") > F.lit(cut))
            panel = late.unionByName(tail_rows(rows, late.select("instrument").distinct(), cut, max(s.lookback for s in begun)))
            behind = F.create_map(*[F.lit(x) for s in begun for x in (s.name, ends[s.name])])
            parts.append(compute(begun, **{source: panel}).where(F.col("trade_date") > F.try_element_at(behind, F.col("factor_name"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if limit_up is None else mask_limit_up(out, limit_up).select(*out.columns)


def resume_from_checkpoint(days: DataFrame, done: DataFrame) -> DataFrame:
    """Dates whose output is not there yet."""
    return days.join(done.select("trade_date").distinct(), "trade_date", "left_anti")


def overwrite_dates(df: DataFrame, path: str) -> None:
    """Writes by date, replacing only the dates that df has: a repeated run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)
