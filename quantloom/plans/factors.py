"""Declared factors and their joint computation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import by_instrument, finite
from ..operators import minute as M, windows as Wn
from ..operators.evaluate import evaluate
from ..operators.panel_joins import asof_rows
from ..sources.panels import calendar_of, factor_long


@dataclass(frozen=True)
class FactorSpec:
    """A factor. kind "series": build() gives a Column over windows by instrument; "cross_section": a Column over
    windows by date, on the columns that `stage` adds by instrument first; "minute": build() is a function of the
    intraday rows that returns (instrument, trade_date, value)."""

    name: str
    kind: str
    lookback: int
    build: Callable
    columns: tuple[str, ...] = ("close",)
    stage: tuple[tuple[str, Callable[[], Column]], ...] = ()


def compute(specs: list[FactorSpec], daily: DataFrame | None = None, minute: DataFrame | None = None, asof: DataFrame | None = None, clustered: bool = False) -> DataFrame:
    """The long factor table of all specs.

    asof: a calendar (trade_date); daily factors then have a value on each of its dates, from the instrument's last bar
    at or before it. Series factors are columns over one window partitioning, so they share one shuffle on the instrument whatever
    their number; cross-sections share a second one on the date. Only the columns that specs name are read.
    clustered: the minute bars lie by instrument already (write_bucketed()), so they are not moved for several factors.
    """
    parts: list[DataFrame] = []
    flat = [s for s in specs if s.kind in ("series", "cross_section")]
    if flat:
        if daily is None:
            raise ValueError("daily bars are needed")
        needed = list(dict.fromkeys(c for s in flat for c in s.columns))
        df = daily.select("instrument", "trade_date", *needed)
        df = df if asof is None else asof_rows(df, asof)
        df = df.withColumns({n: b() for s in flat for n, b in s.stage} or {"_": F.lit(0)})
        df = df.withColumns({s.name: s.build() for s in flat if s.kind == "series"} or {"_": F.lit(0)})
        df = df.withColumns({s.name: s.build() for s in flat if s.kind == "cross_section"} or {"_": F.lit(0)})
        parts.append(factor_long(df, [s.name for s in flat]))
    intraday = [s for s in specs if s.kind == "minute"]
    if intraday and minute is None:
        raise ValueError("minute bars are needed")
    if len(intraday) > 1 and not clustered:  # each needs the rows of an instrument's day together: they move once for all
        minute = minute.repartition("instrument", "trade_date")
    for s in intraday:
        parts.append(s.build(minute).select(F.lit(s.name).alias("factor_name"), "trade_date", "instrument", finite(F.col("value")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_labels(factors: DataFrame, daily: DataFrame, price: str = "close") -> DataFrame:
    """The long factor table with ret_next, rows with both only: what evaluate() takes."""
    label = Wn.next_return(daily.select("instrument", "trade_date", price), price).select("instrument", "trade_date", "ret_next")
    return factors.where("value is not null").join(label, ["instrument", "trade_date"])


def mask_limit_up(factors: DataFrame, limit_up: DataFrame) -> DataFrame:
    """Values become null on the instrument's limit-up dates; rows stay."""
    hit = limit_up.select("trade_date", "instrument").distinct().withColumn("_hit", F.lit(True))
    return factors.join(hit, ["trade_date", "instrument"], "left").withColumn("value", F.when(F.col("_hit").isNull(), F.col("value"))).drop("_hit")


def run(specs: list[FactorSpec], daily: DataFrame, limit_up: DataFrame | None = None, minute: DataFrame | None = None, asof: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(factor table, evaluation)."""
    factors = compute(specs, daily, minute, asof)
    if limit_up is not None:
        factors = mask_limit_up(factors, limit_up)
    return factors, evaluate(with_labels(factors, daily))


def standard_specs() -> list[FactorSpec]:
    """One factor for each template, and some more."""
    z = lambda c: (lambda: Wn.zscore(F.col(c), Wn.by_date()))
    return [
        FactorSpec("momentum_5", "series", 5, lambda: Wn.momentum("close", 5)),
        FactorSpec("reversal_1", "series", 1, lambda: Wn.reversal("close", 1)),
        FactorSpec("ma_ratio_5_20", "series", 20, lambda: Wn.ma_ratio("close", 5, 20)),
        FactorSpec("quality", "cross_section", 0, lambda: z("roe")() + z("gross_margin")(), ("roe", "gross_margin")),
        FactorSpec("momentum_z", "cross_section", 5, z("_m5"), ("close",), (("_m5", lambda: Wn.momentum("close", 5)),)),
        FactorSpec("volume_amount", "minute", 20, lambda m: M.volume_amount_ratio(m)),
    ]


__all__ = ["FactorSpec", "by_instrument", "calendar_of", "compute", "mask_limit_up", "run", "standard_specs", "with_labels"]
