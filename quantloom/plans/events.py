"""Event factors of price limits: boards, pullbacks and anchored values. Previous rows are rows of the instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import by_instrument, is_limit_up, limit_price, non_one_line, one_line_board


def board_events(df: DataFrame) -> DataFrame:
    """Adds limit, limit_up, one_line, non_one_line, first_board, pullback and anchor; needs pre_close.

    first_board: a limit-up day that is no one-line board, after a day that was not limit-up (none before: counts as
    not). pullback: the previous day is not limit-up and closed below the one before. anchor: the day before the
    previous one is a first board, and the previous one closed below it without a limit-up.
    """
    w = by_instrument()
    limit = limit_price(F.col("pre_close"), F.col("instrument"))
    ohlc = [F.col(c) for c in ("open", "high", "low", "close")]
    df = df.withColumn("limit", limit).withColumns(
        {
            "limit_up": is_limit_up(F.col("close"), F.col("pre_close"), F.col("instrument")),
            "one_line": one_line_board(*ohlc, F.col("limit")),
            "non_one_line": non_one_line(*ohlc, F.col("limit")),
        }
    )
    before = lambda c, n=1: F.coalesce(F.lag(c, n).over(w), F.lit(False))
    df = df.withColumn("first_board", F.col("non_one_line") & F.col("limit_up") & ~before("limit_up"))
    df = df.withColumn("pullback", F.coalesce(F.lag("close", 1).over(w) < F.lag("close", 2).over(w), F.lit(False)) & ~before("limit_up"))
    return df.withColumn("anchor", before("first_board", 2) & F.col("pullback"))


def anchored(df: DataFrame, column: str) -> DataFrame:
    """The column's value on anchored days, null on others."""
    return df.withColumn("value", F.when(F.col("anchor"), F.col(column)))


def close_position(df: DataFrame) -> DataFrame:
    """On anchored days where the previous close stood between the previous low and high; 0.5 without a range."""
    w = by_instrument()
    high, low, close = (F.lag(c).over(w) for c in ("high", "low", "close"))
    return df.withColumn("value", F.when(F.col("anchor"), F.when(high == low, 0.5).otherwise(F.try_divide(close - low, high - low))))
