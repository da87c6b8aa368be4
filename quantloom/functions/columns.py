"""Column functions: codes, missing values, returns, sessions and the rules of price limits."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F
from pyspark.sql.window import WindowSpec

TRADING_DAYS = 252


def strip_code(code: Column) -> Column:
    """A code without leading zeros, the form of all join keys."""
    return F.regexp_replace(F.trim(code.cast("string")), "^0+(?=.)", "")


def pad_code(code: Column) -> Column:
    """A code with six digits."""
    bare = strip_code(code)
    return F.when(F.length(bare) >= 6, bare).otherwise(F.lpad(bare, 6, "0"))


def finite(x: Column) -> Column:
    """null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is missing."""
    return F.try_divide(a, b)


# Daily price limits by the first digits of a six-digit code.
BOARD_LIMITS = {"8": 0.30, "688": 0.20, "300": 0.20}
DEFAULT_LIMIT = 0.10


def board_limit(code: Column) -> Column:
    padded = pad_code(code)
    out = F.lit(DEFAULT_LIMIT)
    for head, limit in BOARD_LIMITS.items():
        out = F.when(padded.startswith(head), limit).otherwise(out)
    return out


def cents(x: Column) -> Column:
    """Rounded to the cent, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def limit_price(pre_close: Column, code: Column) -> Column:
    """The highest price of a day, to the cent."""
    return cents(pre_close * (1 + board_limit(code)))


def is_limit_up(close: Column, pre_close: Column, code: Column) -> Column:
    return F.coalesce(cents(close) >= limit_price(pre_close, code), F.lit(False))


def one_line_board(open_: Column, high: Column, low: Column, close: Column, limit: Column) -> Column:
    """All four prices are the limit price."""
    return F.coalesce((cents(open_) == limit) & (cents(high) == limit) & (cents(low) == limit) & (cents(close) == limit), F.lit(False))


def non_one_line(open_: Column, high: Column, low: Column, close: Column, limit: Column) -> Column:
    """The close is the limit price and at least one other price is not."""
    other = (cents(open_) != limit) | (cents(high) != limit) | (cents(low) != limit)
    return F.coalesce((cents(close) == limit) & other, F.lit(False))


def adj_close(close: Column, factor: Column) -> Column:
    return close * factor


def simple_return(price: Column, before: Column) -> Column:
    return F.try_divide(price, before) - 1


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as floating-point arithmetic has it: infinite over zero, NaN for zero over zero."""
    over_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def log_return(price: Column, before: Column) -> Column:
    ratio = F.try_divide(price, before)
    return F.when(ratio > 0, F.log(ratio))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock(text: str) -> int:
    """Minutes of the day of "HH:MM"."""
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def in_session(ts: Column, start: str, end: str, closed: bool = False) -> Column:
    """start <= time < end; closed: the end belongs to it (the close of a day)."""
    m = minute_of_day(ts)
    return (m >= clock(start)) & ((m <= clock(end)) if closed else (m < clock(end)))


def by_instrument() -> WindowSpec:
    return Window.partitionBy("instrument").orderBy("trade_date")


def by_date(*more: str) -> WindowSpec:
    """The cross-section of a date; more: such as factor_name or industry."""
    return Window.partitionBy(*more, "trade_date")


def zscore(x: Column, group: WindowSpec) -> Column:
    """(x - mean) / population std; 0 where the std is 0."""
    sd = F.stddev_pop(x).over(group)
    return F.when(x.isNotNull(), F.when(sd == 0, 0.0).otherwise(F.try_divide(x - F.avg(x).over(group), sd)))


def average_rank(x: Column, group: list[str]) -> Column:
    """Ranks of equal values are averaged; null for null."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, x))
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*group).orderBy(x.asc_nulls_last())) + (ties - 1) / 2)


def first_rank(x: Column, group: list[str], tie: str = "instrument") -> Column:
    """Ranks 1, 2, ...; equal values by the tie column."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(x, tie))


def quantile_bin(rank: Column, n: Column, q: int = 10) -> Column:
    """The quantile bin 0..q-1 of ranks 1..n with edges at equal steps of the rank (not ntile: bins differ when q does not divide n)."""
    return F.greatest(F.floor((q * (rank - 1) + n - 2) / F.greatest(n - 1, F.lit(1))), F.lit(1)).cast("int") - 1


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null for a constant input instead of an error."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
