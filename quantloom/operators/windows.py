"""Rolling and cross-sectional factor primitives.

Rolling frames are rows of one instrument; cross-sections are the rows of one date. Chains of the first kind share
one shuffle on the instrument, those of the second one on the date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import by_date, by_instrument, first_rank, quantile_bin, simple_return, zscore


def next_return(df: DataFrame, price: str = "close") -> DataFrame:
    """ret_next: the return to the instrument's next row; the last row has none and is dropped."""
    ahead = F.lead(price).over(by_instrument())
    return df.withColumn("ret_next", simple_return(ahead, F.col(price))).where("ret_next is not null")


def rank_first(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn("rank", first_rank(F.col(column), ["trade_date"]))


def decile(df: DataFrame, q: int = 10, group: list[str] | None = None, column: str = "value") -> DataFrame:
    """decile 0..q-1 of each date, from ranks in which ties go by instrument."""
    group = [*(group or []), "trade_date"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return df.withColumn("decile", quantile_bin(first_rank(F.col(column), group), n, q))


def zscore_cs(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """z_<column> for each column, within the date (and group)."""
    return df.withColumns({f"z_{c}": zscore(F.col(c), by_date(*(group or []))) for c in columns})


def rank_cs(df: DataFrame, column: str) -> DataFrame:
    """rank, pct_rank and the date's quartiles of a column."""
    w = by_date().orderBy(column)
    return df.where(F.col(column).isNotNull()).withColumns({"rank": F.rank().over(w), "pct_rank": F.percent_rank().over(w), "median": F.percentile(column, F.lit(0.5)).over(by_date())})


def quantiles_cs(df: DataFrame, column: str, levels: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, level, value): exact quantiles of any levels for each date (or other keys), interpolated between values."""
    keys = keys or ["trade_date"]
    found = df.groupBy(*keys).agg(F.percentile(column, F.array(*map(F.lit, levels))).alias("_v")).where("_v is not null")
    return found.select(*keys, F.inline(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("_v").alias("value"))))


def rank_error(k: int) -> float:
    """By how much of all values the rank of a sketch's quantile may be off (for 99 in 100 of them), after any merges."""
    return 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, column: str, k: int = 200, keys: list[str] | None = None) -> DataFrame:
    """(keys, sketch): a quantile sketch of about k numbers for each date (or other keys), to be stored. Partial sketches
    are merged, so a hot date is not the work of one task; missing values don't count."""
    keys = keys or ["trade_date"]
    x = F.col(column).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, levels: list[float], keys: list[str]) -> DataFrame:
    """(keys, n, level, value) from stored sketches that are merged by other, coarser keys, such as years: no row of the
    panel is read again, and new dates only add sketches."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    each = F.array(*[F.struct(F.lit(q).alias("level"), F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias("value")) for q in map(float, levels)])
    return merged.select(*keys, F.kll_sketch_get_n_double("_s").alias("n"), F.inline(each))


def composite(df: DataFrame, columns: list[str], weights: list[float] | None = None, out: str = "value") -> DataFrame:
    """The weighted sum of z-scores (equal weights of 1 by default)."""
    weights = weights or [1.0] * len(columns)
    return df.withColumn(out, sum((w * zscore(F.col(c), by_date()) for c, w in zip(columns, weights, strict=True)), F.lit(0.0)))


def demean_market(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """value / mean of the date - 1."""
    return df.withColumn(out, F.try_divide(F.col(column), F.avg(column).over(by_date())) - 1)


def rolling(column: Column | str, n: int, kind: str, least: int | None = None, other: Column | str | None = None) -> Column:
    """mean, std (sample), sum or corr of the last n rows, the row included; null with fewer than `least` values."""
    w = by_instrument().rowsBetween(-(n - 1), 0)
    x = F.col(column) if isinstance(column, str) else column
    seen = F.count(x).over(w)
    if kind == "corr":
        y = F.col(other) if isinstance(other, str) else other
        both = x.isNotNull() & y.isNotNull()
        a, b = F.when(both, x), F.when(both, y)
        seen = F.count(a).over(w)
        out = F.try_divide(F.covar_pop(a, b).over(w), F.nullif(F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w), F.lit(0.0)))
    else:
        out = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[kind](x).over(w)
    return F.when(seen >= (n if least is None else least), out)


def momentum(column: str, n: int) -> Column:
    """The return over n rows; null for the first n."""
    return simple_return(F.col(column), F.lag(column, n).over(by_instrument()))


def reversal(column: str, n: int) -> Column:
    return -momentum(column, n)


def ma_ratio(column: str, short: int, long: int) -> Column:
    return F.try_divide(rolling(column, short, "mean"), rolling(column, long, "mean")) - 1


def composite_daily(df: DataFrame) -> DataFrame:
    """z(20-day return) + z(1 / 20-day std) + z(20-day over 60-day mean turnover) + z(roe): one stage by instrument,
    one by date."""
    w = by_instrument()
    staged = df.withColumn("_r", simple_return(F.col("close"), F.lag("close").over(w))).withColumns(
        {
            "c1": momentum("close", 20),
            "c2": F.try_divide(F.lit(1.0), rolling("_r", 20, "std")),
            "c3": F.try_divide(rolling("turnover_rate", 20, "mean"), rolling("turnover_rate", 60, "mean")),
            "c4": F.col("roe"),
        }
    )
    return composite(staged, ["c1", "c2", "c3", "c4"]).drop("_r", "c1", "c2", "c3", "c4")


def cs_quality(df: DataFrame, with_debt: bool = True) -> DataFrame:
    """The mean of the z-scores of roe, gross_margin, revenue_yoy and, with_debt, the negated debt_to_asset."""
    parts = [F.col("roe"), F.col("gross_margin"), F.col("revenue_yoy"), *([-F.col("debt_to_asset")] if with_debt else [])]
    return df.withColumn("value", sum((zscore(p, by_date()) for p in parts), F.lit(0.0)) / len(parts))


def price_volume_factors(df: DataFrame) -> DataFrame:
    """Five published-style price and volume factors; their forms are ours:

    ma_reversal = 1 - MA5 / MA20; pv_corr = 20-day correlation of close and volume; volatility = 20-day std of
    returns; ma_gap = close / MA20 - 1; volume_reversal = 1 - 5-day over 20-day mean volume.
    """
    r = simple_return(F.col("close"), F.lag("close").over(by_instrument()))
    return df.withColumn("_r", r).withColumns(
        {
            "ma_reversal": -ma_ratio("close", 5, 20),
            "pv_corr": rolling("close", 20, "corr", other="volume"),
            "volatility": rolling("_r", 20, "std"),
            "ma_gap": F.try_divide(F.col("close"), rolling("close", 20, "mean")) - 1,
            "volume_reversal": 1 - F.try_divide(rolling("volume", 5, "mean"), rolling("volume", 20, "mean")),
        }
    ).drop("_r")


def volume_amplitude_factors(df: DataFrame) -> DataFrame:
    """Three 20-day factors and their equal-weight composite; the forms are ours:

    signed_volume = sum of volume signed by the day's move over total volume; amplitude_jump = amplitude (high over
    low, less 1) over its 20-day mean, less 1; extreme_share = share of days whose |return| is above 1.5 times the
    20-day mean of |return|.
    """
    w = by_instrument()
    r = simple_return(F.col("close"), F.lag("close").over(w))
    s = df.withColumns({"_r": r, "_a": F.try_divide("high", "low") - 1})
    s = s.withColumns({"_m": rolling(F.abs("_r"), 20, "mean")})
    s = s.withColumns(
        {
            "signed_volume": F.try_divide(rolling(F.signum("_r") * F.col("volume"), 20, "sum"), rolling("volume", 20, "sum")),
            "amplitude_jump": F.try_divide(F.col("_a"), rolling("_a", 20, "mean")) - 1,
            "extreme_share": rolling((F.abs("_r") > 1.5 * F.col("_m")).cast("double"), 20, "mean"),
        }
    )
    return composite(s, ["signed_volume", "amplitude_jump", "extreme_share"], [1 / 3] * 3, "volume_amplitude").drop("_r", "_a", "_m")


def beta_to_index(df: DataFrame, n: int) -> DataFrame:
    """Rolling covariance with index_ret over its variance, on n rows."""
    w = by_instrument().rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(w) >= n
    beta = F.try_divide(F.covar_samp("ret", "index_ret").over(w), F.nullif(F.var_samp("index_ret").over(w), F.lit(0.0)))
    return df.withColumn("beta", F.when(full, beta))


def warmup_skip(df: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """Rows from the calendar's n-th date on."""
    return df.join(F.broadcast(calendar.where(F.col("idx") >= n).select("trade_date")), "trade_date", "left_semi")
