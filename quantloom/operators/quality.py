"""Coverage, gates, review flags, hashes and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def stocks_per_day_median(df: DataFrame) -> DataFrame:
    """The median over dates of the number of values, truncated."""
    days = df.groupBy("factor_name", "trade_date").agg(F.count("value").alias("n"))
    return days.groupBy("factor_name").agg(F.percentile("n", F.lit(0.5)).cast("int").alias("n_stocks_per_day"))


def coverage(df: DataFrame, n_dates: int, n_instruments: int) -> DataFrame:
    """rows (dates), stock_count, non_null and its share of the full grid (4 digits), first and last date with values."""
    seen = F.when(F.col("value").isNotNull(), F.col("trade_date"))
    return df.groupBy("factor_name").agg(F.lit(n_dates).alias("rows"), F.lit(n_instruments).alias("stock_count"), F.count("value").alias("non_null"), F.round(F.count("value") / F.lit(float(max(1, n_dates * n_instruments))), 4).alias("non_null_ratio"), F.min(seen).alias("first_date"), F.max(seen).alias("last_date"))


def quality_gate(df: DataFrame, n_dates: int, n_instruments: int, least: float = 0.01) -> DataFrame:
    """sparse, empty, constant and passes for each factor."""
    ratio = F.count("value") / F.lit(float(max(1, n_dates * n_instruments)))
    out = df.groupBy("factor_name").agg((ratio < least).alias("sparse"), (F.count("value") == 0).alias("empty"), F.coalesce(F.min("value") == F.max("value"), F.lit(False)).alias("constant"))
    return out.withColumn("passes", ~(F.col("sparse") | F.col("empty") | F.col("constant")))


def review_flags(scores: DataFrame) -> DataFrame:
    """reasons for a review, from ic_mean, long_short_sharpe, r_squared and the map exposures."""
    strong = F.size(F.map_filter("exposures", lambda k, v: (k != "alpha") & (F.abs(v["tstat"]) > 3)))
    reasons = F.array(
        F.when(F.abs("ic_mean") < 0.005, "weak ic"),
        F.when(F.col("long_short_sharpe") < -1, "negative sharpe"),
        F.when((F.col("r_squared") > 0.25) & (strong >= 3), "style exposure"),
    )
    return scores.withColumn("reasons", F.array_compact(reasons))


def infer_granularity(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """minute, daily, the step in seconds, or unknown: from the smallest positive step of each instrument's stamps."""
    step = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(Window.partitionBy("instrument").orderBy(ts))
    least = df.select(step.alias("s")).where("s > 0").agg(F.min("s").alias("s"))
    kind = F.when(F.col("s").isNull(), "unknown").when(F.col("s") <= 60, "minute").when(F.col("s") >= 86400, "daily").otherwise(F.concat(F.format_number("s", 0), F.lit("s")))
    return least.select(kind.alias("granularity"))


def frame_hash(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """A content hash that does not depend on the order of rows: xor and sum of row hashes, and the count."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c not in (group or [])])
    return df.groupBy(*(group or [])).agg(F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.count("*").alias("n"))


def top_factors(scores: DataFrame, k: int = 3, t: float = 2.0) -> DataFrame:
    """The k factors of each type with the largest |alpha_t| above t."""
    w = Window.partitionBy("factor_type").orderBy(F.abs("alpha_t").desc(), "factor_name")
    return scores.where(F.abs("alpha_t") > t).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def factor_pending_status(names: DataFrame, stored: DataFrame, calendar: DataFrame, force: bool = False) -> DataFrame:
    """(factor_name, last_date, status): pending without a result, stale behind the calendar, else current."""
    last = stored.groupBy("factor_name").agg(F.max("trade_date").alias("last_date"))
    latest = calendar.agg(F.max("trade_date")).first()[0]
    status = F.when(F.lit(force) | F.col("last_date").isNull(), "pending").when(F.col("last_date") < F.lit(latest), "stale").otherwise("current")
    return names.select("factor_name").join(last, "factor_name", "left").withColumn("status", status)


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").count().withColumnRenamed("count", "n")
