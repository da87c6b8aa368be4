"""Panels from an order table and an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000 + 0.5) / 10000
    return lines.groupBy("instrument", "trade_date").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"), F.round(F.avg("l_discount"), 8).alias("turnover_rate"),
        F.round(F.avg("l_tax"), 8).alias("roe"), F.max("l_discount").alias("gross_margin"), F.min("l_tax").alias("revenue_yoy"),
        F.round(F.avg("l_quantity") / 50, 8).alias("debt_to_asset"), (1 + F.min("l_tax")).alias("factor"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: suppliers are instruments, ship dates the dates, and unit prices the prices."""
    lines = read(spark, sf_dir, "lineitem").withColumn("instrument", F.col("l_suppkey").cast("string")).withColumn("trade_date", F.to_date("l_shipdate"))
    return _bars(lines)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of parts; a date is the first of its month."""
    lines = read(spark, sf_dir, "lineitem").withColumn("instrument", F.col("l_partkey").cast("string")).withColumn("trade_date", F.to_date(F.trunc("l_shipdate", "month")))
    return _bars(lines)


def minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday ticks: users are instruments, the value is the price and k of the properties the volume."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("instrument"), F.col("ts").cast("timestamp").alias("datetime"), F.to_date("ts").alias("trade_date"), F.col("event_id").alias("seq"),
        F.col("value").alias("close"), F.col("value").alias("high"), F.col("value").alias("low"), F.col("value").alias("vwap"),
        F.from_json("props", "k double")["k"].alias("volume"),
    )


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, industry): the nation of each supplier."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("string").alias("instrument"), F.col("n_name").alias("industry"))
