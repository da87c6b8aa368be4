"""Streams of minute bars: ingest with deduplication, day or n-minute bars with a cut-off for late data, and day factors
that follow from the bars in the same stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.columns import strip_code
from ..operators.ingest import dedup_keep_last
from ..session import delete


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, in the common layout (instrument, datetime, trade_date, ...)."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("instrument", strip_code(F.col("instrument"))).withColumn("datetime", F.col("datetime").cast("timestamp")).withColumn("trade_date", F.to_date("datetime"))


def dedup_stream(df: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of each (instrument, datetime); state is kept for the delay only."""
    return df.withWatermark("datetime", delay).dropDuplicatesWithinWatermark(["instrument", "datetime"])


def ingest_keep_last(df: DataFrame, path: str, checkpoint: str, order: str = "seq", staging: str | None = None) -> StreamingQuery:
    """Upserts each batch into a table by date: of equal (instrument, datetime) the last by the order column stays.

    Only the dates of a batch are rewritten, so a batch that is repeated after a failure changes nothing.
    """
    staging = staging or f"{path}_staging"

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = dedup_keep_last(batch, ["instrument", "datetime"], [order])
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            # a batch's dates are days of a calendar, so they are few; as literals they prune the table's partitions
            days = [r["trade_date"] for r in batch.select("trade_date").distinct().collect()]
            old = spark.read.schema(batch.schema).parquet(path).where(F.col("trade_date").isin(days))
            fresh = dedup_keep_last(old.select(*batch.columns).unionByName(fresh), ["instrument", "datetime"], [order])
        # the dates are read and rewritten, so they pass through a table of their own
        fresh.write.mode("overwrite").parquet(f"{staging}/{number}")
        spark.read.schema(fresh.schema).parquet(f"{staging}/{number}").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)
        delete(spark, f"{staging}/{number}")

    return df.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of any form needs this store; it keeps state on disk, with its changes in the checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(column: pd.Series, kind: T.DataType | None = None) -> list:
    """A column's values as Python objects, missing ones as None; whole numbers stay whole beside missing ones."""
    of = int if isinstance(kind, T.IntegralType) else lambda v: v
    return [None if v is pd.NaT or v is None or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else of(v) for v in column.tolist()]


def keep_last_stream(df: DataFrame, delay: str = "1 day", order: str = "seq") -> DataFrame:
    """Each bar once: of equal (instrument, datetime) the last by the order column, given out when its day is closed.

    The state holds the bars of the open days only, each under a key of its own, so no stored date is read or written
    again, and a bar that comes writes no other one. A day is closed when a bar has come that is `delay` later than its
    end; a bar of a closed day is dropped. df has trade_date, the date of datetime. The bars of the open days are in
    open_rows(). Built-ins only: no bar passes through Python.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # the watermark is on the day alone: the time within it is a number
    key = ["instrument", F.window("datetime", "1 day").alias("w"), F.unix_micros("datetime").alias("at")]
    # in a struct, a missing order is the least
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(order))
    return df.withWatermark("datetime", delay).groupBy(*key).agg(last.alias("r")).select("r.*")


def open_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bars that a stopped keep_last_stream() still holds."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(F.col("value").getField(held.schema["value"].dataType.names[0]).alias("r")).select("r.*")


class RollingMean(StatefulProcessor):
    """Means of the last n days' values of an instrument; days come in order, as the watermark closes them."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("values", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("trade_date")
        found = self.values.get()
        held = list(found[0]) if found else []
        all_ = pd.Series([*held, *_plain(new["value"])], dtype=float)
        self.values.update(([None if v != v else v for v in all_.tolist()[-(self.n - 1) :]] if self.n > 1 else [],))
        mean = all_.rolling(self.n, min_periods=1).mean().to_numpy()[len(held) :]
        yield pd.DataFrame({"instrument": key[0], "trade_date": new["trade_date"], "value": mean})

    def close(self) -> None:
        pass


def stream_day_factor(df: DataFrame, value: Column, n: int = 20, delay: str = "1 hour") -> DataFrame:
    """(instrument, trade_date, value): the mean of the last n days (those with bars) of an aggregate of a day's bars.

    Two stateful operators in one stream: the day's aggregate goes on when the watermark closes the day, and the state
    behind it has n - 1 numbers for an instrument. Equal to the same factor of a table on all closed days.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    days = df.withWatermark("datetime", delay).groupBy("instrument", F.window("datetime", "1 day").alias("w")).agg(value.alias("value"))
    days = days.select("instrument", F.to_date("w.start").alias("trade_date"), F.col("value").cast("double"))
    return days.groupBy("instrument").transformWithStateInPandas(RollingMean(n), "instrument string, trade_date date, value double", "Append", "None")


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy("trade_date").trigger(availableNow=True).start()


def stream_day_bars(df: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling bars of an event-time stream (or of a table); rows later than the delay are cut off.

    Rows of one time stamp go by seq, if there is one.
    """
    place = F.struct("datetime", *(["seq"] if "seq" in df.columns else []))
    bars = df.withWatermark("datetime", delay).groupBy("instrument", F.window("datetime", width).alias("w")).agg(
        F.min_by("close", place).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", place).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    return bars.select("instrument", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")
