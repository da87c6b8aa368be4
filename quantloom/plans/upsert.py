"""Upserts of a stored panel by the periods they change.

The panel is stored by period (a month of dates, say) and its derived columns are filled. New rows touch their own
periods; a null derived value in them may need the last close of an earlier one; and a new close may fill null derived
values of the rows behind it, up to the next row that has a close. The planner finds these periods, reads no others, and
overwrites those that change. The result is that of joining all rows and filling all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.ingest import KEYS, fill_derived, upsert_combine_first
from ..session import delete, scratch_dir

DERIVED = ("pct_chg", "pre_close")


def month(date: str = "trade_date") -> Column:
    return F.date_format(date, "yyyy-MM")


@dataclass
class Upsert:
    """The stored schema after an upsert, and the periods that it read and wrote."""

    schema: T.StructType
    read: set[str] = field(default_factory=set)
    written: set[str] = field(default_factory=set)


def write_panel(df: DataFrame, path: str, period: Column | None = None) -> T.StructType:
    """Stores a panel by period, with filled derived columns, and returns its schema."""
    filled = fill_derived(df)
    filled.withColumn("period", month() if period is None else period).repartition("period").write.partitionBy("period").parquet(path)
    return filled.schema


def read_panel(spark: SparkSession, path: str, schema: T.StructType, periods: list[str] | None = None) -> DataFrame:
    """A stored panel with its period, or some periods of it: the others are not scanned."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("period", T.StringType())])).parquet(path)
    return df if periods is None else df.where(F.col("period").isin(periods))


def stored_periods(spark: SparkSession, path: str) -> list[str]:
    """The periods that are there, from the names of their folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(n.removeprefix("period=") for n in (f.getPath().getName() for f in found) if n.startswith("period="))


def _chunks(periods: list[str]) -> Iterator[list[str]]:
    """One period, then two, four, ...: what is looked for is near as a rule."""
    at, size = 0, 1
    while at < len(periods):
        yield periods[at : at + size]
        at, size = at + size, 2 * size


def upsert_panel(spark: SparkSession, path: str, schema: T.StructType, new: DataFrame, period: Column | None = None) -> Upsert:
    """Merges new rows (unique by instrument and date) into the panel at path: of each column the new value if there is
    one, else the old; then derived columns are filled where they are null."""
    period = month() if period is None else period
    new = new.withColumn("period", period)
    fresh = [T.StructField(f.name, f.dataType) for f in new.schema if f.name not in [*schema.names, "period"]]
    out = Upsert(T.StructType([*schema.fields, *fresh]))
    touched = sorted(r["period"] for r in new.select("period").distinct().collect())  # periods, so they are few
    known = sorted({*stored_periods(spark, path), *touched})
    # touched periods that follow each other are one interval; earlier ones are written before later ones read them
    at = [known.index(p) for p in touched]
    for n, i in enumerate(at):
        if n and i == at[n - 1] + 1:
            continue
        end = n
        while end + 1 < len(at) and at[end + 1] == at[end] + 1:
            end += 1
        _interval(spark, path, new.where(F.col("period").isin(touched[n : end + 1])), known[:i], touched[n : end + 1], known[at[end] + 1 :], out)
    return out


def _read(spark: SparkSession, path: str, out: Upsert, periods: list[str]) -> DataFrame:
    out.read |= set(periods)
    return read_panel(spark, path, out.schema, periods)


def _stage(df: DataFrame, name: str, staged: list[str]) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _replace(df: DataFrame, path: str, staged: list[str]) -> set[str]:
    """Overwrites the periods that df has; as df reads some of them, it passes through a table of its own."""
    df = _stage(df, "upsert", staged)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    return {r["period"] for r in df.select("period").distinct().collect()}


def _interval(spark: SparkSession, path: str, new: DataFrame, before: list[str], periods: list[str], behind: list[str], out: Upsert) -> None:
    staged: list[str] = []
    old = _read(spark, path, out, periods)
    columns = out.schema.names
    merged = _stage(upsert_combine_first(new, old, [*KEYS, "period"]).select(*columns, "period"), "merged", staged)
    # instruments that lack a derived value before their first close of the interval
    first = F.min(F.when(F.col("close").isNotNull(), F.col("trade_date")))
    lack = F.min(F.when(F.col("pre_close").isNull() | F.col("pct_chg").isNull() & F.col("close").isNotNull(), F.col("trade_date")))
    wanted = merged.groupBy("instrument").agg(first.alias("first"), lack.alias("lack")).where("lack is not null and (first is null or lack <= first)").select("instrument")
    wanted, prior = _stage(wanted, "wanted", staged), None
    for chunk in _chunks(before[::-1]):
        if wanted.isEmpty():
            break
        rows = _read(spark, path, out, chunk).where("close is not null").select("instrument", "trade_date", "close")
        last = rows.join(wanted, "instrument", "left_semi").groupBy("instrument").agg(F.max("trade_date").alias("trade_date"), F.max_by("close", "trade_date").alias("close"))
        last = _stage(last, "prior", staged)
        prior = last if prior is None else prior.unionByName(last)
        wanted = _stage(wanted.join(last, "instrument", "left_anti"), "wanted", staged)
    rows = merged.withColumn("_new", F.lit(True))
    if prior is not None:
        rows = rows.unionByName(prior.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    filled = fill_derived(rows).where("_new").select(*columns, "period")
    out.written |= _replace(filled, path, staged)
    _fill_behind(spark, path, new.select("instrument").distinct(), periods, behind, prior, out, staged)
    for place in staged:
        delete(spark, place)


def _fill_behind(spark: SparkSession, path: str, touched: DataFrame, periods: list[str], behind: list[str], prior: DataFrame | None, out: Upsert, staged: list[str]) -> None:
    """Null derived values behind the interval, up to each touched instrument's next close."""
    closes = _read(spark, path, out, periods).where("close is not null").select("instrument", "trade_date", "close")
    closes = closes if prior is None else closes.unionByName(prior.select("instrument", "trade_date", "close"))
    open_ = closes.join(touched, "instrument", "left_semi").groupBy("instrument").agg(F.max_by("close", "trade_date").alias("_last"))
    if behind:
        open_ = _stage(open_, "open", staged)
    for chunk in _chunks(behind):
        if open_.isEmpty():
            return
        rows = _read(spark, path, out, chunk)
        mine = rows.select("instrument", "trade_date", "period", "close", *DERIVED).join(open_, "instrument")
        seen = mine.groupBy("instrument").agg(F.min(F.when(F.col("close").isNotNull(), F.col("trade_date"))).alias("_until"))
        seen = _stage(open_.join(seen, "instrument", "left"), "seen", staged)
        reach = (F.col("_until").isNull() | (F.col("trade_date") <= F.col("_until"))) & F.col("_last").isNotNull()
        change = (F.try_divide("close", F.col("_last")) - 1) * 100
        gains = reach & (F.col("pre_close").isNull() | F.col("pct_chg").isNull() & change.isNotNull())
        hit = sorted(r["period"] for r in mine.drop("_last").join(seen, "instrument").where(gains).select("period").distinct().collect())
        if hit:
            all_ = rows.where(F.col("period").isin(hit)).join(seen, "instrument", "left")
            fill = {"pct_chg": F.when(reach, F.coalesce("pct_chg", change)).otherwise(F.col("pct_chg")), "pre_close": F.when(reach, F.coalesce("pre_close", "_last")).otherwise(F.col("pre_close"))}
            out.written |= _replace(all_.withColumns(fill).select(*out.schema.names, "period"), path, staged)
        open_ = _stage(seen.where("_until is null").select("instrument", "_last"), "open", staged)
