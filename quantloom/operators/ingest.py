"""Ingest, repair and deduplication of panels. Keys are (instrument, trade_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import by_instrument, strip_code

KEYS = ["instrument", "trade_date"]


def derive_amount(df: DataFrame) -> DataFrame:
    """amount = volume * close where it is absent."""
    product = F.col("volume") * F.col("close")
    return df.withColumn("amount", F.coalesce("amount", product) if "amount" in df.columns else product)


def upsert_combine_first(new: DataFrame, old: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Column by column the new value if there is one, else the old; all rows and columns of both."""
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    n, o = (x.select(*keys, F.struct(*[c for c in x.columns if c not in keys]).alias(k)) for x, k in ((new, "_n"), (old, "_o")))
    both = n.join(o, keys, "full")
    pick = lambda c: F.coalesce(*[F.col(k)[c] for k, x in (("_n", new), ("_o", old)) if c in x.columns]).alias(c)
    return both.select(*keys, *[pick(c) for c in columns])


def fill_derived(df: DataFrame) -> DataFrame:
    """pct_chg and pre_close where they are null, from the last close that is known before the row."""
    before = F.last("close", ignorenulls=True).over(by_instrument().rowsBetween(Window.unboundedPreceding, -1))
    change = (F.try_divide("close", before) - 1) * 100
    old = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    return df.withColumns({"pct_chg": F.coalesce(old("pct_chg"), change), "pre_close": F.coalesce(old("pre_close"), before)})


def left_fill(daily: DataFrame, extra: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """A side source joined on its exact keys; values that are there stay."""
    side = extra.select(*keys, *[F.col(c).alias(f"_x_{c}") for c in columns])
    joined = daily.join(side, keys, "left")
    return joined.withColumns({c: F.coalesce(c, f"_x_{c}") if c in daily.columns else F.col(f"_x_{c}") for c in columns}).drop(*[f"_x_{c}" for c in columns])


def merge_dup_dates(df: DataFrame, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """One row for each key: in each column the first value, by the order columns, that is not null."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in df.columns if c not in (*keys, *order)])


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key by the order columns."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() if isinstance(c, str) else c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def duplicate_report(df: DataFrame) -> DataFrame:
    """(instrument, rows_before, rows_after, duplicates)."""
    return df.groupBy("instrument").agg(F.count("*").alias("rows_before"), F.countDistinct("trade_date").alias("rows_after")).withColumn("duplicates", F.col("rows_before") - F.col("rows_after"))


def no_duplicates(df: DataFrame) -> bool:
    """The check after a repair."""
    return df.groupBy(*KEYS).count().where("count > 1").isEmpty()


def _is_padded(code: Column) -> Column:
    return (F.length(code) == 6) & code.startswith("0")


def reconcile_codes(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(panel, dropped codes): rows under zero-padded codes go to the bare code and win there by key; padded codes
    without a bare partner are reported and dropped. Derived columns are filled again."""
    code = F.col("instrument")
    bare = df.where(~_is_padded(code)).withColumn("_wins", F.lit(0))
    padded = df.where(_is_padded(code)).withColumn("_code", code).withColumn("instrument", strip_code(code)).withColumn("_wins", F.lit(1))
    known = bare.select("instrument").distinct()
    dropped = padded.join(known, "instrument", "left_anti").select(F.col("_code").alias("instrument")).distinct()
    both = bare.unionByName(padded.join(known, "instrument", "left_semi").drop("_code"))
    return fill_derived(dedup_keep_last(both, KEYS, ["_wins", *order]).drop("_wins")), dropped


def merged_universe(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Bare codes of the panel and codes seen before, with their place in numeric order."""
    codes = df.select("instrument").union(seen.select("instrument")).where(~_is_padded(F.col("instrument"))).distinct()
    return codes.withColumn("position", F.row_number().over(Window.orderBy(F.col("instrument").try_cast("long"), "instrument")) - 1)


def build_limit_up(daily: DataFrame, threshold: float = 9.5) -> DataFrame:
    """(trade_date, instrument, pct_chg) of the days with a change of at least the threshold, in percent."""
    return daily.where(F.col("pct_chg") >= threshold).select("trade_date", "instrument", "pct_chg")


def industry_map(df: DataFrame, order: str) -> DataFrame:
    """(instrument, industry): the name, else the code, of the industry; empty ones dropped, the last row of a code wins."""
    out = df.select(strip_code(F.col("code")).alias("instrument"), F.coalesce(F.nullif(F.trim("industry_name"), F.lit("")), F.nullif(F.trim("industry"), F.lit(""))).alias("industry"), order)
    out = out.where("industry is not null and instrument is not null and instrument <> ''")
    return dedup_keep_last(out, ["instrument"], [order]).drop(order)


def industry_counts(industries: DataFrame) -> DataFrame:
    return industries.agg(F.count("*").alias("n_instruments"), F.countDistinct("industry").alias("n_industries"))


def systematic_sample(universe: DataFrame, n: int = 300) -> DataFrame:
    """n codes at equal steps of the sorted list; all if there are no more."""
    codes = universe.select("instrument").distinct()
    total = codes.count()
    if total <= n:
        return codes
    ranked = codes.withColumn("position", F.row_number().over(Window.orderBy("instrument")) - 1)
    picks = codes.sparkSession.range(n).select(F.floor(F.col("id") * total / n).cast("int").alias("position"))
    return ranked.join(F.broadcast(picks), "position").select("instrument")


def last_n_rows(df: DataFrame, n: int = 600) -> DataFrame:
    """The most recent n rows of each instrument."""
    w = Window.partitionBy("instrument").orderBy(F.desc("trade_date"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_n_dates(df: DataFrame, n: int, per_instrument: bool = False) -> DataFrame:
    """Rows of the last n distinct dates, of each instrument or of the table."""
    if per_instrument:
        w = Window.partitionBy("instrument").orderBy(F.desc("trade_date"))
        return df.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= n).drop("_n")
    days = df.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return df.join(F.broadcast(days), "trade_date", "left_semi")
