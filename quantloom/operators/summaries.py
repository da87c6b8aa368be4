"""Summaries of a factor's series that merge: of stretches of dates, joined in order, and extended by new days without the
old ones.

Drawdown: a stretch is its compounded return, the greatest and the least of its running products and its deepest fall. Of
two stretches one after the other, the fall across the border is from the first one's greatest product to the second
one's least. That is associative, so years are summed up apart and joined (a row for each). Returns are above -100 %.

Curve: a stretch's running sums begin at the sum of the stretches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Of a stretch: product of 1 + r, greatest and least running product, deepest fall as a ratio to the peak, last date.
PARTS = ("product", "greatest", "least", "fall", "last_date")


def _join(a: Column, b: Column) -> Column:
    """The summary of stretch a and then stretch b."""
    across = a["product"] * b["least"] / a["greatest"]
    return F.struct(
        (a["product"] * b["product"]).alias("product"), F.greatest(a["greatest"], a["product"] * b["greatest"]).alias("greatest"), F.least(a["least"], a["product"] * b["least"]).alias("least"),
        F.least(a["fall"], b["fall"], across).alias("fall"), b["last_date"].alias("last_date"),
    )


def _joined(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One summary for each key, of its rows' summaries (column s) in order."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "s"))).alias("all"))
    rest = F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0)))
    return rows.select(*keys, F.aggregate(rest, F.col("all")[0]["s"], lambda a, b: _join(a, b["s"])).alias("s"))


def drawdown_summary(ls: DataFrame) -> DataFrame:
    """(factor_name, product, greatest, least, fall, last_date) of a series (factor_name, trade_date, ls), by way of years:
    a year of a factor is the most that one task joins."""
    r = 1 + F.col("ls")
    day = F.struct(r.alias("product"), r.alias("greatest"), r.alias("least"), F.lit(1.0).alias("fall"), F.col("trade_date").alias("last_date"))
    days = ls.select("factor_name", "trade_date", F.year("trade_date").alias("year"), day.alias("s"))
    years = _joined(days, ["factor_name", "year"], "trade_date")
    return _joined(years, ["factor_name"], "year").select("factor_name", "s.*")


def extend_drawdown(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A stored summary with the days of new (factor_name, trade_date, ls) that are behind its last date."""
    late = new.join(stored.select("factor_name", "last_date"), "factor_name", "left").where("last_date is null or trade_date > last_date")
    a, b = (x.select("factor_name", F.struct(*PARTS).alias(n)) for x, n in ((stored, "a"), (drawdown_summary(late.select("factor_name", "trade_date", "ls")), "b")))
    both = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(_join(F.col("a"), F.col("b")))
    return a.join(b, "factor_name", "full").select("factor_name", both.alias("s")).select("factor_name", "s.*")


def drawdown(summary: DataFrame) -> DataFrame:
    """What max_drawdown() gives."""
    return summary.select("factor_name", (F.col("fall") - 1).alias("long_short_max_drawdown"))


def running_sums(df: DataFrame, keys: list[str], value: str, stored: DataFrame | None = None, out: str = "cum") -> DataFrame:
    """Running sums of a series by date for each key, by way of years: windows span a year of a key.

    stored: (keys, out), the sums so far; df has the new days then.
    """
    years = df.groupBy(*keys, F.year("trade_date").alias("_year")).agg(F.sum(value).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1))
    offset = years.select(*keys, "_year", F.coalesce(before, F.lit(0.0)).alias("_before"))
    if stored is not None:
        offset = offset.join(stored.select(*keys, F.col(out).alias("_stored")), keys, "left").withColumn("_before", F.col("_before") + F.coalesce("_stored", F.lit(0.0))).drop("_stored")
    inside = Window.partitionBy(*keys, "_year").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_year", F.year("trade_date")).join(offset, [*keys, "_year"])
    return rows.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_year", "_before")


def last_sums(curve: DataFrame, keys: list[str], out: str = "cum") -> DataFrame:
    """(keys, out) on each key's last date: what running_sums() goes on from."""
    return curve.groupBy(*keys).agg(F.max_by(out, "trade_date").alias(out))
