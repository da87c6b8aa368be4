"""Walk-forward linear model: for each year trained on the rows before it, then scored on its dates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import by_instrument, simple_return
from ..operators.windows import momentum, rolling

FEATURES = ("f_ret20", "f_std20", "f_turn", "f_gap")


def features(df: DataFrame, horizon: int = 5) -> DataFrame:
    """20-day return and std, 20-day over 60-day mean turnover, gap to MA20; label: the return of the next rows, and
    label_date, the date on which it is known."""
    w = by_instrument()
    r = df.withColumn("_r", simple_return(F.col("close"), F.lag("close").over(w)))
    return r.select(
        "instrument", "trade_date", momentum("close", 20).alias("f_ret20"), rolling("_r", 20, "std").alias("f_std20"),
        F.try_divide(rolling("turnover_rate", 20, "mean"), rolling("turnover_rate", 60, "mean")).alias("f_turn"),
        (F.try_divide(F.col("close"), rolling("close", 20, "mean")) - 1).alias("f_gap"),
        simple_return(F.lead("close", horizon).over(w), F.col("close")).alias("label"), F.lead("trade_date", horizon).over(w).alias("label_date"),
    )


def walk_forward(df: DataFrame, names: tuple[str, ...] = FEATURES, least: int = 50, ridge: float = 1e-6) -> DataFrame:
    """(instrument, trade_date, value): the model's score.

    A row trains the years after the one in which its label is known, so no label looks past the cut. Sums of
    products by year are added up over the years before; the solve sees a few numbers a year.
    """
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    k = len(x)
    full = df.where(" and ".join(f"{n} is not null" for n in names))
    train = full.where("label is not null").withColumn("year", F.year("label_date"))
    sums = {f"s_{i}_{j}": F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)} | {f"y_{i}": F.sum(x[i] * F.col("label")) for i in range(k)} | {"n": F.count("*")}
    yearly = train.groupBy("year").agg(*[c.alias(n) for n, c in sums.items()])
    years = full.select(F.year("trade_date").alias("year")).distinct().join(yearly, "year", "left")
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # a row for each year
    added = years.select("year", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])

    def solve(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                if r["n"] < least:
                    continue
                a = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                y = np.array([r[f"y_{i}"] for i in range(k)], float)
                a += ridge * np.diag(np.r_[0.0, np.diag(a)[1:]])
                out.append((int(r["year"]), np.linalg.lstsq(a, y, rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=["year", "coef"])

    models = added.mapInPandas(solve, "year int, coef array<double>")
    scored = full.withColumn("year", F.year("trade_date")).join(F.broadcast(models), "year")  # a row for each year
    value = sum((x[i] * F.col("coef")[i] for i in range(1, k)), F.col("coef")[0])
    return scored.select("instrument", "trade_date", value.alias("value"))
