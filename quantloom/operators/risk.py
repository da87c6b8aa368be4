"""Style-factor regression of long-short returns: sums of products in Spark, a small solve for each factor."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def ols_exposure(rows: DataFrame, y: str, names: list[str], least: int = 30) -> DataFrame:
    """(factor_name, name, coef, tstat, pvalue, r_squared, adj_r_squared, n_days): a row for alpha and each regressor.

    One aggregate pass gives the sums of products of each factor; the solve sees (k + 2)^2 numbers a factor.
    Factors with fewer than `least` days, or with collinear regressors, have no rows.
    """
    columns = {"alpha": F.lit(1.0)} | {n: F.col(n).cast("double") for n in names} | {"_y": F.col(y).cast("double")}
    keys = list(columns)
    whole = rows.where(" and ".join(f"`{c}` is not null" for c in [y, *names]))
    # deviations from a first value keep the sums well scaled; means are small here, so plain products do
    products = [F.sum(columns[a] * columns[b]).alias(f"s_{i}_{j}") for i, a in enumerate(keys) for j, b in enumerate(keys) if i <= j]
    sums = whole.groupBy("factor_name").agg(*products).where(F.col("s_0_0") >= least)
    k = len(keys) - 1

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in batch.iterrows():
            s = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
            n, xx, xy, yy = s[0, 0], s[:k, :k], s[:k, k], s[k, k]
            if n <= k or np.linalg.matrix_rank(xx) < k:
                continue
            inverse = np.linalg.inv(xx)
            coef = inverse @ xy
            rss = max(0.0, yy - coef @ xy)
            tss = yy - s[0, k] ** 2 / n
            r2 = 1 - rss / tss if tss > 0 else float("nan")
            adjusted = 1 - (1 - r2) * (n - 1) / (n - k)
            error = np.sqrt(rss / (n - k) * np.diag(inverse))
            for i in range(k):
                t = coef[i] / error[i] if error[i] > 0 else float("nan")
                p = t_pvalue(t, n - k) if error[i] > 0 else float("nan")
                out.append((r["factor_name"], keys[i], round(coef[i], 6), round(t, 4), round(p, 6), r2, adjusted, int(n)))
        return pd.DataFrame(out, columns=["factor_name", "name", "coef", "tstat", "pvalue", "r_squared", "adj_r_squared", "n_days"])

    schema = "factor_name string, name string, coef double, tstat double, pvalue double, r_squared double, adj_r_squared double, n_days long"
    return sums.groupBy("factor_name").applyInPandas(solve, schema)


def exposure_map(exposures: DataFrame) -> DataFrame:
    """One row for each factor with its exposures as a map."""
    entry = F.struct("name", F.struct("coef", "tstat", "pvalue"))
    return exposures.groupBy("factor_name").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("exposures"), F.first("r_squared").alias("r_squared"), F.first("n_days").alias("n_days"))


def significant_exposures(exposures: DataFrame, t: float = 2.0) -> DataFrame:
    """The map's entries with |t| above t, marked ** for p < 0.01 and else *."""
    kept = F.map_filter("exposures", lambda k, v: F.abs(v["tstat"]) > t)
    return exposures.withColumn("significant", F.transform_values(kept, lambda k, v: F.when(v["pvalue"] < 0.01, "**").otherwise("*")))
