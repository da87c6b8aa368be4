"""From a factor table to its review in one call: scores, style exposures, coverage, gate and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as E, panel_joins as J, quality as Q, risk as R
from ..session import staged
from .factors import with_labels


def review(factors: DataFrame, daily: DataFrame, styles: DataFrame, names: list[str], least_days: int = 30) -> DataFrame:
    """One row for each factor of a long table (factor_name, trade_date, instrument, value): what evaluate(), annualized(),
    stocks_per_day_median(), coverage() and quality_gate() give, exposures and significant (maps by style), r_squared,
    and reasons for a second look.

    styles: (trade_date, a column for each of names). The labelled rows are staged, as all statistics read them; what is
    joined at the end has a row for each factor.
    """
    grid = daily.agg(F.countDistinct("trade_date"), F.countDistinct("instrument")).first()
    rows = staged(with_labels(factors, daily), "labelled")
    ls = staged(E.long_short_daily(E.decile_returns_daily(rows)), "long_short")
    exposures = R.significant_exposures(R.exposure_map(R.ols_exposure(J.align_series(ls, styles, least_days, ["factor_name"]), "ls", names)))
    out = Q.coverage(factors, *grid).join(Q.quality_gate(factors, *grid), "factor_name")
    for part in (E.evaluate(rows), E.annualized(ls), Q.stocks_per_day_median(factors), exposures.drop("n_days")):
        out = out.join(part, "factor_name", "left")
    return Q.review_flags(out)


def accepted(reviewed: DataFrame) -> DataFrame:
    """Factors that pass the gate and give no reason for a second look."""
    return reviewed.where(F.col("passes") & (F.size("reasons") == 0))
