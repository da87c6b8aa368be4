"""The registered queries over the order and event tables, each with the SQL that it must equal.

Sums of floats are rounded at the end, as their order differs between engines; ranks and bins only work on values
that both engines compute by the same operations, with the instrument as the tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .functions import columns as C
from .operators import evaluate as E, ingest as I, segment as G, minute as M, panel_joins as J, quality as Q, risk as R, scans as SC, summaries as SU, text as X, windows as W
from .plans import events as EV, factors as P, hash_tree as HT, incremental as N, review as RV, upsert as UP, user_functions as U, walk_forward as WF
from .session import scratch_dir, staged
from .sources import adapters as A, panels as S
from .streaming import minute_stream as ST

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# --- SQL of the panels ---------------------------------------------------------------------------------------

_LINES = """WITH li AS (SELECT CAST({key} AS VARCHAR) AS instrument, {day} AS trade_date, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS price,
 row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k, * FROM lineitem),
d AS (SELECT instrument, trade_date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
 sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, round(avg(l_discount), 8) AS turnover_rate, round(avg(l_tax), 8) AS roe,
 max(l_discount) AS gross_margin, min(l_tax) AS revenue_yoy, round(avg(l_quantity) / 50, 8) AS debt_to_asset, 1 + min(l_tax) AS factor
 FROM li GROUP BY instrument, trade_date)"""
DAILY = _LINES.format(key="l_suppkey", day="CAST(l_shipdate AS DATE)")
MONTHLY = _LINES.format(key="l_partkey", day="CAST(date_trunc('month', l_shipdate) AS DATE)")
WI = "(PARTITION BY instrument ORDER BY trade_date)"


def _rows(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RET = f"{DAILY}, r AS (SELECT *, close / lag(close) OVER {WI} - 1 AS ret FROM d)"
CAL = f"{DAILY}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM d))"
_EVAL = f""", f AS (SELECT instrument, trade_date, close / lag(close, 5) OVER {WI} - 1 AS m5, 1 - close / lag(close, 1) OVER {WI} AS r1,
 lead(close) OVER {WI} / close - 1 AS ret_next FROM d),
e AS (SELECT 'momentum_5' AS factor_name, trade_date, instrument, m5 AS value, ret_next FROM f WHERE m5 IS NOT NULL AND ret_next IS NOT NULL
 UNION ALL SELECT 'reversal_1', trade_date, instrument, r1, ret_next FROM f WHERE r1 IS NOT NULL AND ret_next IS NOT NULL)"""
EVAL = DAILY + _EVAL
_IC = """, ic AS (SELECT factor_name, trade_date, covar_pop(value, ret_next) / nullif(stddev_pop(value) * stddev_pop(ret_next), 0) AS ic
 FROM e GROUP BY factor_name, trade_date HAVING count(*) >= 3)"""
_RANKIC = """, rk AS (SELECT factor_name, trade_date, rank() OVER (PARTITION BY factor_name, trade_date ORDER BY value) + (count(*) OVER (PARTITION BY factor_name, trade_date, value) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY factor_name, trade_date ORDER BY ret_next) + (count(*) OVER (PARTITION BY factor_name, trade_date, ret_next) - 1) / 2.0 AS b FROM e),
ric AS (SELECT factor_name, trade_date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM rk GROUP BY factor_name, trade_date HAVING count(*) >= 3)"""
_DEC = """, rn AS (SELECT *, row_number() OVER (PARTITION BY factor_name, trade_date ORDER BY value, instrument) AS r, count(*) OVER (PARTITION BY factor_name, trade_date) AS n FROM e),
dc AS (SELECT *, greatest((10 * (r - 1) + n - 2) // greatest(n - 1, 1), 1) AS decile FROM rn WHERE n >= 10),
dd AS (SELECT factor_name, trade_date, CAST(decile AS INTEGER) AS decile, avg(ret_next) AS mean_ret FROM dc GROUP BY factor_name, trade_date, decile)"""
_LS = """, ls AS (SELECT factor_name, trade_date, avg(CASE WHEN decile = 1 THEN mean_ret END) - avg(CASE WHEN decile = 10 THEN mean_ret END) AS ls FROM dd GROUP BY factor_name, trade_date)"""
MINUTE = """WITH m AS (SELECT CAST(user_id AS VARCHAR) AS instrument, ts AS datetime, CAST(ts AS DATE) AS trade_date, event_id AS seq, value AS close, value AS high, value AS low, value AS vwap,
 CAST(json_extract(props, '$.k') AS DOUBLE) AS volume, hour(ts) * 60 + minute(ts) AS mod FROM events),
mr AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument, trade_date ORDER BY datetime, seq) - 1 AS ret FROM m)"""


def _panel(spark, sf: str, source=A.daily) -> DataFrame:
    """The evaluation panel: two factors and the label."""
    d = source(spark, sf)
    f = d.select("instrument", "trade_date", W.momentum("close", 5).alias("momentum_5"), W.reversal("close", 1).alias("reversal_1"), C.simple_return(F.lead("close").over(C.by_instrument()), F.col("close")).alias("ret_next"))
    long = f.unpivot(["trade_date", "instrument", "ret_next"], ["momentum_5", "reversal_1"], "factor_name", "value")
    return long.where("value is not null and ret_next is not null").select("factor_name", "trade_date", "instrument", "value", "ret_next")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return add


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Floating-point columns rounded to the digits (a number, or by name with 4 for the others)."""
    of = lambda name: digits if isinstance(digits, int) else digits.get(name, 4)
    return df.select(*[F.round(f.name, of(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def ret_panel(spark, sf):
    d = A.daily(spark, sf)
    return d.withColumn("ret", C.simple_return(F.col("close"), F.lag("close").over(C.by_instrument())))


def ticks(spark, sf):
    return M.bar_returns(A.minute(spark, sf))


# --- sources and sinks ---------------------------------------------------------------------------------------


@query(f"{DAILY} SELECT instrument, trade_date, open, close, volume FROM d")
def read_daily(spark, sf):
    path = scratch_dir(spark, "daily")
    A.daily(spark, sf).select("instrument", F.date_format("trade_date", "yyyyMMdd").alias("datetime"), "open", "high", "close", "volume").write.parquet(path)
    return S.read_daily(spark, path, ["open", "close", "volume"])


@query(f"{MINUTE} SELECT instrument, CAST(epoch(date_trunc('second', datetime)) AS BIGINT) AS second, trade_date, close, volume FROM m WHERE trade_date IN (DATE '2024-01-03', DATE '2024-01-04')")
def read_minute(spark, sf):
    path = scratch_dir(spark, "minute")
    m = A.minute(spark, sf).withColumn("date", F.col("trade_date").cast("string")).drop("trade_date").withColumnsRenamed({"instrument": "symbol", "datetime": "trade_date"})
    m.write.partitionBy("date").parquet(path)
    return S.read_minute(spark, path, ["2024-01-03", "2024-01-04"], ["close", "volume"]).withColumn("second", F.floor(F.unix_timestamp("datetime")).cast("long")).drop("datetime")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS instrument, DATE '2020-01-02' + CAST(s_suppkey % 28 AS INTEGER) AS trade_date, s_acctbal FROM supplier")
def read_csv_source(spark, sf):
    path = scratch_dir(spark, "csv")
    s = A.read(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.date_format(F.expr("date_add(date'2020-01-02', cast(s_suppkey % 28 as int))"), "yyyyMMdd").alias("day"), "s_acctbal")
    s.write.csv(path, header=True)
    return S.read_csv_source(spark, path, "code string, day string, s_acctbal double", "code", "day")


@query(f"{DAILY} SELECT count(*) AS n_pending, min(trade_date) AS first_pending, max(trade_date) AS last_pending FROM (SELECT DISTINCT trade_date FROM d WHERE trade_date >= DATE '2000-01-01')")
def new_dates(spark, sf):
    d = A.daily(spark, sf)
    local = d.where("trade_date < date'2000-01-01'").select(F.date_format("trade_date", "yyyyMMdd").alias("trade_date"))
    return S.pending_summary(S.new_dates(d, local))


@query(f"{EVAL} SELECT factor_name, trade_date, instrument, value FROM e")
def write_factor_long(spark, sf):
    path = scratch_dir(spark, "long")
    S.write_factor_long(_panel(spark, sf).select("factor_name", "trade_date", "instrument", "value"), path)
    return spark.read.parquet(path).select("factor_name", "trade_date", "instrument", "value")


@query(f"{CAL} SELECT cal.trade_date, max(CASE WHEN instrument = '1' THEN close END) AS \"1\", max(CASE WHEN instrument = '2' THEN close END) AS \"2\", max(CASE WHEN instrument = '3' THEN close END) AS \"3\" FROM cal LEFT JOIN d USING (trade_date) GROUP BY cal.trade_date")
def write_factor_wide(spark, sf):
    d = A.daily(spark, sf)
    path = scratch_dir(spark, "wide")
    S.write_factor_wide(d.select(F.lit("price").alias("factor_name"), "trade_date", "instrument", F.col("close").alias("value")), S.calendar_of(d), ["1", "2", "3"], path)
    return spark.read.parquet(f"{path}/price")


@query(f"{CAL} SELECT cal.trade_date, u.instrument, close FROM cal CROSS JOIN (SELECT DISTINCT instrument FROM d) u LEFT JOIN d ON d.trade_date = cal.trade_date AND d.instrument = u.instrument")
def densify(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", "close")
    return S.densify(d, S.calendar_of(d), d.select("instrument").distinct())


@query(f"{DAILY} SELECT trade_date, instrument, close AS value FROM d WHERE instrument IN ('1', '2', '3')")
def wide_to_long(spark, sf):
    d = A.daily(spark, sf)
    wide = S.factor_wide(d.select("trade_date", "instrument", F.col("close").alias("value")), S.calendar_of(d), ["1", "2", "3"])
    return S.wide_to_long(wide.withColumn("Date", F.date_format("trade_date", "yyyy-MM-dd")).drop("trade_date"))


@query(f"{MINUTE}, p AS (SELECT instrument, row_number() OVER (ORDER BY instrument) - 1 AS pos FROM (SELECT DISTINCT instrument FROM m)) SELECT CAST(pos // 25 AS INTEGER) AS chunk, count(*) AS n, count(DISTINCT m.instrument) AS instruments FROM m JOIN p USING (instrument) GROUP BY 1")
def repartition_minute(spark, sf):
    m = S.repartition_minute(A.minute(spark, sf))
    chunks = S.chunk_ids(m.select("instrument"))
    return m.join(F.broadcast(chunks), "instrument").groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("instrument").alias("instruments"))


# --- ingest, repair, dedup -----------------------------------------------------------------------------------


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS bare, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS padded FROM lineitem")
def normalize_code(spark, sf):
    code = F.lpad(F.col("l_suppkey").cast("string"), 8, "0")
    return A.read(spark, sf, "lineitem").select(C.strip_code(code).alias("bare"), C.pad_code(code).alias("padded")).distinct()


@query(f"{DAILY} SELECT instrument, trade_date, CASE WHEN volume > 30 THEN round(amount, 2) ELSE volume * close END AS amount FROM d")
def derive_amount(spark, sf):
    d = A.daily(spark, sf).withColumn("amount", F.when(F.col("volume") > 30, F.round("amount", 2)))
    return I.derive_amount(d).select("instrument", "trade_date", "amount")


@query(f"""{DAILY}, o AS (SELECT instrument, trade_date, close, volume, roe FROM d WHERE trade_date < DATE '1999-06-01'),
 n AS (SELECT instrument, trade_date, CASE WHEN volume > 20 THEN close + 1 END AS close, volume, turnover_rate FROM d WHERE trade_date >= DATE '1999-01-01')
 SELECT instrument, trade_date, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume, o.roe, n.turnover_rate FROM o FULL JOIN n USING (instrument, trade_date)""")
def upsert_combine_first(spark, sf):
    d = A.daily(spark, sf)
    old = d.where("trade_date < date'1999-06-01'").select("instrument", "trade_date", "close", "volume", "roe")
    new = d.where("trade_date >= date'1999-01-01'").select("instrument", "trade_date", F.when(F.col("volume") > 20, F.col("close") + 1).alias("close"), "volume", "turnover_rate")
    return I.upsert_combine_first(new, old)


@query(f"""{DAILY}, g AS (SELECT instrument, trade_date, CASE WHEN volume <> 25 THEN close END AS close, volume, roe, turnover_rate FROM d),
 o AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre_close FROM g WHERE trade_date < DATE '1997-12-15' AND NOT (trade_date >= DATE '1995-03-06' AND trade_date < DATE '1995-03-20' AND volume % 2 = 0)),
 n AS (SELECT instrument, trade_date, CASE WHEN volume <> 25 THEN close + 1 END AS close, volume, turnover_rate FROM d WHERE trade_date >= DATE '1997-12-01' AND trade_date < DATE '1998-02-01' OR trade_date >= DATE '1995-03-06' AND trade_date < DATE '1995-03-20'),
 m AS (SELECT instrument, trade_date, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume, o.roe, coalesce(n.turnover_rate, o.turnover_rate) AS turnover_rate, o.pre_close, (o.close / o.pre_close - 1) * 100 AS pct_chg FROM o FULL JOIN n USING (instrument, trade_date)),
 p AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m)
 SELECT instrument, trade_date, close, volume, roe, turnover_rate, coalesce(pre_close, prev) AS pre_close, round(coalesce(pct_chg, (close / prev - 1) * 100), 6) AS pct_chg FROM p""")
def upsert_by_period(spark, sf):
    """New rows of two stretches of dates into a stored panel, by the months that they change."""
    d = A.daily(spark, sf)
    close, spring = F.when(F.col("volume") != 25, F.col("close")), "trade_date >= date'1995-03-06' and trade_date < date'1995-03-20'"
    old = d.where(f"trade_date < date'1997-12-15' and not ({spring} and volume % 2 = 0)").select("instrument", "trade_date", close.alias("close"), "volume", "roe", "turnover_rate")
    new = d.where(f"trade_date >= date'1997-12-01' and trade_date < date'1998-02-01' or {spring}").select("instrument", "trade_date", F.when(F.col("volume") != 25, F.col("close") + 1).alias("close"), "volume", "turnover_rate")
    path = scratch_dir(spark, "panel")
    done = UP.upsert_panel(spark, path, UP.write_panel(old, path), new)
    rows = UP.read_panel(spark, path, done.schema)
    return rows.select("instrument", "trade_date", "close", "volume", "roe", "turnover_rate", "pre_close", F.round("pct_chg", 6).alias("pct_chg"))


@query(f"""{DAILY}, g AS (SELECT instrument, trade_date, CASE WHEN volume <> 25 THEN close END AS close FROM d),
 p AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre_close FROM g)
 SELECT instrument, trade_date, close, pre_close, (close / pre_close - 1) * 100 AS pct_chg FROM p""")
def fill_derived(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", F.when(F.col("volume") != 25, F.col("close")).alias("close"))
    return I.fill_derived(d).select("instrument", "trade_date", "close", "pre_close", "pct_chg")


@query(f"""{DAILY} SELECT instrument, trade_date, coalesce(CASE WHEN volume > 25 THEN roe END, CASE WHEN instrument <> '5' THEN gross_margin END) AS roe, CASE WHEN instrument <> '5' THEN revenue_yoy END AS holders FROM d""")
def left_fill(spark, sf):
    d = A.daily(spark, sf)
    extra = d.where("instrument <> '5'").select("instrument", "trade_date", F.col("gross_margin").alias("roe"), F.col("revenue_yoy").alias("holders"))
    base = d.select("instrument", "trade_date", F.when(F.col("volume") > 25, F.col("roe")).alias("roe"))
    return I.left_fill(base, extra, ["roe", "holders"])


_DUP = "SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS trade_date, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k, CASE WHEN l_linenumber > 2 THEN l_tax END AS tax, CASE WHEN l_quantity > 20 THEN l_discount END AS discount FROM lineitem"


def _dup_rows(spark, sf):
    li = A.read(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("trade_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("tax"), F.when(F.col("l_quantity") > 20, F.col("l_discount")).alias("discount"))


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query(f"WITH x AS ({_DUP}) SELECT instrument, trade_date, arg_min(tax, k) FILTER (WHERE tax IS NOT NULL) AS tax, arg_min(discount, k) FILTER (WHERE discount IS NOT NULL) AS discount FROM x GROUP BY 1, 2")
def merge_dup_dates(spark, sf):
    return I.merge_dup_dates(_dup_rows(spark, sf), _ORDER)


@query(f"WITH x AS ({_DUP}), y AS (SELECT *, row_number() OVER (PARTITION BY instrument, trade_date ORDER BY k DESC) AS n FROM x) SELECT instrument, trade_date, tax, discount FROM y WHERE n = 1")
def dedup_keep_last(spark, sf):
    return I.dedup_keep_last(_dup_rows(spark, sf), I.KEYS, _ORDER).drop(*_ORDER)


@query(f"WITH x AS ({_DUP}) SELECT instrument, count(*) AS rows_before, count(DISTINCT trade_date) AS rows_after, count(*) - count(DISTINCT trade_date) AS duplicates FROM x GROUP BY 1")
def duplicate_report(spark, sf):
    return I.duplicate_report(_dup_rows(spark, sf))


@query(f"""{DAILY}, b AS (SELECT instrument, trade_date, close, 0 AS w FROM d WHERE CAST(instrument AS INTEGER) % 3 <> 0 AND CAST(instrument AS INTEGER) > 0),
 p AS (SELECT instrument, trade_date, close + 1 AS close, 1 AS w FROM d WHERE CAST(instrument AS INTEGER) > 0 AND trade_date >= DATE '2001-01-01' AND instrument IN (SELECT instrument FROM b)),
 u AS (SELECT *, row_number() OVER (PARTITION BY instrument, trade_date ORDER BY w DESC) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM p)),
 v AS (SELECT instrument, trade_date, close, lag(close) OVER {WI} AS pre_close FROM u WHERE n = 1) SELECT instrument, trade_date, close, pre_close, (close / pre_close - 1) * 100 AS pct_chg FROM v""")
def reconcile_codes(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", "close").where("cast(instrument as int) > 0")
    padded = d.where("trade_date >= date'2001-01-01'").select(F.lpad("instrument", 6, "0").alias("instrument"), "trade_date", (F.col("close") + 1).alias("close"))
    panel, _ = I.reconcile_codes(d.where("cast(instrument as int) % 3 <> 0").unionByName(padded), [])
    return panel


_PCT = f"{DAILY}, c AS (SELECT *, (close / lag(close) OVER {WI} - 1) * 100 AS pct_chg FROM d)"


@query(f"{_PCT} SELECT trade_date, instrument, round(pct_chg, 6) AS pct_chg FROM c WHERE pct_chg >= 9.5")
def build_limit_up(spark, sf):
    return rounded(I.build_limit_up(I.fill_derived(A.daily(spark, sf))))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS instrument, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE n_name END AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def industry_map(spark, sf):
    s, n = A.read(spark, sf, "supplier"), A.read(spark, sf, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.when(F.col("s_suppkey") % 4 != 0, F.col("n_name")).alias("industry_name"), F.col("s_nationkey").cast("string").alias("industry"), "s_suppkey")
    return I.industry_map(rows, "s_suppkey")


@query("WITH c AS (SELECT instrument, row_number() OVER (ORDER BY instrument) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS instrument FROM lineitem)) SELECT instrument FROM c WHERE n <= 30 OR pos IN (SELECT i * n // 30 FROM range(30) t(i))")
def systematic_sample(spark, sf):
    return I.systematic_sample(A.read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("instrument")), 30)


@query(f"{DAILY} SELECT instrument, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY trade_date DESC) AS n FROM d) WHERE n <= 60")
def last_n_rows(spark, sf):
    return I.last_n_rows(A.daily(spark, sf).select("instrument", "trade_date", "close"), 60)


@query(f"{DAILY} SELECT instrument, trade_date, close FROM d WHERE trade_date IN (SELECT DISTINCT trade_date FROM d ORDER BY 1 DESC LIMIT 300)")
def last_n_dates(spark, sf):
    return I.last_n_dates(A.daily(spark, sf).select("instrument", "trade_date", "close"), 300)


@query(f"{MINUTE} SELECT instrument, trade_date, close FROM (SELECT *, dense_rank() OVER (PARTITION BY instrument ORDER BY trade_date DESC) AS n FROM m) WHERE n <= 3")
def last_n_dates_each(spark, sf):
    return I.last_n_dates(A.minute(spark, sf).select("instrument", "trade_date", "close"), 3, per_instrument=True)


# --- projections, filters and market rules -------------------------------------------------------------------


@query(f"{DAILY} SELECT instrument, trade_date, CASE WHEN gross_margin > 0 THEN round(amount / gross_margin, 2) END AS value FROM d")
def finite(spark, sf):
    raw = F.when(F.col("gross_margin") > 0, F.col("amount") / F.col("gross_margin")).otherwise(F.when(F.col("volume") > 20, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return A.daily(spark, sf).select("instrument", "trade_date", F.round(C.finite(raw), 2).alias("value"))


@query(f"{_PCT} SELECT trade_date, instrument, CASE WHEN pct_chg >= 9.5 THEN NULL ELSE close END AS value FROM c")
def mask_limit_up(spark, sf):
    d = I.fill_derived(A.daily(spark, sf))
    return P.mask_limit_up(d.select("trade_date", "instrument", F.col("close").alias("value")), I.build_limit_up(d)).select("trade_date", "instrument", "value")


_CODE = "CASE CAST(d.instrument AS INTEGER) % 4 WHEN 0 THEN '8' WHEN 1 THEN '688' WHEN 2 THEN '300' ELSE '600' END || right('00000' || d.instrument, CASE CAST(d.instrument AS INTEGER) % 4 WHEN 0 THEN 5 ELSE 3 END)"
_BOARD = f"""{DAILY}, b0 AS (SELECT {_CODE} AS instrument, trade_date, open, high, low, close, lag(close) OVER {WI} AS pre_close FROM d),
 b1 AS (SELECT *, CASE WHEN instrument LIKE '8%' THEN 0.3 WHEN instrument LIKE '688%' OR instrument LIKE '300%' THEN 0.2 ELSE 0.1 END AS lim FROM b0),
 b2 AS (SELECT *, floor(pre_close * (1 + lim) * 100 + 0.5) / 100 AS limit FROM b1),
 b3 AS (SELECT *, coalesce(floor(close * 100 + 0.5) / 100 >= "limit", false) AS limit_up,
  coalesce(floor(open * 100 + 0.5) / 100 = "limit" AND floor(high * 100 + 0.5) / 100 = "limit" AND floor(low * 100 + 0.5) / 100 = "limit" AND floor(close * 100 + 0.5) / 100 = "limit", false) AS one_line,
  coalesce(floor(close * 100 + 0.5) / 100 = "limit" AND (floor(open * 100 + 0.5) / 100 <> "limit" OR floor(high * 100 + 0.5) / 100 <> "limit" OR floor(low * 100 + 0.5) / 100 <> "limit"), false) AS non_one_line FROM b2),
 b4 AS (SELECT *, (non_one_line AND limit_up AND NOT coalesce(lag(limit_up) OVER {WI}, false)) AS first_board,
  (coalesce(lag(close) OVER {WI} < lag(close, 2) OVER {WI}, false) AND NOT coalesce(lag(limit_up) OVER {WI}, false)) AS pullback FROM b3),
 b5 AS (SELECT *, (coalesce(lag(first_board, 2) OVER {WI}, false) AND pullback) AS anchor, lag(high) OVER {WI} AS ph, lag(low) OVER {WI} AS pl, lag(close) OVER {WI} AS pc FROM b4)"""


def _boards(spark, sf):
    d = A.daily(spark, sf)
    kind = F.col("instrument").cast("int") % 4
    tail = lambda n: F.substring(F.concat(F.lit("00000"), F.col("instrument")), -n, n)
    code = F.when(kind == 0, F.concat(F.lit("8"), tail(5))).when(kind == 1, F.concat(F.lit("688"), tail(3))).when(kind == 2, F.concat(F.lit("300"), tail(3))).otherwise(F.concat(F.lit("600"), tail(3)))
    # instruments may share a code, but a bar before is one of the same instrument
    d = d.withColumn("pre_close", F.lag("close").over(C.by_instrument())).withColumn("instrument", code)
    return EV.board_events(d.select("instrument", "trade_date", "open", "high", "low", "close", "pre_close"))


@query(f'{_BOARD} SELECT instrument, trade_date, lim AS board_limit, "limit" AS limit_price, limit_up, one_line, non_one_line FROM b3')
def board_limits(spark, sf):
    return _boards(spark, sf).select("instrument", "trade_date", C.board_limit(F.col("instrument")).alias("board_limit"), F.col("limit").alias("limit_price"), "limit_up", "one_line", "non_one_line")


@query(f"{_BOARD} SELECT instrument, trade_date, first_board, pullback, anchor FROM b5")
def board_events(spark, sf):
    return _boards(spark, sf).select("instrument", "trade_date", "first_board", "pullback", "anchor")


@query(f"{_BOARD} SELECT instrument, trade_date, CASE WHEN anchor THEN CASE WHEN ph = pl THEN 0.5 ELSE round((pc - pl) / (ph - pl), 6) END END AS value, CASE WHEN anchor THEN close END AS anchored FROM b5")
def close_position(spark, sf):
    b = EV.anchored(_boards(spark, sf), "close").withColumnRenamed("value", "anchored")
    return EV.close_position(b).select("instrument", "trade_date", F.round("value", 6).alias("value"), "anchored")


@query(f"{DAILY} SELECT instrument, trade_date, close * factor AS adj_close, close / lag(close) OVER {WI} - 1 AS ret, close / open - 1 AS intraday, round(ln(close / lag(close) OVER {WI}), 9) AS log_ret FROM d")
def returns(spark, sf):
    before = F.lag("close").over(C.by_instrument())
    return A.daily(spark, sf).select("instrument", "trade_date", C.adj_close(F.col("close"), F.col("factor")).alias("adj_close"), C.simple_return(F.col("close"), before).alias("ret"), C.simple_return(F.col("close"), F.col("open")).alias("intraday"), F.round(C.log_return(F.col("close"), before), 9).alias("log_ret"))


@query(f"{MINUTE} SELECT instrument, trade_date, count(*) AS n, sum(volume) AS volume FROM m WHERE mod >= 570 AND mod < 690 GROUP BY 1, 2")
def session_filter(spark, sf):
    m = A.minute(spark, sf).where(C.in_session(F.col("datetime"), "09:30", "11:30"))
    return m.groupBy("instrument", "trade_date").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


# --- joins ---------------------------------------------------------------------------------------------------


@query(f"{EVAL} SELECT trade_date, instrument, value, ret_next FROM e WHERE factor_name = 'momentum_5'")
def join_label(spark, sf):
    d = A.daily(spark, sf)
    factor = d.select("trade_date", "instrument", W.momentum("close", 5).alias("value"))
    label = W.next_return(d).select("trade_date", "instrument", "ret_next")
    return J.join_label(factor, label).select("trade_date", "instrument", "value", "ret_next")


@query(f"{CAL}, g AS (SELECT instrument, cal.trade_date FROM cal CROSS JOIN (SELECT DISTINCT instrument FROM d) u) SELECT g.instrument, g.trade_date, d.trade_date AS bar_date, d.close FROM g ASOF JOIN d ON g.instrument = d.instrument AND g.trade_date >= d.trade_date")
def asof_rows(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", "close")
    return J.asof_rows(d, S.calendar_of(d), d.select("instrument").distinct())


@query(f"""{CAL}, x AS (SELECT d.*, idx FROM d JOIN cal USING (trade_date)) SELECT instrument, trade_date, count(*) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS daily,
 count(*) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cross_section, count(*) OVER (PARTITION BY instrument ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS all_rows,
 count(*) OVER (PARTITION BY instrument ORDER BY idx RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS minute FROM x""")
def lookback_slice(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date")
    x = d.join(F.broadcast(S.calendar_of(d)), "trade_date")
    n = F.count(F.lit(1))
    return x.select("instrument", "trade_date", n.over(J.lookback_frame("daily", 5)).alias("daily"), n.over(J.lookback_frame("cross_section", 5)).alias("cross_section"), n.over(J.lookback_frame("cross_section", 0)).alias("all_rows"), n.over(J.lookback_frame("minute", 5)).alias("minute"))


_INDEX = ", ix AS (SELECT trade_date, avg(ret) AS index_ret FROM r GROUP BY 1)"


@query(f"{RET}{_INDEX} SELECT instrument, trade_date, round(ret, 6) AS ret, round(index_ret, 6) AS index_ret, round(ret - index_ret, 6) AS excess FROM r JOIN ix USING (trade_date)")
def index_join(spark, sf):
    r = ret_panel(spark, sf).select("instrument", "trade_date", "ret")
    return rounded(J.index_join(r, J.equal_weight_index(r)).select("instrument", "trade_date", "ret", "index_ret", "excess"))


# --- evaluation ----------------------------------------------------------------------------------------------


@query(f"{EVAL}{_IC} SELECT factor_name, trade_date, round(ic, 6) AS ic FROM ic")
def daily_ic(spark, sf):
    return rounded(E.daily_ic(_panel(spark, sf)))


@query(f"{EVAL}{_RANKIC} SELECT factor_name, trade_date, round(ic, 6) AS rank_ic FROM ric")
def daily_rank_ic(spark, sf):
    return rounded(E.daily_rank_ic(_panel(spark, sf)))


_SUMMARY = "SELECT factor_name, round(avg({c}), 6) AS {o}_mean, round(CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END, 6) AS {o}_std, round(avg({c}) / nullif(CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END, 0), 6) AS {o}_ir, count({c}) AS {o}_days, round(avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END), 6) AS {o}_positive_ratio FROM {t} WHERE {c} IS NOT NULL GROUP BY 1"


@query(f"{EVAL}{_IC} {_SUMMARY.format(c='ic', o='ic', t='ic')}")
def ic_summary(spark, sf):
    return rounded(E.ic_summary(E.daily_ic(_panel(spark, sf))))


@query(f"{EVAL}{_DEC} SELECT factor_name, trade_date, decile, round(mean_ret, 6) AS mean_ret FROM dd")
def decile_returns_daily(spark, sf):
    return rounded(E.decile_returns_daily(_panel(spark, sf)))


@query(f"{EVAL}{_DEC} SELECT factor_name, decile, round(avg(mean_ret), 6) AS mean, round(stddev_samp(mean_ret), 6) AS std FROM dd GROUP BY 1, 2")
def decile_summary(spark, sf):
    return rounded(E.decile_summary(E.decile_returns_daily(_panel(spark, sf))))


@query(f"{EVAL}{_DEC}{_LS} SELECT factor_name, trade_date, round(ls, 6) AS ls FROM ls WHERE ls IS NOT NULL")
def long_short_daily(spark, sf):
    return rounded(E.long_short_daily(E.decile_returns_daily(_panel(spark, sf))))


@query(f"{EVAL}{_DEC}{_LS} SELECT factor_name, round(avg(ls), 6) AS long_short_mean, round(CASE WHEN stddev_samp(ls) > 0 THEN avg(ls) / stddev_samp(ls) * sqrt(252) END, 6) AS long_short_sharpe, count(*) AS long_short_days FROM ls WHERE ls IS NOT NULL GROUP BY 1")
def long_short_summary(spark, sf):
    return rounded(E.long_short_summary(E.long_short_daily(E.decile_returns_daily(_panel(spark, sf)))))


@query(f"""{EVAL}{_DEC}{_LS}, cu AS (SELECT factor_name, trade_date, product(1 + ls / 100) OVER (PARTITION BY factor_name ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS cum FROM ls WHERE ls IS NOT NULL),
 pk AS (SELECT *, max(cum) OVER (PARTITION BY factor_name ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS peak FROM cu) SELECT factor_name, round(min(cum / peak - 1), 6) AS long_short_max_drawdown FROM pk GROUP BY 1""")
def max_drawdown(spark, sf):
    ls = E.long_short_daily(E.decile_returns_daily(_panel(spark, sf)))
    return rounded(E.max_drawdown(ls.withColumn("ls", F.col("ls") / 100)))


@query(f"{EVAL} SELECT factor_name, count(*) AS n_observations, count(DISTINCT trade_date) AS n_dates FROM e GROUP BY 1")
def observation_counts(spark, sf):
    return E.observation_counts(_panel(spark, sf))


@query(f"{EVAL}{_DEC}{_LS} SELECT factor_name, round(avg(ls) * 252, 6) AS annual_return, round(stddev_pop(ls) * sqrt(252), 6) AS annual_vol FROM ls WHERE ls IS NOT NULL GROUP BY 1")
def annualized(spark, sf):
    return rounded(E.annualized(E.long_short_daily(E.decile_returns_daily(_panel(spark, sf)))))


@query(f"{EVAL}{_DEC}{_LS}, z AS (SELECT * FROM dd UNION ALL SELECT factor_name, trade_date, 0, ls FROM ls WHERE ls IS NOT NULL) SELECT factor_name, trade_date, decile, round(sum(mean_ret) OVER (PARTITION BY factor_name, decile ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 2) AS cum_ret FROM z")
def cum_decile_curve(spark, sf):
    return rounded(E.cum_decile_curve(E.decile_returns_daily(_panel(spark, sf))), 2)


@query(ORACLES["max_drawdown"])
def max_drawdown_extended(spark, sf):
    """From a stored summary of the days before 1996, extended by the others."""
    ls = E.long_short_daily(E.decile_returns_daily(_panel(spark, sf))).withColumn("ls", F.col("ls") / 100)
    stored = staged(SU.drawdown_summary(ls.where("trade_date < date'1996-01-01'")), "summary")
    return rounded(SU.drawdown(SU.extend_drawdown(stored, ls)))


@query(ORACLES["cum_decile_curve"].replace(", 2) AS cum_ret", ", 2) + 0.0 AS cum_ret"))
def cum_decile_curve_extended(spark, sf):
    """From the stored curve of the days before 1996, extended by the others."""
    keys = ["factor_name", "decile"]
    daily = E.decile_returns_daily(_panel(spark, sf))
    ls = E.long_short_daily(daily).select("factor_name", "trade_date", F.lit(0).alias("decile"), F.col("ls").alias("mean_ret"))
    series = staged(daily.select("factor_name", "trade_date", "decile", "mean_ret").unionByName(ls), "series")
    old = staged(SU.running_sums(series.where("trade_date < date'1996-01-01'"), keys, "mean_ret", out="cum_ret"), "curve")
    new = SU.running_sums(series.where("trade_date >= date'1996-01-01'"), keys, "mean_ret", SU.last_sums(old, keys, "cum_ret"), "cum_ret")
    return old.unionByName(new).select("factor_name", "trade_date", "decile", (F.round("cum_ret", 2) + 0.0).alias("cum_ret"))


def _monthly_evaluation(spark, sf):
    panel = staged(_panel(spark, sf, A.monthly), "panel")
    daily = E.decile_returns_daily(panel)
    ls = E.long_short_daily(daily)
    parts = (E.ic_summary(E.daily_ic(panel)), E.ic_summary(E.daily_rank_ic(panel), "rank_ic"), E.long_short_summary(ls))
    out = E.observation_counts(panel)
    for p in parts:
        out = out.join(F.broadcast(p), "factor_name", "left")  # a row for each factor
    return rounded(out, 5)


@query(f"""{MONTHLY}{_EVAL}{_IC}{_RANKIC}{_DEC}{_LS}, n AS (SELECT factor_name, count(*) AS n_observations, count(DISTINCT trade_date) AS n_dates FROM e GROUP BY 1),
 a AS ({_SUMMARY.format(c='ic', o='ic', t='ic').replace(', 6)', ', 5)')}), b AS ({_SUMMARY.format(c='ic', o='rank_ic', t='ric').replace(', 6)', ', 5)')}),
 l AS (SELECT factor_name, round(avg(ls), 5) AS long_short_mean, round(CASE WHEN stddev_samp(ls) > 0 THEN avg(ls) / stddev_samp(ls) * sqrt(252) END, 5) AS long_short_sharpe, count(*) AS long_short_days FROM ls WHERE ls IS NOT NULL GROUP BY 1)
 SELECT * FROM n LEFT JOIN a USING (factor_name) LEFT JOIN b USING (factor_name) LEFT JOIN l USING (factor_name)""")
def monthly_evaluation(spark, sf):
    """The flagship: two factors on the monthly panel, from lines to scores."""
    return _monthly_evaluation(spark, sf)


_STYLE = f"""{EVAL}{_DEC}{_LS}, st AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, avg(l_discount) AS beta, avg(l_tax) AS size, avg(l_quantity) / 50 AS value FROM lineitem GROUP BY 1),
 al AS (SELECT factor_name, trade_date, ls, beta, size, value FROM ls JOIN st USING (trade_date) WHERE ls IS NOT NULL)"""


def _style(spark, sf):
    li = A.read(spark, sf, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("trade_date")).agg(F.avg("l_discount").alias("beta"), F.avg("l_tax").alias("size"), (F.avg("l_quantity") / 50).alias("value"))


@query(f"{_STYLE} SELECT factor_name, count(*) AS n_days, round(sum(ls * beta), 5) AS s FROM al GROUP BY 1 HAVING count(*) >= 30")
def align_series(spark, sf):
    ls = E.long_short_daily(E.decile_returns_daily(_panel(spark, sf)))
    both = J.align_series(ls, _style(spark, sf), 30, ["factor_name"])
    return both.groupBy("factor_name").agg(F.count("*").alias("n_days"), F.round(F.sum(F.col("ls") * F.col("beta")), 5).alias("s"))


def _exposures(spark, sf):
    ls = E.long_short_daily(E.decile_returns_daily(_panel(spark, sf)))
    return R.ols_exposure(J.align_series(ls, _style(spark, sf), 30, ["factor_name"]), "ls", ["beta"])


@query(f"""{_STYLE}, g AS (SELECT factor_name, count(*) AS n, regr_slope(ls, beta) AS b, regr_intercept(ls, beta) AS a, regr_r2(ls, beta) AS r2, regr_sxx(ls, beta) AS sxx, regr_syy(ls, beta) AS syy, avg(beta) AS mx FROM al GROUP BY 1 HAVING count(*) >= 30),
 h AS (SELECT *, (syy * (1 - r2)) / (n - 2) AS s2 FROM g)
 SELECT factor_name, 'beta' AS name, round(b, 4) AS coef, round(b / sqrt(s2 / sxx), 3) AS tstat, round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r_squared, CAST(n AS BIGINT) AS n_days FROM h
 UNION ALL SELECT factor_name, 'alpha', round(a, 4), round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 3), round(r2, 6), round(1 - (1 - r2) * (n - 1) / (n - 2), 6), CAST(n AS BIGINT) FROM h""")
def ols_exposure(spark, sf):
    """The regression on one style; p-values and several styles are held to numpy in the tests."""
    return _exposures(spark, sf).select("factor_name", "name", F.round("coef", 4).alias("coef"), F.round("tstat", 3).alias("tstat"), F.round("r_squared", 6).alias("r_squared"), F.round("adj_r_squared", 6).alias("adj_r_squared"), "n_days")


@query()
def significant_exposures(spark, sf):
    ls = E.long_short_daily(E.decile_returns_daily(_panel(spark, sf)))
    full = R.ols_exposure(J.align_series(ls, _style(spark, sf), 30, ["factor_name"]), "ls", ["beta", "size", "value"])
    return R.significant_exposures(R.exposure_map(full)).select("factor_name", F.map_entries("significant").alias("significant"), F.size("exposures").alias("n"))


# Three regressors by making each orthogonal to the ones before it: z1 = beta, r2 of size, r3 of value. The upper tail of
# the t distribution is an integral by Simpson's rule.
_OLS = f"""{_STYLE}, m AS (SELECT *, count(*) OVER w AS n, beta - avg(beta) OVER w AS z1, size - avg(size) OVER w AS z2, value - avg(value) OVER w AS z3, ls - avg(ls) OVER w AS y, avg(beta) OVER w AS m1, avg(size) OVER w AS m2, avg(value) OVER w AS m3, avg(ls) OVER w AS my FROM al WINDOW w AS (PARTITION BY factor_name)),
 c AS (SELECT *, sum(z1 * z2) OVER w / sum(z1 * z1) OVER w AS c21, sum(z1 * z3) OVER w / sum(z1 * z1) OVER w AS c31 FROM m WHERE n >= 30 WINDOW w AS (PARTITION BY factor_name)), c2 AS (SELECT *, z2 - c21 * z1 AS r2 FROM c), c3 AS (SELECT *, sum(r2 * z3) OVER w / sum(r2 * r2) OVER w AS c32 FROM c2 WINDOW w AS (PARTITION BY factor_name)), c4 AS (SELECT *, z3 - c31 * z1 - c32 * r2 AS r3 FROM c3),
 g AS (SELECT factor_name, any_value(n) AS n, any_value(c21) AS c21, any_value(c31) AS c31, any_value(c32) AS c32, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, any_value(my) AS my, sum(z1 * z1) AS s1, sum(r2 * r2) AS s2, sum(r3 * r3) AS s3, sum(y * z1) / sum(z1 * z1) AS g1, sum(y * r2) / sum(r2 * r2) AS g2, sum(y * r3) / sum(r3 * r3) AS g3, sum(y * y) AS syy FROM c4 GROUP BY 1),
 fit AS (SELECT *, g3 AS b3, g2 - c32 * g3 AS b2, g1 - c21 * (g2 - c32 * g3) - c31 * g3 AS b1, syy - g1 * g1 * s1 - g2 * g2 * s2 - g3 * g3 * s3 AS rss, m2 - c21 * m1 AS q2, m3 - c31 * m1 - c32 * (m2 - c21 * m1) AS q3 FROM g),
 k AS (SELECT *, rss / (n - 4) AS v, 1 - rss / syy AS r_squared FROM fit),
 x AS (SELECT factor_name, n, r_squared, unnest(['alpha', 'beta', 'size', 'value']) AS name, unnest([my - b1 * m1 - b2 * m2 - b3 * m3, b1, b2, b3]) AS coef, unnest([v * (1.0 / n + m1 * m1 / s1 + q2 * q2 / s2 + q3 * q3 / s3), v * (1 / s1 + c21 * c21 / s2 + (c32 * c21 - c31) * (c32 * c21 - c31) / s3), v * (1 / s2 + c32 * c32 / s3), v / s3]) AS var FROM k),
 t AS (SELECT *, coef / sqrt(var) AS tstat, n - 4 AS df FROM x), p AS (SELECT *, abs(tstat) / 2000 AS h, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS front FROM t),
 ols AS (SELECT factor_name, name, coef, tstat, greatest(0, 1 - 2 * front * h / 3 * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (i * h) * (i * h) / df, -(df + 1) / 2.0)))) AS pvalue, r_squared, 1 - (1 - r_squared) * (n - 1) / df AS adj_r_squared, n AS n_days FROM p)"""


@query(f"{_OLS} SELECT factor_name, name, round(coef, 4) AS coef, round(tstat, 3) AS tstat, round(pvalue, 5) AS pvalue, round(r_squared, 6) AS r_squared, round(adj_r_squared, 6) AS adj_r_squared, CAST(n_days AS BIGINT) AS n_days, CASE WHEN abs(tstat) > 2 THEN CASE WHEN pvalue < 0.01 THEN '**' ELSE '*' END END AS mark FROM ols")
def style_exposures(spark, sf):
    """The regression on three styles, with p-values and marks."""
    ls = E.long_short_daily(E.decile_returns_daily(_panel(spark, sf)))
    full = staged(R.ols_exposure(J.align_series(ls, _style(spark, sf), 30, ["factor_name"]), "ls", ["beta", "size", "value"]), "exposures")
    marks = R.significant_exposures(R.exposure_map(full)).select("factor_name", F.explode("significant").alias("name", "mark"))
    digits = {"coef": 4, "tstat": 3, "pvalue": 5, "r_squared": 6, "adj_r_squared": 6}
    return rounded(full.join(marks, ["factor_name", "name"], "left"), digits)


@query(f"""{_OLS.replace(_STYLE, _STYLE + _IC + _RANKIC)}, cv AS (SELECT factor_name, count(value) AS n, min(value) AS lo, max(value) AS hi FROM (SELECT 'momentum_5' AS factor_name, m5 AS value FROM f UNION ALL SELECT 'reversal_1', r1 FROM f) GROUP BY 1), gs AS (SELECT count(DISTINCT trade_date) AS nd, count(DISTINCT instrument) AS ni FROM d),
 i AS (SELECT factor_name, avg(ic) AS ic_mean FROM ic GROUP BY 1), ri AS (SELECT factor_name, avg(ic) AS rank_ic_mean FROM ric GROUP BY 1), s AS (SELECT factor_name, CASE WHEN stddev_samp(ls) > 0 THEN avg(ls) / stddev_samp(ls) * sqrt(252) END AS sharpe, avg(ls) * 252 AS annual_return FROM ls WHERE ls IS NOT NULL GROUP BY 1),
 o AS (SELECT factor_name, any_value(r_squared) AS r_squared, count(*) FILTER (abs(tstat) > 2) AS n_significant, count(*) FILTER (abs(tstat) > 3 AND name <> 'alpha') AS strong FROM ols GROUP BY 1)
 SELECT factor_name, round(ic_mean, 6) AS ic_mean, round(rank_ic_mean, 6) AS rank_ic_mean, round(sharpe, 4) AS long_short_sharpe, round(annual_return, 3) AS annual_return, round(r_squared, 6) AS r_squared, CAST(n_significant AS INTEGER) AS n_significant, cv.n AS non_null, round(cv.n / (nd * ni), 4) AS non_null_ratio, NOT (cv.n / (nd * ni) < 0.01 OR cv.n = 0 OR coalesce(lo = hi, false)) AS passes,
 concat_ws(',', CASE WHEN abs(ic_mean) < 0.005 THEN 'weak ic' END, CASE WHEN sharpe < -1 THEN 'negative sharpe' END, CASE WHEN r_squared > 0.25 AND strong >= 3 THEN 'style exposure' END) AS reasons FROM cv CROSS JOIN gs LEFT JOIN i USING (factor_name) LEFT JOIN ri USING (factor_name) LEFT JOIN s USING (factor_name) LEFT JOIN o USING (factor_name)""")
def factor_review(spark, sf):
    """From a factor table to scores, exposures, gate and reasons in one call."""
    d = A.daily(spark, sf)
    factors = P.compute([s for s in P.standard_specs() if s.name in ("momentum_5", "reversal_1")], d)
    out = RV.review(factors, d, _style(spark, sf), ["beta", "size", "value"])
    digits = {"ic_mean": 6, "rank_ic_mean": 6, "long_short_sharpe": 4, "annual_return": 3, "r_squared": 6, "non_null_ratio": 4}
    return rounded(out.select("factor_name", "ic_mean", "rank_ic_mean", "long_short_sharpe", "annual_return", "r_squared", F.size("significant").alias("n_significant"), "non_null", "non_null_ratio", "passes", F.array_join("reasons", ",").alias("reasons")), digits)


@query(f"{EVAL} SELECT factor_name, CAST(floor(quantile_cont(n, 0.5)) AS INTEGER) AS n_stocks_per_day FROM (SELECT factor_name, trade_date, count(value) AS n FROM e GROUP BY 1, 2) GROUP BY 1")
def stocks_per_day_median(spark, sf):
    return Q.stocks_per_day_median(_panel(spark, sf))


_GRID = ", gs AS (SELECT count(DISTINCT trade_date) AS nd, count(DISTINCT instrument) AS ni FROM d)"


def _grid_size(d: DataFrame) -> tuple[int, int]:
    return tuple(d.agg(F.countDistinct("trade_date"), F.countDistinct("instrument")).first())


@query(f"{EVAL}{_GRID} SELECT factor_name, CAST(any_value(nd) AS INTEGER) AS rows, CAST(any_value(ni) AS INTEGER) AS stock_count, count(value) AS non_null, round(count(value) / (any_value(nd) * any_value(ni)), 4) AS non_null_ratio, min(trade_date) AS first_date, max(trade_date) AS last_date FROM e CROSS JOIN gs GROUP BY 1")
def coverage(spark, sf):
    return Q.coverage(_panel(spark, sf), *_grid_size(A.daily(spark, sf)))


@query(f"{EVAL}{_GRID}, q AS (SELECT factor_name, value FROM e UNION ALL SELECT 'constant', 1.0 FROM d UNION ALL SELECT 'empty', NULL FROM d UNION ALL SELECT 'sparse', CASE WHEN instrument = '1' AND volume > 49 THEN close END FROM d) SELECT factor_name, count(value) / any_value(nd * ni) < 0.01 AS sparse, count(value) = 0 AS empty, coalesce(min(value) = max(value), false) AS constant, NOT (count(value) / any_value(nd * ni) < 0.01 OR count(value) = 0 OR coalesce(min(value) = max(value), false)) AS passes FROM q CROSS JOIN gs GROUP BY 1")
def quality_gate(spark, sf):
    d = A.daily(spark, sf)
    more = d.select(F.explode(F.array(F.struct(F.lit("constant").alias("factor_name"), F.lit(1.0).alias("value")), F.struct(F.lit("empty").alias("factor_name"), F.lit(None).cast("double").alias("value")), F.struct(F.lit("sparse").alias("factor_name"), F.when((F.col("instrument") == "1") & (F.col("volume") > 49), F.col("close")).alias("value")))).alias("x")).select("x.*")
    return Q.quality_gate(_panel(spark, sf).select("factor_name", "value").unionByName(more), *_grid_size(d))


@query("WITH s AS (SELECT p_partkey, (p_size - 25) / 1000.0 AS ic, (p_retailprice - 1200) / 200 AS sharpe, (p_partkey % 100) / 100.0 AS r2, p_partkey % 5 AS k FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN abs(ic) < 0.005 THEN 'weak ic' END, CASE WHEN sharpe < -1 THEN 'negative sharpe' END, CASE WHEN r2 > 0.25 AND k >= 3 THEN 'style exposure' END) AS reasons FROM s")
def review_flags(spark, sf):
    one = F.struct(F.lit(0.1).alias("coef"), F.lit(-4.0).alias("tstat"), F.lit(0.001).alias("pvalue"))
    keys = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 5).cast("int")), lambda i: F.when(i == 0, "alpha").otherwise(F.concat(F.lit("style"), i.cast("string"))))
    s = A.read(spark, sf, "part").select("p_partkey", ((F.col("p_size") - 25) / 1000.0).alias("ic_mean"), ((F.col("p_retailprice") - 1200) / 200).alias("long_short_sharpe"), (F.col("p_partkey") % 100 / 100.0).alias("r_squared"), F.map_from_arrays(keys, F.transform(keys, lambda _: one)).alias("exposures"))
    return Q.review_flags(s).select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query(f"{DAILY}, s AS (SELECT min(x) AS x FROM (SELECT date_diff('second', lag(trade_date) OVER {WI}, trade_date) AS x FROM d) WHERE x > 0) SELECT CASE WHEN x IS NULL THEN 'unknown' WHEN x <= 60 THEN 'minute' WHEN x >= 86400 THEN 'daily' ELSE format('{{:,}}', x) || 's' END AS granularity FROM s")
def infer_granularity(spark, sf):
    return Q.infer_granularity(A.daily(spark, sf), "trade_date")


@query(f"{EVAL} SELECT factor_name, count(*) AS n, true AS same FROM e GROUP BY 1")
def frame_hash(spark, sf):
    """The hash is the same for rows in another order."""
    p = _panel(spark, sf)
    a, b = Q.frame_hash(p, ["factor_name"]), Q.frame_hash(p.repartition(7, "instrument").select(*reversed(p.columns)), ["factor_name"])
    b = b.select("factor_name", F.col("hash_xor").alias("x"), F.col("hash_sum").alias("s"))
    return a.join(b, "factor_name").select("factor_name", "n", ((F.col("hash_xor") == F.col("x")) & (F.col("hash_sum") == F.col("s"))).alias("same"))


@query(f"""{EVAL}, o AS (SELECT factor_name, trade_date, instrument, value FROM e WHERE NOT (factor_name = 'momentum_5' AND day(trade_date) = 9)),
 n AS (SELECT factor_name, trade_date, instrument, CASE WHEN instrument = '7' AND factor_name = 'reversal_1' THEN value + 1 ELSE value END AS value FROM e WHERE NOT (day(trade_date) = 20 AND month(trade_date) = 6) AND NOT (instrument = '3' AND year(trade_date) = 1996 AND factor_name = 'momentum_5')),
 x AS (SELECT factor_name, trade_date FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION SELECT factor_name, trade_date FROM (SELECT * FROM n EXCEPT SELECT * FROM o)), od AS (SELECT DISTINCT factor_name, trade_date, 1 AS i FROM o), nd AS (SELECT DISTINCT factor_name, trade_date, 1 AS j FROM n)
 SELECT factor_name, trade_date, CASE WHEN i IS NULL THEN 'added' WHEN j IS NULL THEN 'removed' ELSE 'changed' END AS change FROM x LEFT JOIN od USING (factor_name, trade_date) LEFT JOIN nd USING (factor_name, trade_date)""")
def changed_dates(spark, sf):
    """The dates on which two versions of a factor table differ, by their hash trees."""
    p = _panel(spark, sf).select("factor_name", "trade_date", "instrument", "value")
    old = p.where("not (factor_name = 'momentum_5' and day(trade_date) = 9)")
    new = p.where("not (day(trade_date) = 20 and month(trade_date) = 6) and not (instrument = '3' and year(trade_date) = 1996 and factor_name = 'momentum_5')")
    new = new.withColumn("value", F.when(F.expr("instrument = '7' and factor_name = 'reversal_1'"), F.col("value") + 1).otherwise(F.col("value"))).repartition(5, "instrument")
    paths = scratch_dir(spark, "tree"), scratch_dir(spark, "tree")
    for df, path in zip((new, old), paths, strict=True):
        HT.write_tree(df, path)
    return HT.changed_dates(spark, *paths)


@query(f"{DAILY}, di AS (SELECT d.*, n_name AS industry FROM d JOIN supplier ON CAST(s_suppkey AS VARCHAR) = instrument JOIN nation ON s_nationkey = n_nationkey) SELECT instrument, trade_date, round(avg(roe) OVER (PARTITION BY trade_date, industry), 6) AS industry_mean, CAST(rank() OVER (PARTITION BY trade_date, industry ORDER BY roe) AS INTEGER) AS industry_rank, round(roe - avg(roe) OVER (PARTITION BY trade_date, industry), 6) AS neutral FROM di")
def industry_stats(spark, sf):
    d = A.daily(spark, sf).join(A.industry(spark, sf), "instrument")
    return rounded(E.industry_stats(d, "roe").select("instrument", "trade_date", "industry_mean", "industry_rank", "neutral"))


# --- windows -------------------------------------------------------------------------------------------------


@query(f"{DAILY}, x AS (SELECT instrument, trade_date, lead(close) OVER {WI} / close - 1 AS ret_next FROM d) SELECT instrument, trade_date, round(ret_next, 6) AS ret_next FROM x WHERE ret_next IS NOT NULL")
def next_return(spark, sf):
    return rounded(W.next_return(A.daily(spark, sf)).select("instrument", "trade_date", "ret_next"))


@query(f"{DAILY}, x AS (SELECT instrument, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY roe, instrument) AS r, count(*) OVER (PARTITION BY trade_date) AS n FROM d) SELECT instrument, trade_date, CAST(r AS INTEGER) AS rank, CAST(greatest((10 * (r - 1) + n - 2) // greatest(n - 1, 1), 1) - 1 AS INTEGER) AS decile FROM x")
def decile(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", F.col("roe").alias("value"))
    return W.decile(W.rank_first(d)).select("instrument", "trade_date", "rank", "decile")


def _z(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN stddev_pop({x}) OVER (PARTITION BY trade_date) = 0 THEN 0 ELSE ({x} - avg({x}) OVER (PARTITION BY trade_date)) / stddev_pop({x}) OVER (PARTITION BY trade_date) END"


@query(f"{DAILY} SELECT instrument, trade_date, round({_z('close')}, 5) AS z_close, round({_z('volume')}, 5) AS z_volume FROM d")
def zscore_cs(spark, sf):
    return rounded(W.zscore_cs(A.daily(spark, sf), ["close", "volume"]).select("instrument", "trade_date", "z_close", "z_volume"), 5)


@query(f"{DAILY} SELECT instrument, trade_date, CAST(rank() OVER (PARTITION BY trade_date ORDER BY volume) AS INTEGER) AS rank, round(percent_rank() OVER (PARTITION BY trade_date ORDER BY volume), 6) AS pct_rank, quantile_cont(volume, 0.5) OVER (PARTITION BY trade_date) AS median FROM d")
def rank_cs(spark, sf):
    return rounded(W.rank_cs(A.daily(spark, sf), "volume").select("instrument", "trade_date", "rank", "pct_rank", "median"))


_LEVELS = [0.01, 0.1, 0.25, 0.5, 0.9, 0.99]


@query(f"{DAILY}, q AS (SELECT trade_date, quantile_cont(close, {_LEVELS}) AS v FROM d GROUP BY 1) SELECT trade_date, CAST(unnest({_LEVELS}) AS DOUBLE) AS level, round(unnest(v), 6) AS value FROM q")
def quantiles_cs(spark, sf):
    return rounded(W.quantiles_cs(A.daily(spark, sf), "close", _LEVELS))


@query(f"{DAILY}, q AS (SELECT CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n, quantile_cont(close, {_LEVELS}) AS v FROM d GROUP BY 1) SELECT year, n, CAST(unnest({_LEVELS}) AS DOUBLE) AS level, round(unnest(v), 6) AS value, true AS near FROM q")
def quantile_sketches(spark, sf):
    """Quantiles of years, and whether those of merged sketches of dates are within the bound on their rank."""
    d = A.daily(spark, sf).select("trade_date", "close")
    stored = staged(W.quantile_sketches(d, "close", 400), "sketches")
    found = W.sketch_quantiles(stored.withColumn("year", F.year("trade_date")), _LEVELS, ["year"])
    years = d.withColumn("year", F.year("trade_date"))
    off, n = W.rank_error(400), F.count("*")
    places = years.join(F.broadcast(found), "year").groupBy("year", "n", "level").agg((F.sum((F.col("close") < F.col("value")).cast("int")) / n).alias("below"), (F.sum((F.col("close") <= F.col("value")).cast("int")) / n).alias("upto"))  # a row for each year and level
    near = (F.col("below") <= F.col("level") + off) & (F.col("upto") >= F.col("level") - off)
    return rounded(W.quantiles_cs(years, "close", _LEVELS, ["year"]).join(places, ["year", "level"]).select("year", "n", "level", "value", near.alias("near")))


@query(f"{DAILY} SELECT instrument, trade_date, round(0.5 * ({_z('close')}) + 0.5 * ({_z('volume')}), 5) AS value FROM d")
def composite(spark, sf):
    return rounded(W.composite(A.daily(spark, sf), ["close", "volume"], [0.5, 0.5]).select("instrument", "trade_date", "value"), 5)


@query(f"{DAILY} SELECT instrument, trade_date, round(close / avg(close) OVER (PARTITION BY trade_date) - 1, 6) AS value FROM d")
def demean_market(spark, sf):
    return rounded(W.demean_market(A.daily(spark, sf), "close").select("instrument", "trade_date", "value"))


def _roll(x: str, n: int, f: str, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {_rows(n)} >= {n if least is None else least} THEN {f}({x}) OVER {_rows(n)} END"


def _corr(x: str, y: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {_rows(n)} >= {n} THEN covar_pop({x}, {y}) OVER {_rows(n)} / nullif(stddev_pop({x}) OVER {_rows(n)} * stddev_pop({y}) OVER {_rows(n)}, 0) END"


@query(f"{DAILY} SELECT instrument, trade_date, round({_roll('close', 10, 'avg')}, 6) AS mean, round({_roll('close', 10, 'stddev_samp', 5)}, 4) AS std, round({_roll('volume', 10, 'sum', 1)}, 4) AS sum, round({_corr('close', 'volume', 10)}, 4) AS corr FROM d")
def rolling(spark, sf):
    return rounded(A.daily(spark, sf).select("instrument", "trade_date", W.rolling("close", 10, "mean").alias("mean"), W.rolling("close", 10, "std", 5).alias("std"), W.rolling("volume", 10, "sum", 1).alias("sum"), W.rolling("close", 10, "corr", other="volume").alias("corr")), {"mean": 6})


@query(f"{DAILY} SELECT instrument, trade_date, round(close / lag(close, 20) OVER {WI} - 1, 6) AS momentum, round(1 - close / lag(close, 5) OVER {WI}, 6) AS reversal, round({_roll('close', 10, 'avg')} / {_roll('close', 30, 'avg')} - 1, 6) AS ma_ratio FROM d")
def momentum(spark, sf):
    return rounded(A.daily(spark, sf).select("instrument", "trade_date", W.momentum("close", 20).alias("momentum"), W.reversal("close", 5).alias("reversal"), W.ma_ratio("close", 10, 30).alias("ma_ratio")))


@query(f"""{RET}, s AS (SELECT instrument, trade_date, close / lag(close, 20) OVER {WI} - 1 AS c1, 1 / nullif({_roll('ret', 20, 'stddev_samp')}, 0) AS c2, ({_roll('turnover_rate', 20, 'avg')}) / nullif({_roll('turnover_rate', 60, 'avg')}, 0) AS c3, roe AS c4 FROM r)
 SELECT instrument, trade_date, round({_z('c1')} + {_z('c2')} + {_z('c3')} + {_z('c4')}, 4) AS value FROM s""")
def composite_daily(spark, sf):
    return rounded(W.composite_daily(A.daily(spark, sf)).select("instrument", "trade_date", "value"), 4)


@query(f"{DAILY}, s AS (SELECT *, -debt_to_asset AS nd FROM d) SELECT instrument, trade_date, round(({_z('roe')} + {_z('gross_margin')} + {_z('revenue_yoy')} + {_z('nd')}) / 4, 5) AS q4, round(({_z('roe')} + {_z('gross_margin')} + {_z('revenue_yoy')}) / 3, 5) AS q3 FROM s")
def cs_quality(spark, sf):
    four = W.cs_quality(A.daily(spark, sf)).withColumnRenamed("value", "q4")
    return rounded(W.cs_quality(four, False).withColumnRenamed("value", "q3").select("instrument", "trade_date", "q4", "q3"), 5)


@query(f"""{RET} SELECT instrument, trade_date, round(1 - {_roll('close', 5, 'avg')} / {_roll('close', 20, 'avg')}, 4) AS ma_reversal, round({_corr('close', 'volume', 20)}, 4) AS pv_corr, round({_roll('ret', 20, 'stddev_samp')}, 4) AS volatility,
 round(close / {_roll('close', 20, 'avg')} - 1, 4) AS ma_gap, round(1 - {_roll('volume', 5, 'avg')} / {_roll('volume', 20, 'avg')}, 9) AS volume_reversal FROM r""")
def price_volume_factors(spark, sf):
    out = W.price_volume_factors(A.daily(spark, sf))
    return out.select("instrument", "trade_date", *[F.round(c, 9 if c == "volume_reversal" else 4).alias(c) for c in ("ma_reversal", "pv_corr", "volatility", "ma_gap", "volume_reversal")])


@query(f"""{RET}, s AS (SELECT *, high / low - 1 AS amp, {_roll('abs(ret)', 20, 'avg')} AS ma, sign(ret) * volume AS sv FROM r), t AS (SELECT *, CASE WHEN ret IS NULL OR ma IS NULL THEN NULL WHEN abs(ret) > 1.5 * ma THEN 1.0 ELSE 0.0 END AS ex FROM s)
 SELECT instrument, trade_date, round({_roll('sv', 20, 'sum')} / nullif({_roll('volume', 20, 'sum')}, 0), 4) AS signed_volume, round(amp / nullif({_roll('amp', 20, 'avg')}, 0) - 1, 3) AS amplitude_jump, round({_roll('ex', 20, 'avg')}, 4) AS extreme_share FROM t""")
def volume_amplitude_factors(spark, sf):
    out = W.volume_amplitude_factors(A.daily(spark, sf))
    return out.select("instrument", "trade_date", F.round("signed_volume", 4).alias("signed_volume"), F.round("amplitude_jump", 3).alias("amplitude_jump"), F.round("extreme_share", 4).alias("extreme_share"))


@query(f"{RET}{_INDEX}, x AS (SELECT r.*, index_ret FROM r JOIN ix USING (trade_date) WHERE ret IS NOT NULL) SELECT instrument, trade_date, round(CASE WHEN count(*) OVER {_rows(20)} >= 20 THEN covar_samp(ret, index_ret) OVER {_rows(20)} / nullif(var_samp(index_ret) OVER {_rows(20)}, 0) END, 4) AS beta FROM x")
def beta_to_index(spark, sf):
    r = ret_panel(spark, sf).select("instrument", "trade_date", "ret").where("ret is not null")
    return rounded(W.beta_to_index(J.index_join(r, J.equal_weight_index(r)), 20).select("instrument", "trade_date", "beta"), 4)


@query(f"{CAL} SELECT instrument, trade_date, close FROM d JOIN cal USING (trade_date) WHERE idx >= 100")
def warmup_skip(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", "close")
    return W.warmup_skip(d, S.calendar_of(d), 100)


@query(f"""{DAILY}, n AS (SELECT instrument, trade_date, close, row_number() OVER {WI} - 1 AS i FROM d)
 SELECT a.instrument, a.trade_date, round(sum(b.close * CASE WHEN b.i = 0 THEN 1 ELSE 1.0 / 3 END * pow(2.0 / 3, a.i - b.i)), 5) AS ema FROM n a JOIN n b ON a.instrument = b.instrument AND b.i <= a.i GROUP BY 1, 2""")
def ema(spark, sf):
    return rounded(SC.ema(A.daily(spark, sf).select("instrument", "trade_date", "close"), "close", 5).select("instrument", "trade_date", "ema"), 5)


# --- sorts, sets, freshness ----------------------------------------------------------------------------------


@query("WITH s AS (SELECT p_name || '_' || p_partkey AS factor_name, p_type AS factor_type, round((p_retailprice - 1200) / 50, 4) AS alpha_t FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY factor_type ORDER BY abs(alpha_t) DESC, factor_name) AS place FROM s WHERE abs(alpha_t) > 2) SELECT factor_type, factor_name, alpha_t, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3")
def top_factors(spark, sf):
    s = A.read(spark, sf, "part").select(F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("factor_name"), F.col("p_type").alias("factor_type"), F.round((F.col("p_retailprice") - 1200) / 50, 4).alias("alpha_t"))
    return Q.top_factors(s).select("factor_type", "factor_name", "alpha_t", "place")


@query(f"{MINUTE}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument, trade_date ORDER BY volume DESC, datetime, seq) AS n FROM m) SELECT instrument, trade_date, round(sum(CASE WHEN n <= 2 THEN volume ELSE 0 END) / (sum(volume) + 1e-6), 6) AS value FROM k GROUP BY 1, 2")
def topk_volume_share(spark, sf):
    return rounded(M.topk_volume_share(A.minute(spark, sf), 2))


@query(f"{EVAL} SELECT factor_name, trade_date, instrument, CASE WHEN trade_date > DATE '1999-12-31' THEN value + 1 ELSE value END AS value FROM e")
def merge_incremental(spark, sf):
    p = _panel(spark, sf).select("factor_name", "trade_date", "instrument", "value")
    old = p.where("trade_date <= date'2000-06-30'")
    new = p.where("trade_date >= date'1999-06-01'").withColumn("value", F.col("value") + 1)
    return N.merge_incremental(old, new, F.to_date(F.lit("1999-12-31")))


@query(f"{EVAL}, st AS (SELECT * FROM (VALUES ('momentum_5'), ('reversal_1'), ('unborn')) t(factor_name)), x AS (SELECT factor_name, max(trade_date) AS last_date FROM e WHERE factor_name = 'momentum_5' OR trade_date < DATE '2000-01-01' GROUP BY 1), c AS (SELECT max(trade_date) AS latest FROM e WHERE factor_name = 'momentum_5') SELECT status, count(*) AS n FROM (SELECT CASE WHEN last_date IS NULL THEN 'pending' WHEN last_date < latest THEN 'stale' ELSE 'current' END AS status FROM st LEFT JOIN x USING (factor_name) CROSS JOIN c) GROUP BY 1")
def factor_pending_status(spark, sf):
    p = _panel(spark, sf)
    names = p.select("factor_name").distinct().union(spark.range(1).select(F.lit("unborn")))
    stored = p.where("factor_name = 'momentum_5' or trade_date < date'2000-01-01'")
    return Q.status_counts(Q.factor_pending_status(names, stored, p.where("factor_name = 'momentum_5'")))


# --- intraday ------------------------------------------------------------------------------------------------


@query(f"{MINUTE} SELECT instrument, trade_date, count(*) AS bars, round(avg(close), 6) AS mean FROM m GROUP BY 1, 2")
def minute_to_day(spark, sf):
    return rounded(M.minute_to_day(A.minute(spark, sf), bars=F.count("*"), mean=F.avg("close")))


@query(f"{MINUTE}, x AS (SELECT instrument, trade_date, sum(volume) / (sum(vwap * volume) + 1e-8) AS r FROM m GROUP BY 1, 2) SELECT instrument, trade_date, round(avg(r) OVER {_rows(20)}, 5) AS value FROM x")
def volume_amount_ratio(spark, sf):
    return rounded(M.volume_amount_ratio(A.minute(spark, sf)), 5)


@query(f"{MINUTE}, x AS (SELECT *, row_number() OVER (PARTITION BY instrument, trade_date ORDER BY datetime DESC, seq DESC) AS n FROM m) SELECT instrument, trade_date, round(avg(CASE WHEN n <= 2 THEN vwap END) / (avg(vwap) + 1e-6) - 1, 6) AS value FROM x GROUP BY 1, 2 HAVING count(*) >= 3")
def vwap_deviation(spark, sf):
    return rounded(M.vwap_deviation(A.minute(spark, sf), 2, 3))


def _seg(a: int, b: int) -> str:
    return f"coalesce(sum(CASE WHEN mod >= {a} AND mod < {b} THEN ret * volume END) / nullif(sum(CASE WHEN mod >= {a} AND mod < {b} AND ret IS NOT NULL THEN volume END), 0), 0)"


@query(f"{MINUTE} SELECT instrument, trade_date, round(0.3 * {_seg(0, 480)} + 0.4 * {_seg(480, 960)} + 0.3 * {_seg(960, 1440)}, 5) AS value FROM mr GROUP BY 1, 2")
def intraday_momentum(spark, sf):
    return rounded(M.intraday_momentum(ticks(spark, sf), (("00:00", "08:00", 0.3), ("08:00", "16:00", 0.4), ("16:00", "24:00", 0.3))), 5)


@query(f"{MINUTE}, x AS (SELECT instrument, trade_date, coalesce(sum(CASE WHEN mod >= 540 AND mod < 780 THEN volume ELSE 0 END) / nullif(sum(volume), 0), 0) AS s FROM m GROUP BY 1, 2) SELECT instrument, trade_date, round(sum(s) OVER {_rows(20)}, 6) AS value FROM x")
def early_volume_ratio(spark, sf):
    return rounded(M.early_volume_ratio(A.minute(spark, sf), 20, "09:00", "13:00"))


@query(f"{MINUTE} SELECT instrument, trade_date, round(ln(arg_max(close, row(datetime, seq)) / (arg_min(close, row(datetime, seq)) FILTER (WHERE mod >= 720))), 6) AS value FROM m GROUP BY 1, 2")
def tail_momentum(spark, sf):
    return rounded(M.tail_momentum(A.minute(spark, sf), "12:00"))


@query(f"""{MINUTE}, x AS (SELECT instrument, trade_date, count(CASE WHEN mod < 720 THEN ret END) AS en, coalesce(sum(CASE WHEN mod < 720 THEN ret END), 0) AS e1, coalesce(sum(CASE WHEN mod < 720 THEN ret * ret END), 0) AS e2, count(ret) AS an, coalesce(sum(ret), 0) AS a1, coalesce(sum(ret * ret), 0) AS a2 FROM mr GROUP BY 1, 2),
 y AS (SELECT instrument, trade_date, {', '.join(f'sum({c}) OVER {_rows(5)} AS {c}' for c in ('en', 'e1', 'e2', 'an', 'a1', 'a2'))} FROM x),
 z AS (SELECT instrument, trade_date, (CASE WHEN en > 1 THEN sqrt(greatest(e2 - e1 * e1 / en, 0) / (en - 1)) END) / nullif(CASE WHEN an > 1 THEN sqrt(greatest(a2 - a1 * a1 / an, 0) / (an - 1)) END, 0) AS ratio FROM y)
 SELECT instrument, trade_date, round(ratio, 4) AS ratio FROM z WHERE ratio IS NOT NULL""")
def vol_ratio(spark, sf):
    return M.vol_ratio(ticks(spark, sf), 5, "00:00", "12:00").select("instrument", "trade_date", F.round("ratio", 4).alias("ratio"))


@query(f"{MINUTE}, b AS (SELECT instrument, trade_date, date_trunc('hour', datetime) AS h, max(high) AS high, min(low) AS low FROM m GROUP BY 1, 2, 3), x AS (SELECT instrument, trade_date, avg(high - low) AS a FROM b GROUP BY 1, 2) SELECT instrument, trade_date, round({_z('a')}, 5) AS value FROM x")
def amplitude_zscore(spark, sf):
    return rounded(M.amplitude_zscore(M.bars(A.minute(spark, sf), 60)), 5)


@query(f"{MINUTE}, s AS (SELECT *, CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w END AS sd FROM mr WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY datetime, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), x AS (SELECT instrument, trade_date, arg_max(sd, row(datetime, seq)) FILTER (WHERE sd IS NOT NULL) AS last FROM s GROUP BY 1, 2) SELECT instrument, trade_date, round(avg(last) OVER {_rows(20)}, 4) AS value FROM x")
def rolling_within_day(spark, sf):
    return rounded(M.rolling_within_day(ticks(spark, sf), 3), 4)


@query(f"{MINUTE} SELECT instrument, trade_date, CAST(epoch(time_bucket(INTERVAL 5 MINUTE, datetime)) AS BIGINT) AS start, arg_min(close, row(datetime, seq)) AS open, max(high) AS high, min(low) AS low, arg_max(close, row(datetime, seq)) AS close, sum(volume) AS volume FROM m GROUP BY 1, 2, 3")
def bars(spark, sf):
    return M.bars(A.minute(spark, sf), 5).withColumn("start", F.unix_timestamp("datetime")).drop("datetime")


@query(f"{MINUTE} SELECT instrument, trade_date, round(sqrt(sum(ret * ret)), 5) AS volatility, round(sqrt(count(ret)) * sum(ret * ret * ret) / nullif(pow(sum(ret * ret), 1.5), 0), 5) AS skew, round(count(ret) * sum(ret * ret * ret * ret) / nullif(sum(ret * ret) * sum(ret * ret), 0), 5) AS kurtosis FROM mr GROUP BY 1, 2")
def realized_moments(spark, sf):
    return rounded(M.realized_moments(ticks(spark, sf)), 5)


@query(f"{MINUTE} SELECT instrument, trade_date, round(avg(volume), 6) AS volume_mean, round(stddev_samp(volume), 6) AS volume_std, round(sum(volume * volume) / nullif(sum(volume) * sum(volume), 0), 6) AS concentration, round(sum(CASE WHEN mod < 600 THEN volume ELSE 0 END) / nullif(sum(volume), 0), 6) AS open_share FROM m GROUP BY 1, 2")
def volume_moments(spark, sf):
    return rounded(M.volume_moments(A.minute(spark, sf)).drop("volume_skew"))


@query(f"{MINUTE}, x AS (SELECT instrument, trade_date, sqrt(sum(ret * ret)) AS v FROM mr GROUP BY 1, 2) SELECT instrument, trade_date, round({_roll('v', 20, 'stddev_samp', 2)}, 4) AS value FROM x")
def stability(spark, sf):
    return rounded(M.stability(M.realized_moments(ticks(spark, sf)), "volatility"), 4)


_BETAS = """, mk AS (SELECT date_trunc('hour', datetime) AS b, avg(ret) AS mm FROM mr WHERE ret IS NOT NULL GROUP BY 1), jb AS (SELECT instrument, trade_date, ret, mm FROM mr JOIN mk ON date_trunc('hour', datetime) = b WHERE ret IS NOT NULL)"""


def _beta_sums(k: str, cond: str) -> str:
    return ", ".join(f"coalesce(sum(CASE WHEN {cond} THEN {x} END), 0) AS {k}{n}" for n, x in (("n", "1.0"), ("r", "ret"), ("m", "mm"), ("rm", "ret * mm"), ("mm", "mm * mm")))


@query(f"""{MINUTE}{_BETAS}, x AS (SELECT instrument, trade_date, {_beta_sums('j', 'abs(mm) > 5')}, {_beta_sums('c', 'abs(mm) <= 5')} FROM jb GROUP BY 1, 2),
 y AS (SELECT instrument, trade_date, {', '.join(f'sum({k}{n}) OVER {_rows(5)} AS {k}{n}' for k in 'jc' for n in ('n', 'r', 'm', 'rm', 'mm'))} FROM x)
 SELECT instrument, trade_date, {', '.join(f'round(CASE WHEN {k}n > 1 AND {k}mm - {k}m * {k}m / {k}n > 1e-12 THEN ({k}rm - {k}r * {k}m / {k}n) / ({k}mm - {k}m * {k}m / {k}n) END, 3) AS {o}' for k, o in (('j', 'jump_beta'), ('c', 'continuous_beta')))} FROM y""")
def jump_beta(spark, sf):
    t = ticks(spark, sf).withColumn("bucket", F.date_trunc("hour", "datetime"))
    return rounded(M.jump_beta(t, 5.0), 3)


# --- incremental and streaming -------------------------------------------------------------------------------


@query(f"{EVAL} SELECT factor_name, max(trade_date) AS last_date, (SELECT max(trade_date) FROM d) AS latest, max(trade_date) < (SELECT max(trade_date) FROM d) AS todo FROM e GROUP BY 1")
def high_water_mark(spark, sf):
    return N.high_water_mark(_panel(spark, sf), A.daily(spark, sf).select("trade_date").distinct())


@query(f"{CAL} SELECT trade_date, CAST(idx AS INTEGER) AS idx FROM cal WHERE idx >= greatest(0, (SELECT min(idx) FROM cal WHERE trade_date >= DATE '2000-01-01') - 20)")
def incremental_window(spark, sf):
    return N.incremental_window(S.calendar_of(A.daily(spark, sf)), F.to_date(F.lit("2000-01-01")), 20)


def _full_cross_section(panel):
    """A factor of the date's rows alone, so any look-back is enough."""
    return panel.select(F.lit("cs").alias("factor_name"), "trade_date", "instrument", F.round(C.zscore(F.col("volume"), C.by_date()), 6).alias("value"))


@query(f"{DAILY} SELECT 'cs' AS factor_name, trade_date, instrument, round({_z('volume')}, 6) AS value FROM d")
def incremental_update(spark, sf):
    d = A.daily(spark, sf)
    stored = _full_cross_section(d.where("trade_date <= date'2000-06-30'"))
    return N.incremental_update(stored, d, S.calendar_of(d), 5, _full_cross_section)


@query(f"{DAILY} SELECT DISTINCT trade_date FROM d WHERE month(trade_date) <> 3")
def resume_from_checkpoint(spark, sf):
    d = A.daily(spark, sf).select("trade_date")
    return N.resume_from_checkpoint(d.distinct(), d.where("month(trade_date) = 3"))


def _event_files(spark, sf):
    """The event ticks as files for a stream, the last third of them twice."""
    path = scratch_dir(spark, "events")
    m = A.minute(spark, sf).drop("trade_date")
    m.repartition(4, "instrument").write.parquet(path)
    m.where("seq % 3 = 0").withColumns({"close": F.col("close") + 1, "seq": F.col("seq") + 10_000_000}).write.mode("append").parquet(path)
    return ST.read_stream(spark, path, m.schema)


@query(f"{MINUTE} SELECT instrument, trade_date, CAST(seq + CASE WHEN seq % 3 = 0 THEN 10000000 ELSE 0 END AS BIGINT) AS seq, round(close + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END, 6) AS close, volume FROM m")
def stream_minute_ingest(spark, sf):
    out, state = scratch_dir(spark, "ingested"), scratch_dir(spark, "state")
    ST.ingest_keep_last(_event_files(spark, sf), out, state, staging=scratch_dir(spark, "staging")).awaitTermination()
    return spark.read.parquet(out).select("instrument", "trade_date", "seq", F.round("close", 6).alias("close"), "volume")


@query(ORACLES["stream_minute_ingest"])
def stream_keep_last(spark, sf):
    """The same by a state of the open days: closed days as written, open ones as the state has them."""
    out, state = scratch_dir(spark, "kept"), scratch_dir(spark, "state")
    kept = ST.keep_last_stream(_event_files(spark, sf), "1 day")
    ST.append_stream(kept, out, state).awaitTermination()
    rows = spark.read.schema(kept.schema).parquet(out).unionByName(ST.open_rows(spark, state))
    return rows.select("instrument", "trade_date", "seq", F.round("close", 6).alias("close"), "volume")


@query(f"{MINUTE}, x AS (SELECT instrument, trade_date, sum(volume) / (sum(vwap * volume) + 1e-8) AS r FROM m GROUP BY 1, 2) SELECT * FROM (SELECT instrument, trade_date, round(avg(r) OVER {_rows(20)}, 8) AS value FROM x) WHERE trade_date < (SELECT max(trade_date) FROM m)")
def stream_day_factor(spark, sf):
    """Ticks to a rolling factor of days in one stream, on the closed days."""
    path, out, state = scratch_dir(spark, "ticks"), scratch_dir(spark, "factor"), scratch_dir(spark, "state")
    m = A.minute(spark, sf).drop("trade_date")
    m.repartition(2, "instrument").write.parquet(path)
    ratio = F.sum("volume") / (F.sum(F.col("vwap") * F.col("volume")) + 1e-8)
    factor = ST.stream_day_factor(ST.read_stream(spark, path, m.schema), ratio, 20, "0 seconds")
    ST.append_stream(factor, out, state).awaitTermination()
    return spark.read.schema(factor.schema).parquet(out).select("instrument", "trade_date", F.round("value", 8).alias("value"))


@query(f"{MINUTE} SELECT instrument, count(*) AS n FROM m GROUP BY 1")
def stream_dedup(spark, sf):
    out, state = scratch_dir(spark, "deduped"), scratch_dir(spark, "state")
    ST.append_stream(ST.dedup_stream(_event_files(spark, sf), "60 days"), out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("instrument").agg(F.count("*").alias("n"))


@query(f"{MINUTE} SELECT instrument, trade_date, arg_min(close, row(datetime, seq)) AS open, max(high) AS high, min(low) AS low, arg_max(close, row(datetime, seq)) AS close, sum(volume) AS volume, count(*) AS n FROM m WHERE trade_date < (SELECT CAST(max(datetime) AS DATE) FROM m) GROUP BY 1, 2")
def stream_day_bars(spark, sf):
    path, out, state = scratch_dir(spark, "ticks"), scratch_dir(spark, "bars"), scratch_dir(spark, "state")
    m = A.minute(spark, sf).drop("trade_date")
    m.repartition(2, "instrument").write.parquet(path)
    # the watermark closes the days before the last one
    b = ST.stream_day_bars(ST.read_stream(spark, path, m.schema), "1 day", "0 seconds")
    b = b.withColumn("trade_date", F.to_date("start"))
    ST.append_stream(b, out, state).awaitTermination()
    return spark.read.schema(b.schema).parquet(out).drop("start")


# --- text ----------------------------------------------------------------------------------------------------


@query()
def html_to_text(spark, sf):
    return X.html_to_text(A.read(spark, sf, "pages"))


@query("SELECT doc_id, (length(text) >= 100 AND length(regexp_replace(text, '[^aeiou]', '', 'g')) < 0.25 * length(regexp_replace(text, '\\s', '', 'g'))) AS garbled FROM documents")
def is_garbled(spark, sf):
    return A.read(spark, sf, "documents").select("doc_id", X.is_garbled(F.col("text"), "aeiou", 100, 0.25).alias("garbled"))


@query("SELECT doc_id, CAST(length(CASE WHEN length(text) >= 50 THEN left(text, 30000) ELSE source END) AS INTEGER) AS n, md5(CASE WHEN length(text) >= 50 THEN left(text, 30000) ELSE source END) AS h FROM documents")
def fit_content(spark, sf):
    c = X.fit_content(F.col("text"), F.col("source"))
    return A.read(spark, sf, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@query("WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS host FROM pages) SELECT page_id, CASE WHEN contains(host, 'spam-farm') THEN 'spam' WHEN contains(host, 'blog.') THEN 'blog' ELSE regexp_replace(host, '^www\\.', '') END AS source FROM h")
def source_from_url(spark, sf):
    return A.read(spark, sf, "pages").select("page_id", X.source_from_url(F.col("url"), {"spam-farm": "spam", "blog.": "blog"}).alias("source"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0")
def pending_documents(spark, sf):
    s = A.read(spark, sf, "supplier")
    wide = F.translate(F.col("s_name"), "Suplier0123456789", "Ｓｕｐｌｉｅｒ０１２３４５６７８９")
    done = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("“"), wide, F.lit("”")).alias("name"))
    return X.pending_documents(s, done, "s_name").select("s_suppkey", "s_name")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN contains(lower(text), 'token') THEN 'secret' END, CASE WHEN contains(lower(text), 'password') THEN 'secret' END, lang], lambda x: x IS NOT NULL))), ',') AS tags FROM documents")
def tag_documents(spark, sf):
    tags = X.tag_documents(F.col("text"), {"license": "license", "token": "secret", "password": "secret"}, F.array("lang"))
    return A.read(spark, sf, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("WITH p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## ')) AS part, generate_subscripts(string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## '), 1) - 1 AS chunk FROM documents) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, md5(trim(part, ' ' || chr(9) || chr(10) || chr(13))) AS h FROM p WHERE chunk = 0 AND trim(part, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunk_markdown(spark, sf):
    """The preface of every document whose lines are made headings."""
    docs = A.read(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n## "))
    return X.chunk_markdown(docs).where("chunk = 0").select("doc_id", "chunk", F.md5("text").alias("h"))


_TOK = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_TFIDF = f"""WITH tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(t='text')}) AS term FROM documents) GROUP BY 1, 2),
 n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), tm AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
 rw AS (SELECT id, term, tf * idf AS w FROM tf JOIN tm USING (term)), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM rw GROUP BY 1), wt AS (SELECT id, term, w / norm AS weight FROM rw JOIN nm USING (id))"""


@query(f"{_TFIDF} SELECT id, count(*) AS terms, round(sum(weight), 4) AS total, round(max(weight), 5) AS top FROM wt GROUP BY 1")
def tfidf_index(spark, sf):
    weights, _ = X.tfidf_index(A.read(spark, sf, "documents"))
    return weights.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 5).alias("top"))


@query(f"""{_TFIDF}, qf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOK.format(t='text')}) AS term FROM benchmark) GROUP BY 1, 2), qr AS (SELECT item_id, term, tf * idf AS w FROM qf JOIN tm USING (term)),
 qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qr GROUP BY 1), qw AS (SELECT item_id, term, w / norm AS qw FROM qr JOIN qn USING (item_id)),
 sc AS (SELECT item_id, id, round(sum(weight * qw), 4) AS score FROM wt JOIN qw USING (term) GROUP BY 1, 2), pl AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place FROM sc WHERE score >= 0.1) SELECT item_id, id, score, CAST(place AS INTEGER) AS place FROM pl WHERE place <= 5""")
def retrieve(spark, sf):
    weights, terms = X.tfidf_index(A.read(spark, sf, "documents"))
    return X.retrieve(weights, terms, A.read(spark, sf, "benchmark"), 5, 0.1).select("item_id", "id", "score", "place")


# all arcs of each run by a join with the dictionary, the costs from the end of the run in a list, then the path in another
_SEGMENT = r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents), wc AS (SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 5000),
 tot AS (SELECT sum(n) AS total, max(length(word)) AS longest FROM wc), dict AS (SELECT word, CAST(round(ln(total / n) * 1000000) AS BIGINT) AS cost FROM wc, tot),
 dr AS (SELECT doc_id, regexp_extract_all(replace(lower(text), ' ', ''), '[\p{L}\p{N}_]+') AS runs FROM documents), r AS (SELECT run, length(run) AS m FROM (SELECT DISTINCT unnest(runs) AS run FROM dr)),
 c AS (SELECT run, i, k, substr(run, i, k) AS word FROM r, tot, range(1, m + 1) a(i), range(1, least(m - i + 1, longest) + 1) b(k)),
 arc AS (SELECT run, i, list({k: CAST(k AS BIGINT), cost: coalesce(cost, (SELECT CAST(round(ln(total) * 1000000) AS BIGINT) FROM tot))}) AS arcs FROM c LEFT JOIN dict USING (word) WHERE k = 1 OR cost IS NOT NULL GROUP BY 1, 2),
 al AS (SELECT run, [{arcs: [{k: 0::BIGINT, cost: 0::BIGINT}], best: [0::BIGINT], picks: []::BIGINT[]}] || list({arcs: arcs, best: []::BIGINT[], picks: []::BIGINT[]} ORDER BY i DESC) AS steps FROM arc GROUP BY 1),
 dp AS (SELECT run, list_reduce(steps, lambda p, x: {arcs: x.arcs, best: ([list_min(list_transform(x.arcs, lambda a: a.cost + p.best[a.k]))] || p.best)[1:64], picks: [-list_min(list_transform(x.arcs, lambda a: {c: a.cost + p.best[a.k], k: -a.k})).k] || p.picks}).picks AS picks FROM al),
 pt AS (SELECT run, list_reduce([{i: 0::BIGINT, k: 1::BIGINT, ws: []::VARCHAR[]}] || list_transform(picks, lambda k, i: {i: CAST(i AS BIGINT), k: k, ws: []::VARCHAR[]}), lambda p, x: CASE WHEN x.i = p.i + p.k THEN {i: x.i, k: x.k, ws: p.ws || [substr(run, x.i, x.k)]} ELSE p END).ws AS words FROM dp),
 dw AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS place FROM dr), dc AS (SELECT doc_id, sum(len(words)) AS n_words, string_agg(array_to_string(words, ' '), ' ' ORDER BY place) AS t FROM dw JOIN pt USING (run) GROUP BY 1)
 SELECT doc_id, CAST(coalesce(n_words, 0) AS INTEGER) AS n_words, md5(coalesce(t, '')) AS h FROM documents LEFT JOIN dc USING (doc_id) WHERE text IS NOT NULL"""


@query(_SEGMENT)
def segment_words(spark, sf):
    """Every text without its blanks, cut again by a dictionary of the corpus' most frequent words."""
    docs = A.read(spark, sf, "documents").where("text is not null")
    counts = G.word_counts(docs.select(F.explode(X.tokens(F.col("text"))).alias("word")), 5000)
    words = G.segmenter(spark, counts)
    cut = G.segment(docs.withColumn("text", F.replace(F.lower("text"), F.lit(" "), F.lit(""))), words)
    return cut.select("doc_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("h"))


@query(ORACLES["retrieve"])
def retrieve_blocks(spark, sf):
    """The same from posting blocks with bounds."""
    weights, terms = X.tfidf_index(A.read(spark, sf, "documents"), stage=True)
    weights = staged(weights, "weights")
    blocks = staged(X.posting_blocks(weights), "blocks")
    return X.retrieve_blocks(blocks, terms, A.read(spark, sf, "benchmark"), 5, 0.1)[0]


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM n a JOIN n b ON a.vec_id % 100 = 0),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) SELECT query_id, id, score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5""")
def embedding_similarity(spark, sf):
    e = A.read(spark, sf, "embeddings")
    return X.embedding_similarity(e.where("vec_id % 100 = 0"), e)


# --- user functions and models -------------------------------------------------------------------------------


@query(f"{DAILY} SELECT 'range' AS factor_name, trade_date, instrument, max(close) OVER {_rows(6)} - min(close) OVER {_rows(6)} AS value FROM d")
def user_daily_slices(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", "close")

    def spread(rows, day, stock):
        x = rows["close"].to_numpy()
        x = x[x == x]
        return {"range": x.max() - x.min() if len(x) else None}

    out = U.daily_slices(d, spread, 5)
    return out.where("error is null").drop("error")


@query(f"{DAILY} SELECT 'cummax' AS factor_name, trade_date, instrument, max(close) OVER {WI} AS value FROM d")
def user_daily_series(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", "close")

    def highest(rows, state, stock):
        so_far = rows["close"].cummax()
        return so_far if state is None else so_far.clip(lower=state), max(so_far.iloc[-1], state or 0.0)

    return U.daily_scan(d, "cummax", highest, max).where("error is null").drop("error")


@query(f"{DAILY} SELECT 'mid' AS factor_name, trade_date, instrument, round((max(close) OVER {_rows(20)} + min(close) OVER {_rows(20)}) / 2, 6) AS value FROM d")
def user_daily_lookback(spark, sf):
    """A function of a series of rows, of which each value depends on a look-back's rows only."""
    d = A.daily(spark, sf).select("instrument", "trade_date", "close")
    middle = lambda rows, stock: (rows["close"].rolling(20, 1).max() + rows["close"].rolling(20, 1).min()) / 2
    return rounded(U.daily_series(d, "mid", middle, lookback=19).where("error is null").drop("error"))


@query(f"{DAILY} SELECT 'share' AS factor_name, trade_date, instrument, volume / sum(volume) OVER (PARTITION BY trade_date) AS value FROM d")
def user_cross_sections(spark, sf):
    d = A.daily(spark, sf).select("instrument", "trade_date", "volume")
    out = U.cross_sections(d, lambda rows, day: {s: {"share": v} for s, v in zip(rows["instrument"], rows["volume"] / rows["volume"].sum(), strict=True)})
    return out.where("error is null").drop("error")


@query(f"{MINUTE}, x AS (SELECT trade_date, instrument, max(close) AS hi, min(close) AS lo FROM m GROUP BY 1, 2) SELECT 'hi' AS factor_name, trade_date, instrument, hi AS value FROM x UNION ALL SELECT 'lo', trade_date, instrument, lo FROM x")
def user_minute_days(spark, sf):
    m = A.minute(spark, sf).select("instrument", "trade_date", "datetime", "close")
    return U.minute_days(m, "x", lambda rows, stock: {"hi": rows["close"].max(), "lo": rows["close"].min()}).where("error is null").drop("error")


@query(f"{MINUTE}, x AS (SELECT trade_date, instrument, max(close) AS hi FROM m GROUP BY 1, 2) SELECT 'gap' AS factor_name, trade_date, instrument, round(hi - avg(hi) OVER (PARTITION BY trade_date), 6) AS value FROM x")
def user_minute_cross_sections(spark, sf):
    m = A.minute(spark, sf).select("instrument", "trade_date", "datetime", "close")
    out = U.minute_cross_sections(m, lambda rows, stock: {"hi": rows["close"].max()}, lambda wide, day: {s: {"gap": v} for s, v in zip(wide["instrument"], wide["hi"] - wide["hi"].mean(), strict=True)})
    return rounded(out.where("error is null").drop("error"))


@query(f"{DAILY} SELECT 'ValueError: odd' AS error, count(DISTINCT instrument) AS n FROM d WHERE CAST(instrument AS INTEGER) % 2 = 1")
def user_function_errors(spark, sf):
    def odd(rows, stock):
        if int(stock) % 2:
            raise ValueError("odd")
        return rows["close"]

    return U.error_report(U.daily_series(A.daily(spark, sf).select("instrument", "trade_date", "close"), "x", odd))


@query(f"{EVAL}, z AS (SELECT instrument, trade_date, close / lag(close, 5) OVER {WI} - 1 AS m5, 1 - close / lag(close) OVER {WI} AS r1, ({_roll('close', 5, 'avg')}) / ({_roll('close', 20, 'avg')}) - 1 AS ma, {_z('roe')} + {_z('gross_margin')} AS q FROM d) SELECT instrument, trade_date, round(m5, 5) AS momentum_5, round(r1, 5) AS reversal_1, round(ma, 5) AS ma_ratio_5_20, round(q, 5) AS quality FROM z")
def multi_factor_run(spark, sf):
    """Several specs in one pass, back in one column for each."""
    specs = [s for s in P.standard_specs() if s.name in ("momentum_5", "reversal_1", "ma_ratio_5_20", "quality")]
    long = P.compute(specs, A.daily(spark, sf))
    return rounded(long.groupBy("instrument", "trade_date").pivot("factor_name", [s.name for s in specs]).agg(F.first("value", ignorenulls=True)), 5)


# by year sums of products, their running totals, then each year's normal equations by elimination on a list of rows
_X = ["1.0", "f1", "f2", "f3", "f4"]
_WALK = f"""{RET}, ff AS (SELECT instrument, trade_date, close / lag(close, 20) OVER {WI} - 1 AS f1, CASE WHEN count(ret) OVER {_rows(20)} >= 20 THEN stddev_samp(ret) OVER {_rows(20)} END AS f2, CASE WHEN count(*) OVER {_rows(20)} >= 20 THEN avg(turnover_rate) OVER {_rows(20)} END / nullif(CASE WHEN count(*) OVER {_rows(60)} >= 60 THEN avg(turnover_rate) OVER {_rows(60)} END, 0) AS f3,
 close / CASE WHEN count(*) OVER {_rows(20)} >= 20 THEN avg(close) OVER {_rows(20)} END - 1 AS f4, lead(close, 5) OVER {WI} / close - 1 AS label, lead(trade_date, 5) OVER {WI} AS label_date FROM r), fu AS (SELECT * FROM ff WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL),
 yl AS (SELECT year(label_date) AS year, count(*) AS n, {", ".join(f"sum({a} * {b}) AS s{i}{j}" for i, a in enumerate(_X) for j, b in enumerate([*_X, "label"]))} FROM fu WHERE label IS NOT NULL GROUP BY 1),
 ad AS (SELECT y.year, coalesce(sum(n) OVER w, 0) AS n, {", ".join(f"sum(s{i}{j}) OVER w AS s{i}{j}" for i in range(5) for j in range(6))} FROM (SELECT DISTINCT year(trade_date) AS year FROM fu) y LEFT JOIN yl USING (year) WINDOW w AS (ORDER BY y.year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 sv AS (SELECT year, list_reduce([{{p: 0, m: [{", ".join("[" + ", ".join(f"s{i}{j}" + (" * (1 + 1e-6)" if i == j and i else "") for j in range(6)) + "]" for i in range(5))}]}}] || list_transform(range(1, 6), lambda p: {{p: p, m: [[0.0::DOUBLE]]}}), lambda q, x: {{p: x.p, m: list_transform(q.m, lambda row, i: list_transform(row, lambda v, j: CASE WHEN i = x.p THEN v / q.m[x.p][x.p] ELSE v - row[x.p] * q.m[x.p][j] / q.m[x.p][x.p] END))}}).m AS m FROM ad WHERE n >= 50)
 SELECT instrument, trade_date, round(m[1][6] + m[2][6] * f1 + m[3][6] * f2 + m[4][6] * f3 + m[5][6] * f4, 6) AS value FROM fu JOIN sv ON sv.year = year(trade_date)"""


@query(_WALK)
def walk_forward(spark, sf):
    return rounded(WF.walk_forward(WF.features(A.daily(spark, sf))))


# --- whole results of the same operators ---------------------------------------------------------------------


def _wide_universe(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """The packed wide table of all instruments as written and read back, and its columns."""
    d = staged(A.daily(spark, sf).select("trade_date", "instrument", F.col("close").alias("value")), "daily")
    columns = staged(S.wide_columns(d), "columns")
    return staged(S.packed_wide(d, S.calendar_of(d), columns), "wide"), columns


@query(f"{CAL} SELECT cal.trade_date, u.instrument, close AS value FROM cal CROSS JOIN (SELECT DISTINCT instrument FROM d) u LEFT JOIN d ON d.trade_date = cal.trade_date AND d.instrument = u.instrument")
def factor_wide_universe(spark, sf):
    """The wide table of all instruments, read back."""
    return S.unpack_wide(*_wide_universe(spark, sf))


@query(f"{DAILY} SELECT trade_date, instrument, close AS value FROM d")
def wide_to_long_universe(spark, sf):
    long = S.unpack_wide(*_wide_universe(spark, sf))
    return S.wide_to_long(long.select(F.date_format("trade_date", "yyyy-MM-dd").alias("Date"), "instrument", "value"))


@query(f"{MINUTE} SELECT instrument, CAST(epoch(date_trunc('second', datetime)) AS BIGINT) AS second, trade_date, close, volume FROM m")
def read_minute_days(spark, sf):
    """All days of the minute files."""
    path = scratch_dir(spark, "minute")
    m = A.minute(spark, sf).withColumn("date", F.col("trade_date").cast("string")).drop("trade_date").withColumnsRenamed({"instrument": "symbol", "datetime": "trade_date"})
    m.write.partitionBy("date").parquet(path)
    days = [r[0] for r in m.select("date").distinct().collect()]  # a row for each day
    return S.read_minute(spark, path, days, ["close", "volume"]).withColumn("second", F.floor(F.unix_timestamp("datetime")).cast("long")).drop("datetime")


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS part, generate_subscripts(string_split(text, '. '), 1) - 1 AS chunk FROM documents),
 s AS (SELECT doc_id, chunk, CASE WHEN chunk = 0 THEN 'preface' ELSE 'head' END AS heading, regexp_replace(CASE WHEN chunk = 0 THEN part ELSE 'body ' || part END, '^\\s+|\\s+$', '', 'g') AS t FROM p)
 SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, heading, md5(t) AS h FROM s WHERE t <> ''""")
def chunk_sections(spark, sf):
    """All sections of every document, whose sentences are made sections."""
    docs = A.read(spark, sf, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit("\n## head\nbody ")))
    return X.chunk_markdown(docs).select("doc_id", "chunk", "heading", F.md5("text").alias("h"))


@query(ORACLES["vol_ratio"].replace("SELECT instrument, trade_date, round(ratio, 4) AS ratio FROM z WHERE ratio IS NOT NULL", f", v AS (SELECT * FROM z WHERE ratio IS NOT NULL) SELECT instrument, trade_date, round({_z('ratio')}, 4) AS value FROM v"))
def vol_ratio_zscore(spark, sf):
    return M.vol_ratio(ticks(spark, sf), 5, "00:00", "12:00").select("instrument", "trade_date", F.round("value", 4).alias("value"))


@query(ORACLES["volume_amplitude_factors"].replace("SELECT instrument, trade_date, round(", ", u AS (SELECT instrument, trade_date, round(").replace(", 4) AS signed_volume", ", 12) AS signed_volume").replace(", 3) AS amplitude_jump", ", 12) AS amplitude_jump").replace(", 4) AS extreme_share", ", 12) AS extreme_share")
       + f") SELECT instrument, trade_date, round(({_z('signed_volume')} + {_z('amplitude_jump')} + {_z('extreme_share')}) / 3, 4) + 0.0 AS volume_amplitude FROM u")
def volume_amplitude_composite(spark, sf):
    return W.volume_amplitude_factors(A.daily(spark, sf)).select("instrument", "trade_date", F.round("volume_amplitude", 4).alias("volume_amplitude"))


@query(f"{MINUTE} SELECT instrument, trade_date, CASE WHEN stddev_pop(volume) > 0 THEN round((avg(volume * volume * volume) - 3 * avg(volume) * avg(volume * volume) + 2 * pow(avg(volume), 3)) / pow(stddev_pop(volume), 3), 4) END AS volume_skew FROM m GROUP BY 1, 2")
def volume_skew(spark, sf):
    return M.volume_moments(A.minute(spark, sf)).select("instrument", "trade_date", F.round("volume_skew", 4).alias("volume_skew"))


@query(f"""{MINUTE}, b AS (SELECT instrument, trade_date, time_bucket(INTERVAL 5 MINUTE, datetime) AS start, arg_max(close, row(datetime, seq)) AS close FROM m GROUP BY 1, 2, 3),
 br AS (SELECT instrument, trade_date, close / lag(close) OVER (PARTITION BY instrument, trade_date ORDER BY start) - 1 AS ret FROM b)
 SELECT instrument, trade_date, round(sqrt(sum(ret * ret)), 5) AS volatility, round(sqrt(count(ret)) * sum(ret * ret * ret) / nullif(pow(sum(ret * ret), 1.5), 0), 5) AS skew, round(count(ret) * sum(ret * ret * ret * ret) / nullif(sum(ret * ret) * sum(ret * ret), 0), 5) AS kurtosis FROM br GROUP BY 1, 2""")
def realized_moments_5m(spark, sf):
    """Moments of the returns of 5-minute bars."""
    return rounded(M.realized_moments(M.bar_returns(M.bars(A.minute(spark, sf), 5))), 5)


_ASOF = f"""{CAL}, g AS (SELECT instrument, cal.trade_date FROM cal CROSS JOIN (SELECT DISTINCT instrument FROM d) u), ad AS (SELECT g.instrument, g.trade_date, d.close, d.roe, d.gross_margin FROM g ASOF JOIN d ON g.instrument = d.instrument AND g.trade_date >= d.trade_date),
 fa AS (SELECT 'momentum_5' AS factor_name, trade_date, instrument, close / lag(close, 5) OVER {WI} - 1 AS value FROM ad UNION ALL SELECT 'reversal_1', trade_date, instrument, 1 - close / lag(close) OVER {WI} FROM ad
 UNION ALL SELECT 'ma_ratio_5_20', trade_date, instrument, ({_roll('close', 5, 'avg')}) / ({_roll('close', 20, 'avg')}) - 1 FROM ad)
 SELECT factor_name, trade_date, instrument, round(value, 5) + 0.0 AS value FROM fa WHERE value IS NOT NULL"""


def _series_specs() -> list[P.FactorSpec]:
    return [s for s in P.standard_specs() if s.kind == "series"]


@query(_ASOF)
def asof_factors(spark, sf):
    """Daily factors on every calendar date, from the last bar at or before it."""
    d = A.daily(spark, sf)
    return rounded(P.compute(_series_specs(), d, asof=S.calendar_of(d)).where("value is not null"), 5)


@query(_ASOF)
def incremental_factors(spark, sf):
    """Stored factors that end on different dates, extended with the look-backs' dates only: equal to the full run."""
    d = A.daily(spark, sf)
    calendar = S.calendar_of(d)
    panel = J.asof_rows(d.select("instrument", "trade_date", "close"), calendar).drop("bar_date")
    full = P.compute(_series_specs(), panel)
    stored = full.where("factor_name = 'momentum_5' and trade_date <= date'2000-06-30' or factor_name = 'reversal_1' and trade_date <= date'1999-12-31'")
    return rounded(N.update_factors(stored, _series_specs(), panel, calendar).where("value is not null"), 5)


@query(f"""{DAILY}, {MINUTE.removeprefix("WITH ")}, z AS (SELECT instrument, trade_date, close / lag(close, 5) OVER {WI} - 1 AS m5, 1 - close / lag(close) OVER {WI} AS r1, ({_roll('close', 5, 'avg')}) / ({_roll('close', 20, 'avg')}) - 1 AS ma, {_z('roe')} + {_z('gross_margin')} AS q FROM d),
 zz AS (SELECT *, {_z('m5')} AS mz FROM z), va AS (SELECT instrument, trade_date, avg(r) OVER {_rows(20)} AS v FROM (SELECT instrument, trade_date, sum(volume) / (sum(vwap * volume) + 1e-8) AS r FROM m GROUP BY 1, 2)),
 al AS (SELECT 'momentum_5' AS factor_name, trade_date, instrument, m5 AS value FROM zz UNION ALL SELECT 'reversal_1', trade_date, instrument, r1 FROM zz UNION ALL SELECT 'ma_ratio_5_20', trade_date, instrument, ma FROM zz
 UNION ALL SELECT 'quality', trade_date, instrument, q FROM zz UNION ALL SELECT 'momentum_z', trade_date, instrument, mz FROM zz UNION ALL SELECT 'volume_amount', trade_date, instrument, v FROM va) SELECT factor_name, trade_date, instrument, round(value, 5) + 0.0 AS value FROM al WHERE value IS NOT NULL""")
def standard_factors(spark, sf):
    """All standard specs: series, cross-sections with and without a stage, and minute bars."""
    return rounded(P.compute(P.standard_specs(), A.daily(spark, sf), A.minute(spark, sf)).where("value is not null"), 5)


@query(ORACLES["standard_factors"])
def bucketed_factors(spark, sf):
    """All standard specs from bars that are stored in buckets by instrument."""
    daily, minute = A.daily(spark, sf), A.minute(spark, sf)
    paths = [scratch_dir(spark, n) for n in ("daily", "minute")]
    names = [p.rsplit("/", 1)[-1].replace("-", "_") for p in paths]
    daily = S.write_bucketed(daily, names[0], paths[0], 16)
    minute = S.write_bucketed(minute, names[1], paths[1], 16, "datetime")
    return rounded(P.compute(P.standard_specs(), daily, minute, clustered=True).where("value is not null"), 5)


_ENDS = {"momentum_5": "1997-06-30", "reversal_1": "1996-03-01", "ma_ratio_5_20": "1998-01-15", "momentum_z": "1998-09-30", "volume_amount": "2024-01-15"}


def _stored_half(full: DataFrame) -> DataFrame:
    """Factors up to different dates; one of them is not stored yet."""
    end = F.try_element_at(F.create_map(*[F.lit(x) for x in sum(_ENDS.items(), ())]), F.col("factor_name"))
    return staged(full.where(F.col("trade_date") <= end.cast("date")), "stored")


@query(ORACLES["standard_factors"])
def standard_factors_extended(spark, sf):
    """All standard specs, minute bars and staged ones too, from a stored part: equal to the full run."""
    daily, minute = A.daily(spark, sf), A.minute(spark, sf)
    stored = _stored_half(P.compute(P.standard_specs(), daily, minute))
    return rounded(stored.unionByName(N.extend_factors(stored, P.standard_specs(), daily, minute)).where("value is not null"), 5)


@query(ORACLES["standard_factors"].replace("WHERE value IS NOT NULL", "LEFT JOIN (SELECT instrument AS i, trade_date AS t FROM z WHERE r1 <= -0.05) h ON h.i = al.instrument AND h.t = al.trade_date WHERE value IS NOT NULL AND h.i IS NULL"))
def masked_factors_extended(spark, sf):
    """The same with values masked on dates of a great rise."""
    daily, minute = A.daily(spark, sf), A.minute(spark, sf)
    rise = daily.select("instrument", "trade_date", W.reversal("close", 1).alias("r")).where("r <= -0.05").select("instrument", "trade_date")
    stored = _stored_half(P.mask_limit_up(P.compute(P.standard_specs(), daily, minute), rise).select("factor_name", "trade_date", "instrument", "value"))
    return rounded(stored.unionByName(N.extend_factors(stored, P.standard_specs(), daily, minute, rise)).where("value is not null"), 5)


@query(ORACLES["user_minute_days"])
def user_minute_series(spark, sf):
    """A function that returns a series of values by name."""
    import pandas as pd

    m = A.minute(spark, sf).select("instrument", "trade_date", "datetime", "close")
    return U.minute_days(m, "x", lambda rows, stock: pd.Series({"hi": rows["close"].max(), "lo": rows["close"].min()})).where("error is null").drop("error")


def entry(spark, sf):
    return _monthly_evaluation(spark, sf)


__all__ = ["ORACLES", "QUERIES", "Window", "entry"]
