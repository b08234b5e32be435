"""The whole feature tables, on the order panel and on a panel with one asset per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.scalars import rounded
from panelloom.plans import feature_tables as ft
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.queries.roles_sql import mean
from panelloom.queries.windows import _beta, _dd, _ma, _rsi, _upto, _vol, fwd, trail
from panelloom.sources.tables import materialise

_HIST = "PARTITION BY asset ORDER BY date"
_B = "ORDER BY date"

EXACT = {
    "asset", "date", "close", "volume", "has_trading", "dividend_history_days", "days_since_last_dividend",
    "has_dividend_today", "macro_a", "macro_b", "macro_c", "macro_d", "target_7d",
}


# Cash over price: both have few decimals, so that six digits would often be a rounding tie.
FINE = {"dividend_yield_12m"}


def _rounding(digits):
    return lambda value: rounded(value, digits)


def _rounded(df):
    """All columns but the EXACT ones rounded, as one array per number of digits: a long list of
    expressions would make one method too large for the JVM to compile."""
    digits = {c: 9 if c in FINE else 6 for c in df.columns if c not in EXACT}
    names = {n: [c for c in digits if digits[c] == n] for n in sorted(set(digits.values()))}
    arrays = [F.transform(F.array(*some), _rounding(n)).alias(f"__round_{n}") for n, some in names.items()]
    return df.select(*[c for c in df.columns if c in EXACT], *arrays).select(
        *[c if c in EXACT else F.col(f"__round_{digits[c]}")[names[digits[c]].index(c)].alias(c) for c in df.columns]
    )


def table_sql(version: str) -> str:
    """Feature-table SQL over the CTEs panel, divs, tr, br, macro_daily and macro_monthly."""
    v2 = version == "v2"
    columns = [*ft.IDENTITY, *ft.OWN_RETURNS, *ft.BENCH_RETURNS, *ft.VOLATILITY, *ft.DIVIDENDS]
    columns += ([] if v2 else ["has_dividend_today"]) + ft.ALPHA + ["macro_a", "macro_b", "macro_c", "macro_d"] + ft.TARGETS
    columns += {"v1": [], "v2_minimal": ["price_vs_ma_7d"], "v2": ft.TECHNICAL}[version]
    shown = ", ".join(c if c in EXACT else f"round({c}, {9 if c in FINE else 6}) + 0e0 AS {c}" for c in columns)
    return f"""
WITH bs AS (SELECT date, bench_return, lag(bench_return) OVER ({_B}) AS bench_return_1d, {trail('bench_return', 7, _B)} AS bench_return_7d,
       {trail('bench_return', 30, _B)} AS bench_return_30d, {trail('bench_return', 90, _B)} AS bench_return_90d, {fwd('bench_return', 7, _B)} AS ahead FROM br),
mv AS (SELECT t.*, COALESCE(CASE WHEN close > close_prev THEN close - close_prev END, 0e0) AS gain, COALESCE(CASE WHEN close < close_prev THEN close_prev - close END, 0e0) AS loss,
       CASE WHEN bs.bench_return IS NOT NULL THEN price_return END AS y, CASE WHEN price_return IS NOT NULL THEN bs.bench_return END AS x
       FROM tr t LEFT JOIN bs USING (date)),
own AS (SELECT *, lag(total_return) OVER ({_HIST}) AS return_1d, {trail('total_return', 7)} AS return_7d, {trail('total_return', 30)} AS return_30d,
       {trail('total_return', 90)} AS return_90d, {_vol(30)} AS volatility_30d, {_vol(90)} AS volatility_90d,
       sum(dividend_value) OVER ({_HIST} RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) / close AS dividend_yield_12m,
       CAST(date - min(date) OVER (PARTITION BY asset) AS INTEGER) AS dividend_history_days,
       CAST(date - max(CASE WHEN dividend_value > 0 THEN date END) OVER ({_HIST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS days_since_last_dividend,
       dividend_value > 0 AS has_dividend_today, {fwd('total_return', 7)} AS ahead,
       {_rsi(14)} AS rsi_14d, {_ma(7)} AS price_vs_ma_7d, {_ma(30)} AS price_vs_ma_30d, {_beta(90, 60)} AS beta_90d,
       CASE WHEN count(*) OVER {_upto(30)} >= 30 THEN avg(CASE WHEN y > x THEN 1e0 ELSE 0e0 END) OVER {_upto(30)} END AS outperform_rate_30d, {_dd(30)} AS drawdown_30d
       FROM mv),
md AS (SELECT asset, CAST(date_trunc('month', payment_date) AS DATE) AS month, sum(value) AS total FROM divs GROUP BY 1, 2),
months AS (SELECT DISTINCT asset, CAST(date_trunc('month', date) AS DATE) AS month FROM panel),
st AS (SELECT p.asset, p.month, CASE WHEN count(m.total) >= 3 THEN stddev_pop(m.total) / avg(m.total) END AS dividend_stability
       FROM months p LEFT JOIN md m ON m.asset = p.asset AND m.month < p.month AND m.month >= p.month - INTERVAL 12 MONTH GROUP BY 1, 2),
full_table AS (
  SELECT o.*, b.bench_return_1d, b.bench_return_7d, b.bench_return_30d, b.bench_return_90d, b.bench_return, b.ahead AS bench_ahead,
         o.return_30d - b.bench_return_30d AS alpha_30d, o.return_90d - b.bench_return_90d AS alpha_90d,
         o.ahead > b.ahead AS target_7d, o.ahead - b.ahead AS target_alpha_7d,
         da.macro_a, da.macro_b, c.macro_c, d.macro_d, st.dividend_stability
  FROM own o LEFT JOIN bs b ON b.date = o.date
  ASOF LEFT JOIN macro_daily da ON o.date >= da.date
  LEFT JOIN macro_monthly c ON c.month = CASE WHEN day(o.date) < 15 THEN date_trunc('month', o.date) - INTERVAL 2 MONTH ELSE date_trunc('month', o.date) - INTERVAL 1 MONTH END
  LEFT JOIN macro_monthly d ON d.month = date_trunc('month', o.date) - INTERVAL 2 MONTH
  LEFT JOIN st ON st.asset = o.asset AND st.month = date_trunc('month', o.date))
SELECT {shown} FROM full_table
WHERE return_90d IS NOT NULL AND target_7d IS NOT NULL AND bench_return IS NOT NULL AND macro_c IS NOT NULL AND macro_d IS NOT NULL"""


def _macro(spark, sf):
    return ft.Macro(
        roles.macro_daily(spark, sf), ["macro_a", "macro_b"],
        roles.macro_monthly(spark, sf), {"macro_c": "mid_month", "macro_d": "always_two"},
    )


def order_table(spark, sf, version):
    cells = roles.prices(spark, sf)
    events = materialise(roles.dividends(spark, sf), "dividends") if version == "v2" else roles.dividends(spark, sf)
    return _table(spark, sf, roles.panel_of(cells), events, roles.bench_of(cells), version)


def _table(spark, sf, prices, events, benchmark, version):
    macro = _macro(spark, sf)
    facts = materialise(ft.date_facts(prices, benchmark, macro), "date_facts")
    return _rounded(ft.feature_table(prices, events, benchmark, macro, version, facts=facts))


_NEEDS = "panel divs tr br macro_daily macro_monthly"


@query("feature_table_v1", sql(_NEEDS, table_sql("v1")))
def table_v1(spark, sf):
    return order_table(spark, sf, "v1")


@query("feature_table_v2", sql(_NEEDS, table_sql("v2")))
def table_v2(spark, sf):
    return order_table(spark, sf, "v2")


@query("feature_table_v2_minimal", sql(_NEEDS, table_sql("v2_minimal")))
def table_v2_minimal(spark, sf):
    return order_table(spark, sf, "v2_minimal")


# The same tables with one asset per supplier: the number of assets grows with the data.
_SUPPLIER_CTES = f"""
WITH panel AS (SELECT CAST(l_suppkey AS VARCHAR) AS asset, CAST(l_shipdate AS DATE) AS date, {mean('l_extendedprice')} AS close, count(*) AS volume FROM lineitem GROUP BY 1, 2),
divs AS (SELECT CAST(l_suppkey AS VARCHAR) AS asset, CAST(l_shipdate AS DATE) AS ex_date, CAST(l_shipdate AS DATE) + 10 AS payment_date,
   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 1e6 AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
bench AS (SELECT CAST(l_shipdate AS DATE) AS date, {mean('l_extendedprice')} AS close FROM lineitem GROUP BY 1)"""


def _supplier_sql(version: str) -> str:
    from panelloom.queries.roles_sql import CTES

    shared = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ("tr", "br", "macro_daily", "macro_monthly"))
    return f"{_SUPPLIER_CTES.strip()},\n{shared},\n{table_sql(version).strip()[5:]}"


def _supplier_table(spark, sf, version):
    """One scan of the line items makes cells of at most one row per supplier and day; prices,
    events and the benchmark are all read from the written cells."""
    returned = F.when(F.col("l_returnflag") == "R", roles.cents("l_extendedprice") * roles.cents("l_discount"))
    cells = materialise(
        roles.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("asset"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.sum(roles.cents("l_extendedprice")).alias("cents"),
            F.count(F.lit(1)).alias("volume"),
            F.sum(returned).alias("paid"),
        ),
        "supplier_cells",
    )
    prices = cells.select("asset", "date", (F.col("cents") / (F.col("volume") * 100.0)).alias("close"), "volume")
    events = cells.where("paid IS NOT NULL").select(
        "asset", F.col("date").alias("ex_date"), F.date_add("date", 10).alias("payment_date"),
        (F.col("paid") / 1_000_000.0).alias("value"),
    )
    return _table(spark, sf, prices, events, roles.bench_of(cells), version)


@query("feature_table_v1_suppliers", _supplier_sql("v1"))
def suppliers_v1(spark, sf):
    return _supplier_table(spark, sf, "v1")


@query("feature_table_v2_suppliers", _supplier_sql("v2"))
def suppliers_v2(spark, sf):
    return _supplier_table(spark, sf, "v2")
