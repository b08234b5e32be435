"""Window operators over the panel (survey ids WN*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions import rolling as R
from panelloom.keys import KEYS, calendar_order
from panelloom.operators import calendar as cal
from panelloom.operators import features as feat
from panelloom.operators import joins, ranking, returns
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.sources.tables import bucketed, materialise, scratch_dir, table_name


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# Frames of the SQL counterparts.
_HIST = "PARTITION BY asset ORDER BY date"


def trail(column: str, n: int, part: str = _HIST, need: int | None = None) -> str:
    frame = f"({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    need = n if need is None else need
    return (
        f"CASE WHEN count({column}) OVER {frame} >= {need} "
        f"THEN exp(sum(ln(1 + {column})) OVER {frame}) - 1 END"
    )


def fwd(column: str, n: int, part: str = _HIST, need: int | None = None) -> str:
    frame = f"({part} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    need = n if need is None else need
    return (
        f"CASE WHEN count({column}) OVER {frame} >= {need} "
        f"THEN exp(sum(ln(1 + {column})) OVER {frame}) - 1 END"
    )


@query(
    "flagship_beat_benchmark_panel",
    sql(
        "tr br",
        f"""
SELECT a.asset, a.date, a.close, round(a.total_return, 6) + 0e0 AS total_return,
       round(a.return_7d, 6) + 0e0 AS return_7d, round(b.bench_return, 6) + 0e0 AS bench_return,
       round(b.bench_return_7d, 6) + 0e0 AS bench_return_7d,
       a.f > b.f AS target_7d, round(a.f - b.f, 6) + 0e0 AS target_alpha_7d
FROM (SELECT *, {trail('total_return', 7)} AS return_7d, {fwd('total_return', 7)} AS f FROM tr) a
LEFT JOIN (SELECT *, {trail('bench_return', 7, 'ORDER BY date')} AS bench_return_7d,
                  {fwd('bench_return', 7, 'ORDER BY date')} AS f FROM br) b USING (date)""",
    ),
)
def flagship(spark, sf):
    prices = roles.prices(spark, sf)
    own = feat.trailing_returns(roles.total_returns(spark, sf, prices), (7,))
    side = feat.benchmark_trailing(roles.bench_returns(prices), (7,))
    joined = joins.attach_series(
        own, side, {"bench_return": "bench_return", "bench_return_7d": "bench_return_7d"}
    )
    full = feat.forward_targets(joined, side, 7)
    return full.select(
        "asset", "date", "close", r6("total_return"), r6("return_7d"), r6("bench_return"),
        r6("bench_return_7d"), "target_7d", r6("target_alpha_7d"),
    )


@query(
    "wn1_lag_return",
    sql(
        "panel",
        """
SELECT asset, date, lag(close) OVER (PARTITION BY asset ORDER BY date) AS close_prev,
       round((close - lag(close) OVER (PARTITION BY asset ORDER BY date)) / lag(close) OVER (PARTITION BY asset ORDER BY date), 6) + 0e0 AS simple_return
FROM panel""",
    ),
)
def wn1(spark, sf):
    w = KEYS.history()
    df = roles.panel(spark, sf).select(
        "asset", "date", F.lag("close", 1).over(w).alias("close_prev"),
        R.simple_return(w, F.col("close")).alias("simple_return"),
    )
    return df.select("asset", "date", "close_prev", r6("simple_return"))


@query(
    "wn1_bucketed_panel",
    sql(
        "panel",
        "SELECT asset, date, lag(close) OVER (PARTITION BY asset ORDER BY date) AS close_prev FROM panel",
    ),
)
def wn1_bucketed(spark, sf):
    """A window by asset over a panel that is stored by asset: no exchange."""
    panel = roles.panel(spark, sf).select("asset", "date", "close")
    stored = bucketed(panel, table_name("panel"), ["asset"], 8, ["date"], scratch_dir(spark, "panel"))
    return stored.select("asset", "date", F.lag("close", 1).over(KEYS.history()).alias("close_prev"))


@query(
    "wn2_benchmark_return",
    sql("br", "SELECT date, bench_close, round(bench_return, 6) + 0e0 AS bench_return FROM br"),
)
def wn2(spark, sf):
    return returns.benchmark_returns(roles.bench(spark, sf)).select("date", "bench_close", r6("bench_return"))


@query(
    "wn3_total_return",
    sql(
        "tr",
        """
SELECT asset, date, close, close_prev, volume, has_trading, dividend_value, round(price_return, 6) + 0e0 AS price_return,
       round(dividend_return, 6) + 0e0 AS dividend_return, round(total_return, 6) + 0e0 AS total_return FROM tr""",
    ),
)
def wn3(spark, sf):
    df = roles.total_returns(spark, sf)
    return df.select(
        "asset", "date", "close", "close_prev", "volume", "has_trading", "dividend_value",
        r6("price_return"), r6("dividend_return"), r6("total_return"),
    )


@query(
    "wn3_total_return_next_session",
    sql(
        "panel divs",
        """
WITH moved AS (
  SELECT asset, session AS date, sum(value) AS dividend_value
  FROM (SELECT d.asset, d.value, (SELECT min(p.date) FROM panel p WHERE p.asset = d.asset AND p.date >= d.ex_date) AS session
        FROM divs d) WHERE session IS NOT NULL GROUP BY 1, 2),
j AS (SELECT p.asset, p.date, p.close, lag(p.close) OVER (PARTITION BY p.asset ORDER BY p.date) AS close_prev,
             COALESCE(m.dividend_value, 0e0) AS dividend_value
      FROM panel p LEFT JOIN moved m ON m.asset = p.asset AND m.date = p.date)
SELECT asset, date, round(dividend_value, 6) + 0e0 AS dividend_value,
       round((close - close_prev) / close_prev + dividend_value / close_prev, 6) + 0e0 AS total_return FROM j""",
    ),
)
def wn3_next(spark, sf):
    df = roles.total_returns(spark, sf, on_missing_session="next")
    return df.select("asset", "date", r6("dividend_value"), r6("total_return"))


@query(
    "wn4_trailing_return",
    sql(
        "tr",
        f"""
SELECT asset, date, round(lag(total_return) OVER ({_HIST}), 6) + 0e0 AS return_1d, round({trail('total_return', 7)}, 6) + 0e0 AS return_7d,
       round({trail('total_return', 30)}, 6) + 0e0 AS return_30d, round({trail('total_return', 90)}, 6) + 0e0 AS return_90d FROM tr""",
    ),
)
def wn4(spark, sf):
    df = feat.trailing_returns(roles.total_returns(spark, sf))
    return df.select("asset", "date", r6("return_1d"), r6("return_7d"), r6("return_30d"), r6("return_90d"))


@query(
    "wn4_trailing_return_partial_frames",
    sql(
        "tr",
        f"SELECT asset, date, round({trail('total_return', 30, need=1)}, 6) + 0e0 AS return_30d FROM tr",
    ),
)
def wn4_partial(spark, sf):
    df = feat.trailing_returns(roles.total_returns(spark, sf), (30,), min_periods=1)
    return df.select("asset", "date", r6("return_30d"))


_B = "ORDER BY date"


@query(
    "wn5_benchmark_trailing_return",
    sql(
        "br",
        f"""
SELECT date, round(lag(bench_return) OVER ({_B}), 6) + 0e0 AS bench_return_1d, round({trail('bench_return', 7, _B)}, 6) + 0e0 AS bench_return_7d,
       round({trail('bench_return', 30, _B)}, 6) + 0e0 AS bench_return_30d, round({trail('bench_return', 90, _B)}, 6) + 0e0 AS bench_return_90d FROM br""",
    ),
)
def wn5(spark, sf):
    df = feat.benchmark_trailing(returns.benchmark_returns(roles.bench(spark, sf)))
    return df.select("date", *[r6(f"bench_return_{n}d") for n in (1, 7, 30, 90)])


def _vol(n: int) -> str:
    frame = f"({_HIST} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(total_return) OVER {frame} >= {n} THEN stddev_samp(total_return) OVER {frame} END"


@query(
    "wn6_volatility",
    sql(
        "tr",
        f"SELECT asset, date, round({_vol(30)}, 6) + 0e0 AS volatility_30d, round({_vol(90)}, 6) + 0e0 AS volatility_90d FROM tr",
    ),
)
def wn6(spark, sf):
    df = feat.volatility(roles.total_returns(spark, sf))
    return df.select("asset", "date", r6("volatility_30d"), r6("volatility_90d"))


_DIV = """
WITH y AS (
  SELECT asset, date, close, dividend_value,
         sum(dividend_value) OVER (PARTITION BY asset ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) / close AS y12,
         min(date) OVER (PARTITION BY asset) AS first_date,
         max(CASE WHEN dividend_value > 0 THEN date END) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM tr)
"""


@query(
    "wn7_trailing_365_day_yield",
    sql("tr", _DIV + "SELECT asset, date, round(y12, 6) + 0e0 AS dividend_yield_12m FROM y"),
)
def wn7(spark, sf):
    df = feat.dividend_features(roles.total_returns(spark, sf))
    return df.select("asset", "date", r6("dividend_yield_12m"))


@query(
    "wn8_days_of_history",
    sql("tr", _DIV + "SELECT asset, date, CAST(date - first_date AS INTEGER) AS dividend_history_days FROM y"),
)
def wn8(spark, sf):
    df = feat.dividend_features(roles.total_returns(spark, sf))
    return df.select("asset", "date", "dividend_history_days")


@query(
    "wn9_days_since_last_event",
    sql("tr", _DIV + "SELECT asset, date, CAST(date - seen AS INTEGER) AS days_since_last_dividend FROM y"),
)
def wn9(spark, sf):
    df = feat.dividend_features(roles.total_returns(spark, sf))
    return df.select("asset", "date", "days_since_last_dividend")


@query(
    "wn10_excess_return",
    sql(
        "tr br",
        f"""
SELECT a.asset, a.date, round(a.r30 - b.r30, 6) + 0e0 AS alpha_30d, round(a.r90 - b.r90, 6) + 0e0 AS alpha_90d
FROM (SELECT asset, date, {trail('total_return', 30)} AS r30, {trail('total_return', 90)} AS r90 FROM tr) a
LEFT JOIN (SELECT date, {trail('bench_return', 30, _B)} AS r30, {trail('bench_return', 90, _B)} AS r90 FROM br) b USING (date)""",
    ),
)
def wn10(spark, sf):
    prices = roles.prices(spark, sf)
    own = feat.trailing_returns(roles.total_returns(spark, sf, prices), (30, 90))
    side = feat.benchmark_trailing(roles.bench_returns(prices), (30, 90))
    both = feat.with_benchmark(own, side, ["bench_return_30d", "bench_return_90d"])
    return feat.excess_returns(both).select("asset", "date", r6("alpha_30d"), r6("alpha_90d"))


@query(
    "wn11_forward_return",
    sql("tr", f"SELECT asset, date, round({fwd('total_return', 7)}, 6) + 0e0 AS future_return_7d FROM tr"),
)
def wn11(spark, sf):
    prices = roles.prices(spark, sf)
    df = feat.forward_targets(roles.total_returns(spark, sf, prices), roles.bench_returns(prices), keep_legs=True)
    return df.select("asset", "date", r6("future_return_7d"))


def _target_sql(need: int) -> str:
    return f"""
SELECT a.asset, a.date, a.f > b.f AS target_7d, round(a.f - b.f, 6) + 0e0 AS target_alpha_7d
FROM (SELECT asset, date, {fwd('total_return', 7, need=need)} AS f FROM tr) a
LEFT JOIN (SELECT date, {fwd('bench_return', 7, _B, need)} AS f FROM br) b USING (date)"""


@query("wn12_targets", sql("tr br", _target_sql(7)))
def wn12(spark, sf):
    prices = roles.prices(spark, sf)
    df = feat.forward_targets(roles.total_returns(spark, sf, prices), roles.bench_returns(prices))
    return df.select("asset", "date", "target_7d", r6("target_alpha_7d"))


@query("wn12_targets_partial_horizon", sql("tr br", _target_sql(1)))
def wn12_partial(spark, sf):
    prices = roles.prices(spark, sf)
    df = feat.forward_targets(roles.total_returns(spark, sf, prices), roles.bench_returns(prices), min_periods=1)
    return df.select("asset", "date", "target_7d", r6("target_alpha_7d"))


@query(
    "wn13_forward_fill",
    sql(
        "panel divs",
        """
SELECT p.asset, p.date, last_value(d.value IGNORE NULLS) OVER (PARTITION BY p.asset ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date""",
    ),
)
def wn13(spark, sf):
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value")
    joined = roles.panel(spark, sf).join(paid, KEYS.pair, "left")
    return joined.select("asset", "date", R.forward_fill(KEYS.history(), F.col("value")).alias("filled"))


def _technical(spark, sf, **kwargs):
    prices = roles.prices(spark, sf)
    base = feat.with_benchmark(roles.panel_of(prices), roles.bench_returns(prices), ["bench_return"])
    none = {"rsi": (), "averages": (), "betas": (), "outperform": (), "drawdowns": ()}
    return feat.technical_features(base, **{**none, **kwargs})


def _upto(n: int) -> str:
    return f"(PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rsi(n: int) -> str:
    f = _upto(n)
    return (
        f"CASE WHEN count(*) OVER {f} >= {n} THEN CASE WHEN avg(loss) OVER {f} = 0 THEN 100e0 "
        f"ELSE 100e0 - 100e0 / (1 + avg(gain) OVER {f} / avg(loss) OVER {f}) END END"
    )


_MOVES = """
WITH m AS (SELECT asset, date, close - lag(close) OVER (PARTITION BY asset ORDER BY date) AS mv FROM panel),
g AS (SELECT asset, date, CASE WHEN mv > 0 THEN mv ELSE 0e0 END AS gain, CASE WHEN mv < 0 THEN -mv ELSE 0e0 END AS loss FROM m)
"""


@query("wn14_rsi", sql("panel", _MOVES + f"SELECT asset, date, round({_rsi(14)}, 6) + 0e0 AS rsi_14d FROM g"))
def wn14(spark, sf):
    return _technical(spark, sf, rsi=(14,)).select("asset", "date", r6("rsi_14d"))


def _ma(n: int) -> str:
    f = _upto(n)
    return f"CASE WHEN count(close) OVER {f} >= {n} THEN (close - avg(close) OVER {f}) / avg(close) OVER {f} END"


@query(
    "wn15_price_vs_moving_average",
    sql(
        "panel",
        f"SELECT asset, date, round({_ma(7)}, 6) + 0e0 AS price_vs_ma_7d, round({_ma(30)}, 6) + 0e0 AS price_vs_ma_30d FROM panel",
    ),
)
def wn15(spark, sf):
    df = _technical(spark, sf, averages=(7, 30))
    return df.select("asset", "date", r6("price_vs_ma_7d"), r6("price_vs_ma_30d"))


def _beta(n: int, need: int) -> str:
    f = _upto(n)
    return (
        f"CASE WHEN count(x) OVER {f} >= {need} AND var_pop(x) OVER {f} > 0 "
        f"THEN covar_pop(y, x) OVER {f} / var_pop(x) OVER {f} END"
    )


_PAIRS = """
WITH p AS (SELECT asset, date, (close - lag(close) OVER (PARTITION BY asset ORDER BY date)) / lag(close) OVER (PARTITION BY asset ORDER BY date) AS y0 FROM panel),
q AS (SELECT p.asset, p.date, CASE WHEN b.bench_return IS NOT NULL THEN y0 END AS y, CASE WHEN y0 IS NOT NULL THEN b.bench_return END AS x
      FROM p LEFT JOIN br b USING (date))
"""


@query(
    "wn16_rolling_beta",
    sql("panel br", _PAIRS + f"SELECT asset, date, round({_beta(30, 30)}, 6) + 0e0 AS beta_30d, round({_beta(90, 60)}, 6) + 0e0 AS beta_90d FROM q"),
)
def wn16(spark, sf):
    return _technical(spark, sf, betas=(30, 90)).select("asset", "date", r6("beta_30d"), r6("beta_90d"))


@query(
    "wn17_outperformance_rate",
    sql(
        "panel br",
        _PAIRS
        + f"SELECT asset, date, round(CASE WHEN count(*) OVER {_upto(30)} >= 30 THEN avg(CASE WHEN y > x THEN 1e0 ELSE 0e0 END) OVER {_upto(30)} END, 6) + 0e0 AS outperform_rate_30d FROM q",
    ),
)
def wn17(spark, sf):
    return _technical(spark, sf, outperform=(30,)).select("asset", "date", r6("outperform_rate_30d"))


def _dd(n: int) -> str:
    f = _upto(n)
    return f"CASE WHEN count(close) OVER {f} >= {n} THEN (max(close) OVER {f} - close) / max(close) OVER {f} END"


@query("wn18_drawdown", sql("panel", f"SELECT asset, date, round({_dd(30)}, 6) + 0e0 AS drawdown_30d FROM panel"))
def wn18(spark, sf):
    return _technical(spark, sf, drawdowns=(30,)).select("asset", "date", r6("drawdown_30d"))


@query(
    "wn19_window_status",
    sql(
        "panel br",
        _PAIRS
        + f"""
SELECT asset, date, n_valid, CASE WHEN n_valid < 60 THEN 'incomplete' WHEN v IS NULL THEN 'null' WHEN v = 0 THEN 'zero' ELSE 'ok' END AS status
FROM (SELECT asset, date, count(x) OVER {_upto(90)} AS n_valid, var_pop(x) OVER {_upto(90)} AS v FROM q)""",
    ),
)
def wn19(spark, sf):
    w = KEYS.history()
    prices = roles.prices(spark, sf)
    base = feat.with_benchmark(roles.panel_of(prices), roles.bench_returns(prices), ["bench_return"])
    paired = base.withColumn("y", R.simple_return(w, F.col("close"))).withColumn(
        "x", F.when(F.col("y").isNotNull(), F.col("bench_return"))
    )
    fr = R.Frames(w)
    counted = fr.select(
        paired, fr.count(F.col("x"), -89, 0).alias("n_valid"), fr.rows(F.var_pop("x"), -89, 0).alias("v")
    )
    status = (
        F.when(F.col("n_valid") < 60, "incomplete")
        .when(F.col("v").isNull(), "null")
        .when(F.col("v") == 0, "zero")
        .otherwise("ok")
    )
    return counted.select("asset", "date", "n_valid", status.alias("status"))


@query(
    "wn20_rank_within_date",
    sql("ranked_pred", "SELECT signal_date, asset, prob, rank FROM ranked_pred"),
)
def wn20(spark, sf):
    scored = materialise(roles.predictions(roles.market(spark, sf)).select("signal_date", "asset", "prob"), "predictions")
    return ranking.rank_by_score(scored).select("signal_date", "asset", "prob", "rank")


@query(
    "wn21_score_gap",
    sql(
        "ranked_pred",
        """
SELECT signal_date, max(CASE WHEN rank = 1 THEN prob END) AS best, max(CASE WHEN rank = 2 THEN prob END) AS second,
       round(max(CASE WHEN rank = 1 THEN prob END) - max(CASE WHEN rank = 2 THEN prob END), 6) + 0e0 AS gap
FROM ranked_pred GROUP BY 1""",
    ),
)
def wn21(spark, sf):
    return ranking.score_gap(roles.predictions(roles.market(spark, sf))).select("signal_date", "best", "second", r6("gap"))


@query(
    "wn22_equity_curve",
    sql(
        "rp",
        """
SELECT asset, date, round(100000e0 * exp(sum(ln(1 + total_return)) OVER w), 4) + 0e0 AS capital,
       round(exp(sum(ln(1 + total_return)) OVER w) - 1, 6) + 0e0 AS cumulative_return
FROM rp WINDOW w AS (PARTITION BY asset ORDER BY date)""",
    ),
)
def wn22(spark, sf):
    from panelloom.operators.backtest import equity_curve

    curve = equity_curve(roles.return_cells(spark, sf), ["asset"], "total_return", date="date")
    return curve.select("asset", "date", F.round("capital", 4).alias("capital"), r6("cumulative_return"))


@query(
    "wn23_running_max_drawdown",
    sql(
        "rp",
        """
WITH c AS (SELECT asset, date, exp(sum(ln(1 + total_return)) OVER (PARTITION BY asset ORDER BY date)) AS capital FROM rp),
d AS (SELECT asset, capital / max(capital) OVER (PARTITION BY asset ORDER BY date) - 1 AS dd FROM c)
SELECT asset, round(min(dd), 6) + 0e0 AS max_drawdown FROM d GROUP BY 1""",
    ),
)
def wn23(spark, sf):
    from panelloom.operators.backtest import equity_curve, with_drawdown

    curve = equity_curve(roles.return_cells(spark, sf), ["asset"], "total_return", 1.0, date="date")
    dd = with_drawdown(curve, ["asset"], "date")
    return dd.groupBy("asset").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"))


@query(
    "wn24_weight_change",
    sql(
        "wgrid",
        """
SELECT strategy, signal_date, asset, round(weight, 6) + 0e0 AS weight, round(prev_weight, 6) + 0e0 AS prev_weight, round(weight - prev_weight, 6) + 0e0 AS change
FROM wgrid WHERE weight <> 0 OR prev_weight <> 0""",
    ),
)
def wn24(spark, sf):
    from panelloom.operators import backtest as bt

    rebalances = materialise(roles.rebalances(roles.market(spark, sf)), "rebalances")
    changes = bt.weight_changes(bt.weights(rebalances))
    kept = changes.where((F.col("weight") != 0) | (F.col("prev_weight") != 0))
    return kept.select("strategy", "signal_date", "asset", r6("weight"), r6("prev_weight"), r6("change"))


@query(
    "wn25_every_nth_session",
    sql("rp_cal", "SELECT date, session_idx FROM rp_cal WHERE (session_idx - 1) % 7 = 0"),
)
def wn25(spark, sf):
    return cal.every_nth_session(cal.sessions(roles.return_cells(spark, sf)), 7).select("date", "session_idx")


@query(
    "wn26_first_session_of_month",
    sql(
        "panel",
        "SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS decision_date FROM panel GROUP BY 1",
    ),
)
def wn26(spark, sf):
    return cal.first_session_of_month(cal.sessions(roles.panel(spark, sf)))


@query(
    "wn27_target_21_sessions",
    sql(
        "tr br",
        f"""
WITH a AS (SELECT asset, date, (lead(close, 21) OVER ({_HIST}) + sum(dividend_value) OVER ({_HIST} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)) / close - 1 AS f FROM tr),
b AS (SELECT date, lead(bench_close, 21) OVER (ORDER BY date) / bench_close - 1 AS f FROM br)
SELECT a.asset, a.date, round(a.f, 6) + 0e0 AS future_return_21d, round(b.f, 6) + 0e0 AS future_bench_21d, a.f > b.f AS target_21d
FROM a LEFT JOIN b USING (date)""",
    ),
)
def wn27(spark, sf):
    prices = roles.prices(spark, sf)
    df = feat.price_cash_targets(roles.total_returns(spark, sf, prices), roles.bench_returns(prices))
    return df.select("asset", "date", r6("future_return_21d"), r6("future_bench_21d"), "target_21d")


@query(
    "wn28_long_horizon_variants",
    sql(
        "tr br",
        f"""
SELECT a.asset, a.date, round(a.r180, 6) + 0e0 AS return_180d, round(a.r360, 6) + 0e0 AS return_360d, round(a.r180 - b.r180, 6) + 0e0 AS alpha_180d, a.last_dividend
FROM (SELECT asset, date, {trail('total_return', 180)} AS r180, {trail('total_return', 360)} AS r360,
             last_value(CASE WHEN dividend_value > 0 THEN dividend_value END IGNORE NULLS) OVER ({_HIST} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_dividend
      FROM tr) a
LEFT JOIN (SELECT date, {trail('bench_return', 180, _B)} AS r180 FROM br) b USING (date)""",
    ),
)
def wn28(spark, sf):
    prices = roles.prices(spark, sf)
    own = feat.last_event_value(feat.trailing_returns(roles.total_returns(spark, sf, prices), (180, 360)))
    side = feat.benchmark_trailing(roles.bench_returns(prices), (180,))
    both = feat.excess_returns(feat.with_benchmark(own, side, ["bench_return_180d"]), (180,))
    return both.select("asset", "date", r6("return_180d"), r6("return_360d"), r6("alpha_180d"), "last_dividend")


@query(
    "wn28_macro_12_months",
    sql(
        "macro_monthly",
        """
SELECT month, round(CASE WHEN count(*) OVER w >= 12 THEN exp(sum(ln(1 + macro_c / 100)) OVER w) - 1 END, 8) + 0e0 AS macro_12m
FROM macro_monthly WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    ),
)
def wn28_macro(spark, sf):
    df = feat.compounded_monthly(roles.macro_monthly(spark, sf), "macro_c", "macro_12m")
    return df.select("month", F.round("macro_12m", 8).alias("macro_12m"))


@query(
    "wn29_wider_windows",
    sql(
        "panel br",
        _MOVES.rstrip()
        + f""",
p AS (SELECT asset, date, close, (close - lag(close) OVER (PARTITION BY asset ORDER BY date)) / lag(close) OVER (PARTITION BY asset ORDER BY date) AS y FROM panel),
q AS (SELECT p.*, b.bench_return AS x FROM p LEFT JOIN br b USING (date)),
k AS (SELECT asset, date, {_rsi(30)} AS rsi FROM g)
SELECT q.asset, q.date, round(k.rsi, 6) + 0e0 AS rsi_30d,
       round(CASE WHEN count(*) OVER {_upto(90).replace('PARTITION BY asset ORDER BY date', 'PARTITION BY q.asset ORDER BY q.date')} >= 90
         THEN (close - avg(close) OVER w) / avg(close) OVER w END, 6) + 0e0 AS price_vs_ma_90d,
       round(CASE WHEN count(*) OVER w >= 90 THEN avg(CASE WHEN y > x THEN 1e0 ELSE 0e0 END) OVER w END, 6) + 0e0 AS outperform_rate_90d
FROM q JOIN k ON k.asset = q.asset AND k.date = q.date
WINDOW w AS (PARTITION BY q.asset ORDER BY q.date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)""",
    ),
)
def wn29(spark, sf):
    df = _technical(spark, sf, rsi=(30,), averages=(90,), outperform=(90,))
    return df.select("asset", "date", r6("rsi_30d"), r6("price_vs_ma_90d"), r6("outperform_rate_90d"))


@query(
    "wn29_derived_features",
    sql(
        "tr macro_daily",
        f"""
WITH b AS (
  SELECT t.*, m.macro_a, {_vol(30)} AS v30, {_vol(90)} AS v90,
         sum(dividend_value) OVER (PARTITION BY asset ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) / close AS y12,
         sum(dividend_value) OVER (PARTITION BY asset ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) / close AS y30,
         sum(CASE WHEN dividend_value > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS freq,
         CASE WHEN count(total_return) OVER ({_HIST} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) >= 30
              THEN avg(total_return) OVER ({_HIST} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) / stddev_samp(total_return) OVER ({_HIST} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS sharpe
  FROM tr t LEFT JOIN macro_daily m USING (date)),
c AS (SELECT *, y12 / nullif(lag(y12, 252) OVER ({_HIST}), 0) - 1 AS growth, macro_a - lag(macro_a, 30) OVER ({_HIST}) AS mc FROM b)
SELECT asset, date, round(v30 - v90, 6) + 0e0 AS volatility_change, round(v30 / v90, 6) + 0e0 AS volatility_ratio, round(sharpe, 6) + 0e0 AS sharpe_30d,
       round(y30, 6) + 0e0 AS dividend_yield_30d, CAST(COALESCE(freq, 0) AS BIGINT) AS dividend_frequency_12m,
       round(growth, 6) + 0e0 AS dividend_growth, round(mc, 8) + 0e0 AS macro_change_30d, mc > 0 AS macro_rising FROM c""",
    ),
)
def wn29_derived(spark, sf):
    base = feat.dividend_features(feat.volatility(roles.total_returns(spark, sf)))
    base = joins.attach_series(base, roles.macro_daily(spark, sf), {"macro_a": "macro_a"})
    df = feat.derived_features(base)
    return df.select(
        "asset", "date", r6("volatility_change"), r6("volatility_ratio"), r6("sharpe_30d"),
        r6("dividend_yield_30d"), "dividend_frequency_12m", r6("dividend_growth"),
        F.round("macro_change_30d", 8).alias("macro_change_30d"), "macro_rising",
    )
