"""Ranking and backtest queries (survey ids RK*, BT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.scalars import month_start
from panelloom.operators import backtest as bt
from panelloom.operators import ranking as rk
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.queries.roles_sql import CTES
from panelloom.queries.windows import r6
from panelloom.sources.tables import materialise

# Cost scenarios, as a rate per unit of turnover.
RATES = {"zero": 0.0, "0.05%": 0.0005, "0.10%": 0.001, "0.20%": 0.002, "0.30%": 0.003}


def settled_periods(spark, sf):
    """Market and its holding periods as a written table: every strategy reads the periods."""
    market = roles.market(spark, sf)
    return market, materialise(roles.periods(market), "periods")


_PICKS = """
picks AS (SELECT signal_date, arg_min(asset, rank) AS picked_asset, min(CASE WHEN rank = 1 THEN prob END) AS picked_prob,
                 bool_or(rank = 1 AND target) AS beat_benchmark, max(CASE WHEN rank = 1 THEN alpha END) AS picked_alpha,
                 max(alpha) AS best_alpha, max(CASE WHEN rank = 1 THEN alpha END) = max(alpha) AS was_best, count(*) AS candidates
          FROM {source} GROUP BY 1)"""

_SUMMARY = """
SELECT dates, hits, best_hits, round(mean_alpha, 8) + 0e0 AS mean_alpha, round(hits / CAST(dates AS DOUBLE), 6) + 0e0 AS hit_rate,
       round(hits / CAST(dates AS DOUBLE) - 1.96e0 * sqrt(hits / CAST(dates AS DOUBLE) * (1 - hits / CAST(dates AS DOUBLE)) / dates), 6) + 0e0 AS ci_lower,
       round(hits / CAST(dates AS DOUBLE) + 1.96e0 * sqrt(hits / CAST(dates AS DOUBLE) * (1 - hits / CAST(dates AS DOUBLE)) / dates), 6) + 0e0 AS ci_upper,
       round(best_hits / CAST(dates AS DOUBLE), 6) + 0e0 AS best_rate
FROM (SELECT count(*) AS dates, count(*) FILTER (beat_benchmark) AS hits, count(*) FILTER (was_best) AS best_hits, avg(picked_alpha) AS mean_alpha FROM picks)"""


def _summary(df, *keys):
    return df.select(
        *keys, "dates", "hits", "best_hits", F.round("mean_alpha", 8).alias("mean_alpha"),
        r6("hit_rate"), r6("ci_lower"), r6("ci_upper"), r6("best_rate"),
    )


@query(
    "rk1_top_pick_per_date",
    sql(
        "ranked_pred",
        f"WITH {_PICKS.format(source='ranked_pred').strip()} SELECT signal_date, picked_asset, picked_prob, beat_benchmark, round(picked_alpha, 6) + 0e0 AS picked_alpha, round(best_alpha, 6) + 0e0 AS best_alpha, was_best, candidates FROM picks",
    ),
)
def rk1(spark, sf):
    picks = rk.top_picks(roles.predictions(roles.market(spark, sf)))
    return picks.select(
        "signal_date", "picked_asset", "picked_prob", "beat_benchmark", r6("picked_alpha"), r6("best_alpha"), "was_best", "candidates"
    )


@query(
    "rk1_top_pick_summary",
    sql("ranked_pred", f"WITH {_PICKS.format(source='ranked_pred').strip()} {_SUMMARY}"),
)
def rk1_summary(spark, sf):
    return _summary(rk.pick_summary(rk.top_picks(roles.predictions(roles.market(spark, sf)))))


@query(
    "rk2_picks_by_asset",
    sql(
        "ranked_pred",
        f"""WITH {_PICKS.format(source='ranked_pred').strip()}
SELECT picked_asset, count(*) AS picks, round(avg(CAST(beat_benchmark AS INTEGER)), 6) + 0e0 AS hit_rate,
       round(count(*) / CAST((SELECT count(*) FROM picks) AS DOUBLE), 6) + 0e0 AS pick_share FROM picks GROUP BY 1""",
    ),
)
def rk2(spark, sf):
    picks = rk.top_picks(roles.predictions(roles.market(spark, sf)))
    return rk.pick_concentration(picks).select("picked_asset", "picks", r6("hit_rate"), r6("pick_share"))


@query(
    "rk2_picks_by_month",
    sql(
        "ranked_pred",
        f"""WITH {_PICKS.format(source='ranked_pred').strip()}
SELECT CAST(date_trunc('month', signal_date) AS DATE) AS month, count(*) AS picks, round(avg(CAST(beat_benchmark AS INTEGER)), 6) + 0e0 AS hit_rate FROM picks GROUP BY 1""",
    ),
)
def rk2_month(spark, sf):
    picks = rk.top_picks(roles.predictions(roles.market(spark, sf)))
    by_month = rk.pick_concentration(picks.withColumn("month", month_start(F.col("signal_date"))), ["month"])
    return by_month.select("month", "picks", r6("hit_rate"))


@query(
    "rk2_picks_by_year",
    sql(
        "ranked_pred",
        f"""WITH {_PICKS.format(source='ranked_pred').strip()}
SELECT year(signal_date) AS year, count(*) AS dates, count(*) FILTER (beat_benchmark) AS hits, round(avg(CAST(beat_benchmark AS INTEGER)), 6) + 0e0 AS hit_rate,
       round(avg(CAST(was_best AS INTEGER)), 6) + 0e0 AS best_rate FROM picks GROUP BY 1""",
    ),
)
def rk2_year(spark, sf):
    picks = rk.top_picks(roles.predictions(roles.market(spark, sf)))
    by_year = rk.pick_summary(picks.withColumn("year", F.year("signal_date").cast("long")), ["year"])
    return by_year.select("year", "dates", "hits", r6("hit_rate"), r6("best_rate"))


@query(
    "rk2_best_realised_pick",
    sql(
        "periods",
        """
SELECT signal_date, arg_min(asset, {'p': -prob, 'a': asset}) AS picked_asset,
       round(arg_min(period_return, {'p': -prob, 'a': asset}), 6) + 0e0 AS picked_return, round(max(period_return), 6) + 0e0 AS best_return,
       arg_min(period_return, {'p': -prob, 'a': asset}) = max(period_return) AS was_best, count(*) AS candidates
FROM periods WHERE prob IS NOT NULL GROUP BY 1""",
    ),
)
def rk2_realised(spark, sf):
    _, periods = settled_periods(spark, sf)
    picks = rk.top_picks(periods.withColumn("target", F.col("period_return") > 0), alpha="period_return")
    return picks.select(
        "signal_date", "picked_asset", r6("picked_alpha").alias("picked_return"), r6("best_alpha").alias("best_return"), "was_best", "candidates"
    )


@query(
    "rk1_unknown_scores",
    """
WITH s AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -o_totalprice ELSE o_totalprice / 1e9 END AS prob FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY prob DESC NULLS LAST, k) AS rank FROM s)
SELECT d AS signal_date, k AS asset, rank FROM r""",
)
def rk1_unknown(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    nan = F.when(key % 2 == 0, F.lit(float("nan")))
    score = F.when(key % 5 == 0, nan).when(key % 5 == 1, -price).otherwise(price / 1e9)
    df = roles.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("signal_date"), key.alias("asset"), score.alias("prob"))
    return rk.rank_by_score(df).select("signal_date", "asset", "rank")


@query(
    "rk3_non_overlapping_audit",
    sql("ranked_rebal", f"WITH {_PICKS.format(source='ranked_rebal').strip()} {_SUMMARY}"),
)
def rk3(spark, sf):
    return _summary(rk.pick_summary(rk.top_picks(roles.rebalances(roles.market(spark, sf)))))


# Hit rates to compare with.
REFERENCE_RATES = {"historical": 0.5794, "daily": 0.4777, "coin": 0.5}


@query(
    "rk3_rate_comparison",
    sql(
        "ranked_rebal",
        f"""WITH {_PICKS.format(source='ranked_rebal').strip()}, s AS ({_SUMMARY})
SELECT reference, reference_rate, hit_rate, round(hit_rate - reference_rate, 6) + 0e0 AS difference, reference_rate BETWEEN ci_lower AND ci_upper AS inside_interval
FROM s, (VALUES ('historical', 0.5794e0), ('daily', 0.4777e0), ('coin', 0.5e0)) r(reference, reference_rate)""",
    ),
)
def rk3_rates(spark, sf):
    summary = rk.pick_summary(rk.top_picks(roles.rebalances(roles.market(spark, sf))))
    out = rk.compare_rates(summary, REFERENCE_RATES)
    return out.select("reference", "reference_rate", r6("hit_rate"), r6("difference"), "inside_interval")


@query(
    "bt1_period_returns",
    sql("periods", "SELECT signal_date, asset, round(period_return, 6) + 0e0 AS period_return, sessions_held FROM periods"),
)
def bt1(spark, sf):
    _, periods = settled_periods(spark, sf)
    return periods.select("signal_date", "asset", r6("period_return"), "sessions_held")


@query("bt2_strategy_weights", sql("weights", "SELECT strategy, signal_date, asset, round(weight, 6) + 0e0 AS weight FROM weights WHERE strategy <> 'random'"))
def bt2(spark, sf):
    _, periods = settled_periods(spark, sf)
    return bt.weights(periods).where("strategy <> 'random'").select("strategy", "signal_date", "asset", r6("weight"))


@query("bt3_random_baseline", sql("weights", "SELECT signal_date, asset FROM weights WHERE strategy = 'random' AND weight = 1"))
def bt3(spark, sf):
    _, periods = settled_periods(spark, sf)
    return bt.weights(periods).where("strategy = 'random' AND weight = 1").select("signal_date", "asset")


@query(
    "bt4_hysteresis",
    sql(
        "ranked_rebal",
        """
WITH RECURSIVE b AS (SELECT signal_date, row_number() OVER (ORDER BY signal_date) AS i, asset AS best, prob AS best_prob FROM ranked_rebal WHERE rank = 1),
walk AS (
  SELECT i, signal_date, best AS held_asset, true AS switched FROM b WHERE i = 1
  UNION ALL
  SELECT b.i, b.signal_date, CASE WHEN b.best_prob - h.prob > 0.3e0 THEN b.best ELSE w.held_asset END,
         COALESCE(b.best_prob - h.prob > 0.3e0, false)
  FROM walk w JOIN b ON b.i = w.i + 1 LEFT JOIN ranked_rebal h ON h.signal_date = b.signal_date AND h.asset = w.held_asset)
SELECT signal_date, held_asset, switched FROM walk""",
    ),
)
def bt4(spark, sf):
    _, periods = settled_periods(spark, sf)
    return bt.hysteresis(periods, 0.3)


@query("bt5_portfolio_return", sql("gross", "SELECT strategy, signal_date, round(gross_return, 6) + 0e0 AS gross_return FROM gross"))
def bt5(spark, sf):
    _, periods = settled_periods(spark, sf)
    return bt.portfolio_returns(bt.weights(periods), periods).select("strategy", "signal_date", r6("gross_return"))


@query(
    "bt6_turnover",
    sql("traded", "SELECT strategy, signal_date, round(bought, 6) + 0e0 AS bought, round(sold, 6) + 0e0 AS sold, round(turnover, 6) + 0e0 AS turnover FROM traded"),
)
def bt6(spark, sf):
    _, periods = settled_periods(spark, sf)
    return bt.turnover(bt.weights(periods)).select("strategy", "signal_date", r6("bought"), r6("sold"), r6("turnover"))


@query(
    "bt6_drifted_turnover",
    sql(
        "weights periods",
        """
WITH w AS (SELECT w.*, COALESCE(p.period_return, 0e0) AS r FROM weights w LEFT JOIN periods p USING (signal_date, asset) WHERE strategy <> 'random'),
g AS (SELECT *, weight * (1 + r) / (1 + sum(weight * r) OVER (PARTITION BY strategy, signal_date)) AS grown FROM w),
d AS (SELECT strategy, signal_date, lead(signal_date) OVER (PARTITION BY strategy ORDER BY signal_date) AS nxt, row_number() OVER (PARTITION BY strategy ORDER BY signal_date) AS i
      FROM (SELECT DISTINCT strategy, signal_date FROM w)),
m AS (SELECT strategy, signal_date, asset, weight AS now, 0e0 AS prev FROM g
      UNION ALL SELECT g.strategy, d.nxt, asset, 0e0, grown FROM g JOIN d USING (strategy, signal_date) WHERE d.nxt IS NOT NULL),
c AS (SELECT strategy, signal_date, asset, sum(now) - sum(prev) AS change FROM m GROUP BY ALL),
t AS (SELECT strategy, signal_date, sum(abs(change)) AS moved FROM c GROUP BY ALL)
SELECT strategy, signal_date, round(CASE WHEN i = 1 THEN 1e0 ELSE moved / 2 END, 6) + 0e0 AS turnover FROM t JOIN d USING (strategy, signal_date)""",
    ),
)
def bt6_drifted(spark, sf):
    _, periods = settled_periods(spark, sf)
    weights = bt.weights(periods).where("strategy <> 'random'")
    return bt.turnover(weights, periods=periods).select("strategy", "signal_date", r6("turnover"))


def _curves(spark, sf, rates=RATES):
    """(market, periods, net curve) with the weights written once: returns and turnover read them."""
    market, periods = settled_periods(spark, sf)
    weights = materialise(bt.weights(periods), "weights")
    return market, periods, bt.net_curve(bt.portfolio_returns(weights, periods), bt.turnover(weights), rates)


@query(
    "bt7_net_curve",
    sql(
        "net",
        """SELECT strategy, signal_date, round(cost, 8) + 0e0 AS cost, round(net_return, 6) + 0e0 AS net_return, round(capital, 3) + 0e0 AS capital,
round(cumulative_return, 6) + 0e0 AS cumulative_return FROM net WHERE scenario = '0.20%'""",
    ),
)
def bt7(spark, sf):
    _, _, curve = _curves(spark, sf, {"0.20%": 0.002})
    return curve.select(
        "strategy", "signal_date", F.round("cost", 8).alias("cost"), r6("net_return"),
        F.round("capital", 3).alias("capital"), r6("cumulative_return"),
    )


def _monthly(text: str) -> str:
    """The SQL of a strategy of 7 sessions turned into that of a month: horizon, decision dates and holding."""
    horizon = CTES["pred"][1].replace("= 7", "= 21").replace("7 FOLLOWING", "21 FOLLOWING")
    decisions = "SELECT * FROM pred WHERE signal_date IN (SELECT min(signal_date) FROM pred GROUP BY date_trunc('month', signal_date))"
    held = CTES["periods"][1].replace("= 7", "= 21").replace("q.e + 7", "q.e + 21")
    return text.replace(CTES["pred"][1], horizon).replace(CTES["rebal"][1], decisions).replace(CTES["periods"][1], held)


@query(
    "bt7_monthly_net_curve",
    _monthly(
        sql(
            "net",
            """SELECT strategy, signal_date, round(turnover, 6) + 0e0 AS turnover, round(net_return, 6) + 0e0 AS net_return, round(capital, 3) + 0e0 AS capital
FROM net WHERE scenario = '0.20%' AND strategy <> 'random'""",
        )
    ),
)
def bt7_monthly(spark, sf):
    periods = materialise(roles.monthly_periods(roles.market(spark, sf)), "periods")
    weights = materialise(bt.weights(periods).where("strategy <> 'random'"), "weights")
    curve = bt.net_curve(bt.portfolio_returns(weights, periods), bt.turnover(weights), {"0.20%": 0.002})
    return curve.select("strategy", "signal_date", r6("turnover"), r6("net_return"), F.round("capital", 3).alias("capital"))


@query(
    "bt8_benchmark_curve",
    sql(
        "bcurve",
        "SELECT signal_date, round(bench_period_return, 6) + 0e0 AS bench_period_return, round(capital, 3) + 0e0 AS capital, round(cumulative_return, 6) + 0e0 AS cumulative_return FROM bcurve",
    ),
)
def bt8(spark, sf):
    market, periods = settled_periods(spark, sf)
    curve = bt.benchmark_curve(periods, market.bench)
    return curve.select("signal_date", r6("bench_period_return"), F.round("capital", 3).alias("capital"), r6("cumulative_return"))


@query(
    "bt9_buy_and_hold",
    sql(
        "periods",
        """
WITH g AS (SELECT d.signal_date, a.asset, COALESCE(p.period_return, 0e0) AS r
           FROM (SELECT DISTINCT signal_date FROM periods) d CROSS JOIN (SELECT DISTINCT asset FROM periods) a
           LEFT JOIN periods p ON p.signal_date = d.signal_date AND p.asset = a.asset),
c AS (SELECT signal_date, asset, product(1 + r) OVER (PARTITION BY asset ORDER BY signal_date) AS v FROM g)
SELECT signal_date, round(100000e0 * avg(v), 3) + 0e0 AS capital, round(avg(v) - 1, 6) + 0e0 AS cumulative_return FROM c GROUP BY 1""",
    ),
)
def bt9(spark, sf):
    _, periods = settled_periods(spark, sf)
    return bt.buy_and_hold(periods).select("signal_date", F.round("capital", 3).alias("capital"), r6("cumulative_return"))


_PERF = """
st AS (SELECT n.scenario, n.rate, n.strategy, n.signal_date, n.turnover, n.cost, n.cumulative_return + 1 AS v, b.cumulative_return + 1 AS bv,
   CASE WHEN row_number() OVER w = 1 THEN 0e0 ELSE n.net_return END AS r,
   CASE WHEN row_number() OVER w = 1 THEN 0e0 ELSE b.bench_period_return END AS b,
   (n.cumulative_return + 1) / max(n.cumulative_return + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd
 FROM net n JOIN bcurve b USING (signal_date) WINDOW w AS (PARTITION BY n.scenario, n.strategy ORDER BY n.signal_date)),
ag AS (SELECT scenario, rate, strategy, arg_max(v, signal_date) - 1 AS total_return, arg_max(bv, signal_date) AS bend,
   (max(signal_date) - min(signal_date)) / 365.25e0 AS years, stddev_pop(r) * sqrt(365.25e0 / 7) AS volatility,
   COALESCE(stddev_pop(CASE WHEN r < 0 THEN r END), 0) * sqrt(365.25e0 / 7) AS down, min(dd) AS max_drawdown,
   stddev_pop(r - b) * sqrt(365.25e0 / 7) AS tracking_error, avg(turnover) AS mean_turnover, sum(cost) AS total_cost,
   count(*) AS rebalances, avg(CASE WHEN r > b THEN 1e0 ELSE 0e0 END) AS share_above_benchmark FROM st GROUP BY ALL),
perf AS (SELECT *, power(1 + total_return, 1 / years) - 1 AS cagr, power(bend, 1 / years) - 1 AS bcagr FROM ag),
metrics AS (SELECT scenario, rate, strategy, total_return, cagr, volatility, CASE WHEN volatility <> 0 THEN cagr / volatility ELSE 0 END AS sharpe,
   CASE WHEN down <> 0 THEN cagr / down ELSE 0 END AS sortino, max_drawdown, CASE WHEN max_drawdown <> 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar,
   cagr - bcagr AS alpha, tracking_error, CASE WHEN tracking_error <> 0 THEN (cagr - bcagr) / tracking_error ELSE 0 END AS information_ratio,
   mean_turnover, total_cost, rebalances, share_above_benchmark, bend - 1 AS bench_total FROM perf)"""

_PERF_COLUMNS = [
    "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "alpha",
    "tracking_error", "information_ratio", "mean_turnover", "total_cost", "share_above_benchmark",
]


def _performance(spark, sf, rates=RATES):
    """(metrics per scenario and strategy, total return of the benchmark as a scalar)."""
    market, periods, curve = _curves(spark, sf, rates)
    bench = materialise(bt.benchmark_curve(periods, market.bench), "bench")
    total = bench.agg(F.max_by("cumulative_return", "signal_date")).scalar()
    return bt.performance(curve, bench, ["scenario", "rate", "strategy"]), total


@query(
    "bt10_performance_metrics",
    sql(
        "net bcurve",
        f"WITH {_PERF.strip()} SELECT strategy, rebalances, "
        + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in _PERF_COLUMNS)
        + " FROM metrics WHERE scenario = '0.20%'",
    ),
)
def bt10(spark, sf):
    metrics, _ = _performance(spark, sf, {"0.20%": 0.002})
    return metrics.select("strategy", "rebalances", *[r6(c) for c in _PERF_COLUMNS])


@query(
    "bt11_cost_sensitivity",
    sql(
        "net bcurve",
        f"WITH {_PERF.strip()} SELECT scenario, rate, strategy, round(total_return, 6) + 0e0 AS total_return, round(cagr, 6) + 0e0 AS cagr, round(sharpe, 6) + 0e0 AS sharpe, round(total_cost, 6) + 0e0 AS total_cost FROM metrics",
    ),
)
def bt11(spark, sf):
    metrics, _ = _performance(spark, sf)
    return metrics.select("scenario", "rate", "strategy", r6("total_return"), r6("cagr"), r6("sharpe"), r6("total_cost"))


_LEDGER = """
lw AS (SELECT * FROM wgrid WHERE strategy = 'top1'),
lc AS (SELECT signal_date, sum(greatest(weight - prev_weight, 0e0)) AS bought, sum(greatest(prev_weight - weight, 0e0)) AS sold, sum(abs(weight - prev_weight)) AS abs_change,
   max(CASE WHEN weight = 1 THEN asset END) AS new_asset, max(CASE WHEN prev_weight = 1 THEN asset END) AS old_asset FROM lw GROUP BY 1),
lr AS (SELECT lc.*, g.gross_return, abs_change * 0.001e0 AS cost, g.gross_return - abs_change * 0.001e0 AS net_return FROM lc JOIN gross g USING (signal_date) WHERE g.strategy = 'top1'),
ledger AS (SELECT *, old_asset IS DISTINCT FROM new_asset AS changed, 100000e0 * product(1 + net_return) OVER (ORDER BY signal_date) AS capital_after FROM lr)"""


def _ledger(spark, sf):
    _, periods = settled_periods(spark, sf)
    weights = materialise(bt.weights(periods), "weights")
    return bt.trade_ledger(weights, bt.portfolio_returns(weights, periods), 0.001)


@query(
    "bt12_trade_ledger",
    sql(
        "wgrid gross",
        f"""WITH {_LEDGER.strip()}
SELECT signal_date, old_asset, new_asset, changed, bought, sold, round(cost, 8) + 0e0 AS cost, round(gross_return, 6) + 0e0 AS gross_return, round(net_return, 6) + 0e0 AS net_return,
       round(COALESCE(lag(capital_after) OVER (ORDER BY signal_date), 100000e0), 3) + 0e0 AS capital_before,
       round(COALESCE(lag(capital_after) OVER (ORDER BY signal_date), 100000e0) * (1 + gross_return), 3) + 0e0 AS capital_before_cost, round(capital_after, 3) + 0e0 AS capital_after FROM ledger""",
    ),
)
def bt12(spark, sf):
    money = ["capital_before", "capital_before_cost", "capital_after"]
    return _ledger(spark, sf).select(
        "signal_date", "old_asset", "new_asset", "changed", "bought", "sold", F.round("cost", 8).alias("cost"),
        r6("gross_return"), r6("net_return"), *[F.round(c, 3).alias(c) for c in money],
    )


@query(
    "bt13_leaderboard",
    sql(
        "net bcurve",
        f"""WITH {_PERF.strip()}
SELECT row_number() OVER (ORDER BY total_return DESC, strategy) AS place, strategy, round(total_return, 6) + 0e0 AS total_return, total_return > bench_total AS above_benchmark
FROM metrics WHERE scenario = '0.20%'""",
    ),
)
def bt13(spark, sf):
    metrics, total = _performance(spark, sf, {"0.20%": 0.002})
    return bt.leaderboard(metrics, total).select("place", "strategy", r6("total_return"), "above_benchmark")


@query(
    "bt13_break_even_cost",
    sql(
        "net bcurve",
        f"""WITH {_PERF.strip()}, x AS (SELECT strategy, min(CASE WHEN total_return <= bench_total THEN rate END) AS first_failing_rate FROM metrics GROUP BY 1)
SELECT m.strategy, x.first_failing_rate, max(CASE WHEN x.first_failing_rate IS NULL OR m.rate < x.first_failing_rate THEN m.rate END) AS break_even_rate
FROM metrics m JOIN x USING (strategy) GROUP BY 1, 2""",
    ),
)
def bt13_break_even(spark, sf):
    metrics, total = _performance(spark, sf)
    return bt.break_even_rate(metrics, total)


@query(
    "bt14_cost_reconciliation",
    sql(
        "wgrid gross",
        f"""WITH {_LEDGER.strip()}
SELECT round(gross, 6) + 0e0 AS gross, round(net, 6) + 0e0 AS net_compounded, round(tc, 6) + 0e0 AS total_cost, round(gross - tc, 6) + 0e0 AS net_simple, round(net - (gross - tc), 6) + 0e0 AS difference
FROM (SELECT product(1 + gross_return) - 1 AS gross, product(1 + net_return) - 1 AS net, sum(cost) AS tc FROM ledger)""",
    ),
)
def bt14(spark, sf):
    out = bt.reconcile_costs(_ledger(spark, sf))
    return out.select(r6("gross"), r6("net_compounded"), r6("total_cost"), r6("net_simple"), r6("difference"))


_CRITERIA = {
    "net_return_above_benchmark": ("total_return", "total_return > bench_total"),
    "sharpe_positive": ("sharpe", "sharpe > 0"),
    "turnover_below_15pct": ("mean_turnover", "mean_turnover < 0.15e0"),
    "cost_below_10pct": ("total_cost", "total_cost < 0.1e0"),
    "above_benchmark_55pct": ("share_above_benchmark", "share_above_benchmark > 0.55e0"),
}


@query(
    "bt15_success_criteria",
    sql(
        "net bcurve",
        f"WITH {_PERF.strip()} "
        + " UNION ALL ".join(
            f"SELECT strategy, '{k}' AS criterion, round({v}, 6) + 0e0 AS value, {p} AS passed FROM metrics WHERE scenario = '0.20%'"
            for k, (v, p) in _CRITERIA.items()
        ),
    ),
)
def bt15(spark, sf):
    metrics, total = _performance(spark, sf, {"0.20%": 0.002})
    return bt.success_criteria(metrics, total).select("strategy", "criterion", r6("value"), "passed")
