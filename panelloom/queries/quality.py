"""Data-quality audit queries (survey ids DQ*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import backtest as bt
from panelloom.operators import calendar as cal
from panelloom.operators import features as feat
from panelloom.operators import joins, quality as Q, splits
from panelloom.operators import returns as ret
from panelloom.queries import roles
from panelloom.queries.joining import SCHEDULE_SQL, schedule
from panelloom.queries.registry import query, sql
from panelloom.queries.windows import _MOVES, _dd, _rsi, r6
from panelloom.sources.tables import materialise


def row(check: str, key: str, value: str, passed: str | None = None) -> str:
    """One report row of a SQL counterpart; a zero count passes."""
    passed = passed or f"({value}) = 0"
    return f"SELECT '{check}' AS \"check\", '{key}' AS key, CAST(({value}) AS DOUBLE) AS value, {passed} AS passed"


@query(
    "dq1_critical_nulls",
    sql(
        "panel divs",
        "WITH j AS (SELECT p.asset, p.date, p.close, d.value FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date) "
        + " UNION ALL ".join(row("null", c, f"SELECT count(*) FROM j WHERE {c} IS NULL") for c in ("asset", "date", "close", "value")),
    ),
)
def dq1(spark, sf):
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value")
    joined = roles.panel(spark, sf).join(paid, ["asset", "date"], "left")
    return Q.critical_nulls(joined, ["asset", "date", "close", "value"])


@query(
    "dq2_duplicate_primary_key",
    row("duplicate_key", "l_orderkey,l_linenumber", "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
    + " UNION ALL "
    + row("duplicate_key", "o_orderkey", "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)"),
)
def dq2(spark, sf):
    return Q.stack(
        [
            Q.duplicate_key_check(roles.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
            Q.duplicate_key_check(roles.table(spark, sf, "orders"), ["o_orderkey"]),
        ]
    )


@query(
    "dq3_row_count_preserved",
    sql(
        "panel divs",
        row("row_count", "left_join", "SELECT count(*) - (SELECT count(*) FROM panel) FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date")
        + " UNION ALL "
        + row("row_count", "inner_join", "SELECT count(*) - (SELECT count(*) FROM panel) FROM panel p JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date"),
    ),
)
def dq3(spark, sf):
    panel = roles.written_panel(spark, sf)
    paid = materialise(
        roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value"), "dividends"
    )
    return Q.stack(
        [
            Q.row_count_preserved(panel, panel.join(paid, ["asset", "date"], how), f"{how}_join")
            for how in ("left", "inner")
        ]
    )


@query(
    "dq4_domain_rules",
    sql(
        "panel",
        _MOVES.rstrip()
        + f""",
r AS (SELECT {_rsi(14)} AS rsi FROM g), d AS (SELECT {_dd(30)} AS dd FROM panel)
"""
        + row("domain", "rsi_14d", "SELECT count(*) FROM r WHERE rsi NOT BETWEEN 0 AND 100")
        + " UNION ALL "
        + row("domain", "drawdown_30d", "SELECT count(*) FROM d WHERE dd NOT BETWEEN 0 AND 1")
        + " UNION ALL "
        + row("domain", "close", "SELECT count(*) FROM panel WHERE close NOT BETWEEN 2000 AND 400000"),
    ),
)
def dq4(spark, sf):
    df = feat.technical_features(roles.panel(spark, sf), averages=(), betas=(), outperform=())
    return Q.domain(df, {"rsi_14d": (0, 100), "drawdown_30d": (0, 1), "close": (2000, 400000)})


@query(
    "dq5_target_unchanged",
    sql(
        "rp",
        row("unchanged", "total_return", "0")
        + " UNION ALL "
        + row("unchanged", "prob", "SELECT count(*) FROM rp WHERE prob > 0.9e0"),
    ),
)
def dq5(spark, sf):
    a = roles.market(spark, sf).returns
    b = a.withColumn("prob", F.when(F.col("prob") <= 0.9, F.col("prob")))
    return Q.unchanged(a, b, ["asset", "date"], ["total_return", "prob"])


@query(
    "dq6_leaking_correlation",
    sql(
        "pred",
        "WITH x AS (SELECT prob, alpha, alpha * 2 + 1 AS twice, CAST(target AS INTEGER) AS y FROM pred) "
        + " UNION ALL ".join(
            f"SELECT 'leak_correlation' AS \"check\", '{c}' AS key, round(corr({c}, alpha), 6) + 0e0 AS value, abs(corr({c}, alpha)) <= 0.95e0 AS passed FROM x"
            for c in ("prob", "twice", "y")
        ),
    ),
)
def dq6(spark, sf):
    df = roles.predictions(roles.market(spark, sf)).select(
        "prob", "alpha", (F.col("alpha") * 2 + 1).alias("twice"), F.col("target").cast("int").alias("y")
    )
    report = Q.leaking_correlation(df, ["prob", "twice", "y"], F.col("alpha"))
    return report.select("check", "key", r6("value"), "passed")


@query(
    "dq6_prediction_leakage",
    sql(
        "pred rp_cal",
        f"""
WITH s AS (SELECT * FROM {SCHEDULE_SQL}),
sp AS (SELECT s.*, (SELECT max(session_idx) FROM rp_cal c WHERE c.date <= s.train_end) - 7 AS ti FROM s),
p AS (SELECT pred.signal_date, pred.execution_date, arg_min(sp.ti, sp.valid_until) AS ti FROM pred JOIN sp ON pred.signal_date <= sp.valid_until
      GROUP BY pred.signal_date, pred.execution_date, pred.asset),
x AS (SELECT p.*, a.session_idx AS si, a.next_session AS ns, t.date AS td FROM p JOIN rp_cal a ON a.date = p.signal_date JOIN rp_cal t ON t.session_idx = p.ti)
"""
        + row("prediction_leak", "trained_after_signal", "SELECT count(*) FROM x WHERE NOT td < signal_date")
        + " UNION ALL "
        + row("prediction_leak", "gap_too_short", "SELECT count(*) FROM x WHERE NOT si - ti >= 7")
        + " UNION ALL "
        + row("prediction_leak", "not_next_session", "SELECT count(*) FROM x WHERE execution_date IS DISTINCT FROM ns"),
    ),
)
def dq6_predictions(spark, sf):
    m = roles.market(spark, sf)
    preds = materialise(roles.predictions(m), "predictions")
    calendar = cal.sessions(m.returns)
    plan = splits.retrain_plan(preds, calendar, schedule(spark, sf), 7)
    traced = preds.join(plan.select("signal_date", F.col("purged_end").alias("trained_to")), "signal_date")
    return Q.prediction_leakage(traced, calendar, 7)


@query(
    "dq6_suspicious_names",
    sql(
        "pred",
        "WITH x AS (SELECT prob, prob * 2 AS next_prob, alpha, CAST(target AS INTEGER) AS target FROM pred) "
        + " UNION ALL ".join(
            f"SELECT 'leak_name' AS \"check\", '{c}' AS key, round(corr({c}, alpha), 6) + 0e0 AS value, {p} AS passed FROM x"
            for c, p in (("prob", "true"), ("next_prob", "false"), ("target", "true"))
        ),
    ),
)
def dq6_names(spark, sf):
    df = roles.predictions(roles.market(spark, sf)).select(
        "prob", (F.col("prob") * 2).alias("next_prob"), "alpha", F.col("target").cast("int").alias("target")
    )
    audit = Q.leaking_correlation(df, ["prob", "next_prob", "target"], F.col("alpha"))
    report = Q.suspicious_names(audit, ["target", "future", "next"], allowed=["target"])
    return report.select("check", "key", r6("value"), "passed")


@query(
    "dq7_adjusted_price_audit",
    sql(
        "panel divs",
        """
SELECT p.asset, p.date AS ex_date, p.close, p.adj_close, d.value AS dividend_value, p.close - p.adj_close AS gap,
       round((p.close - p.adj_close) / p.close * 100, 6) + 0e0 AS gap_pct, round(d.value / p.close * 100, 6) + 0e0 AS dividend_pct,
       round((p.close - p.adj_close) / nullif(d.value, 0), 6) + 0e0 AS gap_ratio, abs(p.close - p.adj_close - d.value) < 0.01e0 AS matches
FROM panel p JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date""",
    ),
)
def dq7(spark, sf):
    df = Q.adjusted_price_audit(roles.panel(spark, sf), roles.dividends(spark, sf))
    return df.select(
        "asset", "ex_date", "close", "adj_close", "dividend_value", "gap",
        r6("gap_pct"), r6("dividend_pct"), r6("gap_ratio"), "matches",
    )


@query(
    "dq7_adjusted_price_summary",
    sql(
        "panel divs",
        """
SELECT count(*) AS events, count(*) FILTER (abs(p.close - p.adj_close - d.value) < 0.01e0) AS matching,
       round(count(*) FILTER (abs(p.close - p.adj_close - d.value) < 0.01e0) * 100e0 / count(*), 6) + 0e0 AS matching_pct
FROM panel p JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date""",
    ),
)
def dq7_summary(spark, sf):
    df = Q.adjusted_price_audit(roles.panel(spark, sf), roles.dividends(spark, sf))
    hits = F.count_if("matches")
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("events"), hits.alias("matching"), F.round(hits * 100.0 / rows, 6).alias("matching_pct"))


@query(
    "dq8_redundant_columns",
    row("redundant", "y", "1")
    + " UNION ALL "
    + row("redundant", "l_linestatus", "SELECT CAST(min(l_linestatus) = max(l_linestatus) AS INTEGER) FROM lineitem")
    + " UNION ALL "
    + row("redundant", "discount_text", "1")
    + " UNION ALL "
    + row("redundant", "tax_vs_discount", "SELECT CAST(count(*) = 0 AS INTEGER) FROM lineitem WHERE l_tax IS DISTINCT FROM l_discount"),
)
def dq8(spark, sf):
    df = roles.table(spark, sf, "lineitem").select(
        F.lit(0).alias("y"), "l_linestatus", "l_discount", "l_tax", F.format_number("l_discount", 2).alias("discount_text")
    )
    return Q.redundant_columns(
        df,
        ["y", "l_linestatus"],
        {
            "discount_text": (F.col("discount_text").try_cast("double"), F.col("l_discount")),
            "tax_vs_discount": (F.col("l_tax"), F.col("l_discount")),
        },
    )


def _cover(source: str, asset: str, date: str, table: str) -> str:
    return (
        f"SELECT '{source}' AS source, {asset} AS asset, count(*) AS rows, min({date}) AS first_date, max({date}) AS last_date FROM {table} GROUP BY 1, 2"
    )


@query(
    "dq9_temporal_coverage",
    sql(
        "panel divs macro_daily",
        "SELECT *, CAST(greatest(DATE '2001-08-01' - last_date, 0) AS INTEGER) AS stale_days, last_date >= DATE '2001-08-01' AS passed FROM ("
        + " UNION ALL ".join(
            [_cover("prices", "asset", "date", "panel"), _cover("dividends", "asset", "ex_date", "divs"), _cover("macro", "'*'", "date", "macro_daily")]
        )
        + ")",
    ),
)
def dq9(spark, sf):
    return Q.temporal_coverage(
        {
            "prices": (roles.panel(spark, sf), "date", "asset"),
            "dividends": (roles.dividends(spark, sf), "ex_date", "asset"),
            "macro": (roles.macro_daily(spark, sf), "date", None),
        },
        "2001-08-01",
    )


@query(
    "dq10_class_balance",
    sql(
        "pred",
        """
SELECT split, count(*) AS rows, count(*) FILTER (target) AS positives, round(avg(CAST(target AS INTEGER)), 6) + 0e0 AS positive_share
FROM (SELECT target, CASE WHEN signal_date <= DATE '1998-12-31' THEN 'train' WHEN signal_date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split FROM pred)
GROUP BY 1""",
    ),
)
def dq10(spark, sf):
    preds = roles.predictions(roles.market(spark, sf))
    df = splits.temporal_split(preds, "signal_date", "1998-12-31", "1999-12-31")
    return Q.class_balance(df, F.col("target"), ["split"]).select("split", "rows", "positives", r6("positive_share"))


@query(
    "dq11_prediction_contract",
    sql(
        "periods",
        "WITH d AS (SELECT signal_date, count(*) AS n, count(*) FILTER (sessions_held <> 7) AS short FROM periods GROUP BY 1) "
        + row("prediction_contract", "dates_with_missing_assets", "SELECT count(*) FROM d WHERE n <> 5")
        + " UNION ALL "
        + row("prediction_contract", "repeated_keys", "SELECT count(*) FROM (SELECT 1 FROM periods GROUP BY signal_date, asset HAVING count(*) > 1)")
        + " UNION ALL "
        + row("prediction_contract", "dates_out_of_range", "SELECT count(*) FROM d WHERE year(signal_date) NOT BETWEEN 1995 AND 2000")
        + " UNION ALL "
        + row("prediction_contract", "short_periods", "SELECT sum(short) FROM d"),
    ),
)
def dq11(spark, sf):
    return Q.prediction_contract(roles.periods(roles.market(spark, sf)), 5, 7, 1995, 2000)


@query(
    "dq12_cost_reconciliation",
    sql("", " UNION ALL ".join(row("cost", k, "0") for k in ("turnover", "notional", "cost", "held_at_no_cost"))),
)
def dq12(spark, sf):
    periods = materialise(roles.periods(roles.market(spark, sf)), "periods")
    weights = bt.weights(periods)
    ledger = bt.trade_ledger(weights, bt.portfolio_returns(weights, periods), 0.001)
    return Q.cost_reconciliation(ledger, 0.001)
