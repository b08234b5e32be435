"""Feature and target columns of a panel.

Each function adds its columns in one pass over one window; functions that use the same
partition and order share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import rolling as R
from panelloom.functions.scalars import day_number, safe_div
from panelloom.keys import KEYS, PanelKeys, calendar_order
from panelloom.operators.joins import attach_series, trailing_months_agg


def trailing_returns(
    panel: DataFrame,
    horizons: Sequence[int] = (7, 30, 90),
    keys: PanelKeys = KEYS,
    ret: str = "total_return",
    prefix: str = "return",
    min_periods: int | None = None,
) -> DataFrame:
    """return_1d (the previous session's return) and return_{n}d over the n sessions before."""
    fr = R.Frames(keys.history(), [keys.asset])
    made = [fr.lag(F.col(ret)).alias(f"{prefix}_1d")]
    made += [R.trailing_compound(fr, F.col(ret), n, min_periods).alias(f"{prefix}_{n}d") for n in horizons]
    return fr.select(panel, *made)


def benchmark_trailing(
    series: DataFrame,
    horizons: Sequence[int] = (7, 30, 90),
    date: str = "date",
    ret: str = "bench_return",
    min_periods: int | None = None,
) -> DataFrame:
    """The same horizons on the one-row-per-date benchmark series."""
    fr = R.Frames(calendar_order(date))
    made = [fr.lag(F.col(ret)).alias("bench_return_1d")]
    made += [R.trailing_compound(fr, F.col(ret), n, min_periods).alias(f"bench_return_{n}d") for n in horizons]
    return fr.select(series, *made)


def volatility(
    panel: DataFrame,
    horizons: Sequence[int] = (30, 90),
    keys: PanelKeys = KEYS,
    ret: str = "total_return",
    min_periods: int | None = None,
) -> DataFrame:
    fr = R.Frames(keys.history(), [keys.asset])
    made = [R.trailing_volatility(fr, F.col(ret), n, min_periods).alias(f"volatility_{n}d") for n in horizons]
    return fr.select(panel, *made)


def _by_day(panel: DataFrame, keys: PanelKeys) -> tuple[DataFrame, R.Frames]:
    """The panel with a day number, and frames ordered by it: rows and calendar days alike."""
    dated = panel.withColumn("__day", day_number(F.col(keys.date)))
    return dated, R.Frames(Window.partitionBy(keys.asset).orderBy("__day"), [keys.asset])


def dividend_features(
    panel: DataFrame,
    keys: PanelKeys = KEYS,
    price: str = "close",
    value: str = "dividend_value",
    days: int = 365,
) -> DataFrame:
    """Trailing yield over calendar days, days of history, days since the last event, flag."""
    dated, fr = _by_day(panel, keys)
    date, paid = F.col(keys.date), F.col(value)
    return fr.select(
        dated,
        safe_div(R.trailing_days_sum(fr, paid, days), F.col(price)).alias("dividend_yield_12m"),
        R.history_days(fr, date).alias("dividend_history_days"),
        R.days_since_last(fr, date, paid > 0).alias("days_since_last_dividend"),
        (paid > 0).alias("has_dividend_today"),
    ).drop("__day")


def excess_returns(
    panel: DataFrame, horizons: Sequence[int] = (30, 90), prefix: str = "alpha"
) -> DataFrame:
    return panel.select(
        "*",
        *[
            (F.col(f"return_{n}d") - F.col(f"bench_return_{n}d")).alias(f"{prefix}_{n}d")
            for n in horizons
        ],
    )


def forward_targets(
    panel: DataFrame,
    benchmark: DataFrame,
    n: int = 7,
    keys: PanelKeys = KEYS,
    ret: str = "total_return",
    bench_ret: str = "bench_return",
    min_periods: int | None = None,
    keep_legs: bool = False,
) -> DataFrame:
    """target_{n}d (did the asset beat the benchmark) and target_alpha_{n}d (by how much).

    Each leg is compounded over its own next n sessions; the benchmark leg is computed on the
    one-row-per-date series and then joined. Without a whole horizon the target is NULL.
    """
    fr, bench_fr = R.Frames(keys.history(), [keys.asset]), R.Frames(calendar_order(keys.date))
    own = fr.select(panel, R.forward_compound(fr, F.col(ret), n, min_periods).alias("__own"))
    leg = R.forward_compound(bench_fr, F.col(bench_ret), n, min_periods).alias("__bench")
    side = bench_fr.select(benchmark, leg).select(keys.date, "__bench")
    both = own.join(side, keys.date, "left").select(
        "*",
        (F.col("__own") > F.col("__bench")).alias(f"target_{n}d"),
        (F.col("__own") - F.col("__bench")).alias(f"target_alpha_{n}d"),
    )
    if keep_legs:
        return both.withColumnsRenamed(
            {"__own": f"future_return_{n}d", "__bench": f"future_bench_{n}d"}
        )
    return both.drop("__own", "__bench")


def price_cash_targets(
    panel: DataFrame,
    benchmark: DataFrame,
    n: int = 21,
    keys: PanelKeys = KEYS,
    price: str = "close",
    value: str = "dividend_value",
    bench_price: str = "bench_close",
) -> DataFrame:
    """Forward return as (price after n sessions + cash paid on the way) / price - 1, versus the
    benchmark's price change over its own n sessions; NULL without a whole horizon."""
    fr, bench_fr = R.Frames(keys.history(), [keys.asset]), R.Frames(calendar_order(keys.date))
    cash = fr.sum(F.col(value), 1, n)
    # The price after n sessions is NULL when fewer than n sessions follow, and so is the target.
    own = safe_div(fr.lead(F.col(price), n) + cash, F.col(price)) - 1.0
    bench = safe_div(bench_fr.lead(F.col(bench_price), n), F.col(bench_price)) - 1.0
    side = bench_fr.select(benchmark, bench.alias(f"future_bench_{n}d")).select(keys.date, f"future_bench_{n}d")
    return (
        fr.select(panel, own.alias(f"future_return_{n}d"))
        .join(side, keys.date, "left")
        .withColumn(f"target_{n}d", F.col(f"future_return_{n}d") > F.col(f"future_bench_{n}d"))
    )


def technical_columns(
    fr: R.Frames,
    price: str = "close",
    ret: str = "price_return",
    bench_ret: str = "bench_return",
    gain: str = "__gain",
    loss: str = "__loss",
    rsi: Sequence[int] = (14,),
    averages: Sequence[int] = (7, 30),
    betas: Sequence[int] = (90,),
    outperform: Sequence[int] = (30,),
    drawdowns: Sequence[int] = (30,),
    min_obs: int = 60,
    min_periods: int | None = None,
) -> list:
    """RSI, distance to moving averages, beta, outperformance rate and drawdown over `fr`, from a
    panel that holds price, return, benchmark return, gain and loss of each session."""
    p, r, b = F.col(price), F.col(ret), F.col(bench_ret)
    made = [R.rsi_from_moves(fr, F.col(gain), F.col(loss), n, min_periods).alias(f"rsi_{n}d") for n in rsi]
    made += [R.distance_to_average(fr, p, n, min_periods).alias(f"price_vs_ma_{n}d") for n in averages]
    made += [R.rolling_beta(fr, r, b, n, min(min_obs, n)).alias(f"beta_{n}d") for n in betas]
    made += [R.outperformance_rate(fr, r, b, n, min_periods).alias(f"outperform_rate_{n}d") for n in outperform]
    made += [R.drawdown_from_peak(fr, p, n, min_periods).alias(f"drawdown_{n}d") for n in drawdowns]
    return made


def gains_and_losses(move) -> dict:
    """Gain and loss of a price move; an unknown move counts as neither."""
    return {
        "__gain": F.when(move > 0, move).otherwise(F.lit(0.0)),
        "__loss": F.when(move < 0, -move).otherwise(F.lit(0.0)),
    }


def technical_features(panel: DataFrame, keys: PanelKeys = KEYS, price: str = "close", **spans) -> DataFrame:
    """`technical_columns` on a panel of prices. It must already carry the benchmark return when
    betas or outperformance rates are asked for."""
    w = keys.history()
    staged = panel.select(
        "*", F.lag(price, 1).over(w).alias("__prev"), R.simple_return(w, F.col(price)).alias("__ret")
    ).withColumns(gains_and_losses(F.col(price) - F.col("__prev")))
    fr = R.Frames(w, [keys.asset])
    made = technical_columns(fr, price=price, ret="__ret", **spans)
    return fr.select(staged, *made).drop("__prev", "__ret", "__gain", "__loss")


def dividend_stability(
    panel: DataFrame,
    events: DataFrame,
    months: int = 12,
    min_months: int = 3,
    keys: PanelKeys = KEYS,
    event_date: str = "payment_date",
    value: str = "value",
) -> DataFrame:
    """Coefficient of variation of the monthly totals paid in the months before this one."""

    def variation(total, frame):
        ratio = F.stddev_pop(total).over(frame) / F.nullif(F.avg(total).over(frame), F.lit(0.0))
        return F.when(F.count(total).over(frame) >= min_months, ratio)

    return trailing_months_agg(
        panel, events, months, {"dividend_stability": variation}, keys, event_date, value
    )


def derived_features(
    panel: DataFrame, keys: PanelKeys = KEYS, macro: str = "macro_a", n: int = 30
) -> DataFrame:
    """Ratios and changes built on features that the panel already has.

    Volatility change and ratio, rolling Sharpe ratio, yield growth, event frequency, macro
    change and its regime flag.
    """
    dated, fr = _by_day(panel, keys)
    ret, paid = F.col("total_return"), F.col("dividend_value")
    known = fr.count(ret, -n, -1)
    sharpe = safe_div(fr.sum(ret, -n, -1) / F.nullif(known, F.lit(0)), fr.deviation(ret, -n, -1))
    yield_before = fr.lag(F.col("dividend_yield_12m"), 252)
    change = F.col(macro) - fr.lag(F.col(macro), n)
    return fr.select(
        dated,
        (F.col("volatility_30d") - F.col("volatility_90d")).alias("volatility_change"),
        safe_div(F.col("volatility_30d"), F.col("volatility_90d")).alias("volatility_ratio"),
        F.when(known >= n, sharpe).alias(f"sharpe_{n}d"),
        safe_div(R.trailing_days_sum(fr, paid, 30), F.col("close")).alias("dividend_yield_30d"),
        R.trailing_days_count(fr, F.when(paid > 0, 1), 365).alias("dividend_frequency_12m"),
        (safe_div(F.col("dividend_yield_12m"), yield_before) - 1.0).alias("dividend_growth"),
        change.alias("macro_change_30d"),
        (change > 0).alias("macro_rising"),
    ).drop("__day")


def last_event_value(
    panel: DataFrame, keys: PanelKeys = KEYS, value: str = "dividend_value", out: str = "last_dividend"
) -> DataFrame:
    """Value of the latest event up to today."""
    paid = F.when(F.col(value) > 0, F.col(value))
    return panel.withColumn(out, R.forward_fill(keys.history(), paid))


def compounded_monthly(
    series: DataFrame, value: str, out: str, months: int = 12, month: str = "month"
) -> DataFrame:
    """Monthly percentages compounded over the last `months` months, NULL before a whole year."""
    frame = calendar_order(month).rowsBetween(1 - months, 0)
    rate = F.col(value) / 100.0
    growth = F.product(rate + 1.0).over(frame) - 1.0
    return series.withColumn(out, F.when(F.count(rate).over(frame) >= months, growth))


def with_benchmark(panel: DataFrame, benchmark: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    return attach_series(panel, benchmark, {c: c for c in columns}, date)
