"""The feature and target tables, each declared as one plan.

Everything that depends on the date alone (benchmark horizons, benchmark target leg, macro
series under their release rules) is computed on calendar-sized series and joined to the finished
windows; only the benchmark return joins before them where a window reads it. All panel windows then share one partition and order, so the panel is shuffled by asset
once and sorted once, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import rolling as R
from panelloom.functions.scalars import day_number, safe_div
from panelloom.keys import calendar_order
from panelloom.operators import features as feat
from panelloom.operators import joins
from panelloom.operators.returns import benchmark_returns, total_returns


@dataclass(frozen=True)
class Macro:
    """Per-date series filled forward, and monthly series with their release rule."""

    daily: DataFrame | None = None  # date + columns
    daily_columns: Sequence[str] = ()
    monthly: DataFrame | None = None  # month + columns
    monthly_rules: dict[str, str] = field(default_factory=dict)  # column -> rule


IDENTITY = ["asset", "date", "close", "volume", "has_trading"]
OWN_RETURNS = ["return_1d", "return_7d", "return_30d", "return_90d"]
BENCH_RETURNS = ["bench_return_1d", "bench_return_7d", "bench_return_30d", "bench_return_90d"]
VOLATILITY = ["volatility_30d", "volatility_90d"]
DIVIDENDS = ["dividend_yield_12m", "dividend_history_days", "days_since_last_dividend"]
ALPHA = ["alpha_30d", "alpha_90d"]
TARGETS = ["target_7d", "target_alpha_7d"]
TECHNICAL = [
    "rsi_14d", "price_vs_ma_7d", "price_vs_ma_30d", "beta_90d", "outperform_rate_30d",
    "drawdown_30d", "dividend_stability",
]


def date_facts(panel: DataFrame, benchmark: DataFrame, macro: Macro, min_periods: int | None = None) -> DataFrame:
    """One row per session of the panel with everything known by date alone."""
    series = benchmark_returns(benchmark)
    series = feat.benchmark_trailing(series, (7, 30, 90), min_periods=min_periods)
    fr = R.Frames(calendar_order())
    ahead = R.forward_compound(fr, F.col("bench_return"), 7, min_periods)
    series = fr.select(series, ahead.alias("__bench_ahead"))
    facts = panel.select("date").distinct().join(series.drop("bench_close"), "date", "left")
    if macro.daily_columns:
        facts = joins.asof_join(facts, macro.daily, "date", columns=macro.daily_columns, per_column=True)
    if macro.monthly_rules:
        facts = joins.lagged_month_join(facts, macro.monthly, macro.monthly_rules)
    return facts


def feature_table(
    prices: DataFrame,
    events: DataFrame,
    benchmark: DataFrame,
    macro: Macro = Macro(),
    version: str = "v1",
    complete_only: bool = True,
    min_periods: int | None = None,
    on_missing_session: str = "drop",
    facts: DataFrame | None = None,
) -> DataFrame:
    """Feature table `v1`, `v2` (v1 without the dividend flag, plus seven technical features) or
    `v2_minimal` (v1 plus the distance to the 7-session average).

    `prices` has asset, date, close, volume; `events` asset, ex_date, payment_date, value;
    `benchmark` date, close. `complete_only` keeps rows with whole look-back, a target, a
    benchmark return and all monthly series. `facts` may be the written result of `date_facts`: with
    its measured size the planner broadcasts it, or keeps a sort-merge join if it outgrows its threshold,
    and the panel is not shuffled by date.
    """
    if version not in ("v1", "v2", "v2_minimal"):
        raise ValueError("version is 'v1', 'v2' or 'v2_minimal'")
    facts = date_facts(prices, benchmark, macro, min_periods) if facts is None else facts
    # Of the facts only the technical windows read one; the others join the finished windows, so no
    # shuffle, sort or window carries them.
    carried = ["bench_return"] if version == "v2" else []
    dated = prices.select("asset", "date", "close", "volume").withColumn("__day", day_number(F.col("date")))
    if carried:
        dated = dated.join(facts.select("date", *carried), "date", "left")
    if version == "v2":
        dated = feat.dividend_stability(dated, events)
        carried.append("dividend_stability")
    # One order for row frames and for calendar-day frames alike.
    w = Window.partitionBy("asset").orderBy("__day")
    base = total_returns(
        dated, events, on_missing_session=on_missing_session, keep=["__day", *carried], order=w
    )
    base = base.withColumns(feat.gains_and_losses(F.col("close") - F.col("close_prev")))

    fr = R.Frames(w, ["asset"])
    date, ret, paid = F.col("date"), F.col("total_return"), F.col("dividend_value")
    made = [fr.lag(ret).alias("return_1d")]
    made += [R.trailing_compound(fr, ret, n, min_periods).alias(f"return_{n}d") for n in (7, 30, 90)]
    made += [R.trailing_volatility(fr, ret, n, min_periods).alias(f"volatility_{n}d") for n in (30, 90)]
    made += [
        safe_div(R.trailing_days_sum(fr, paid, 365), F.col("close")).alias("dividend_yield_12m"),
        R.history_days(fr, date).alias("dividend_history_days"),
        R.days_since_last(fr, date, paid > 0).alias("days_since_last_dividend"),
        R.forward_compound(fr, ret, 7, min_periods).alias("__ahead"),
    ]
    if version == "v2":
        made += feat.technical_columns(fr, min_periods=min_periods)
    elif version == "v2_minimal":
        made.append(R.distance_to_average(fr, F.col("close"), 7, min_periods).alias("price_vs_ma_7d"))
    full = fr.select(base, *made).join(facts.drop(*carried), "date", "left").withColumns(
        {
            "alpha_30d": F.col("return_30d") - F.col("bench_return_30d"),
            "alpha_90d": F.col("return_90d") - F.col("bench_return_90d"),
            "has_dividend_today": paid > 0,
            "target_7d": F.col("__ahead") > F.col("__bench_ahead"),
            "target_alpha_7d": F.col("__ahead") - F.col("__bench_ahead"),
        }
    )
    if complete_only:
        needed = ["return_90d", "target_7d", "bench_return", *macro.monthly_rules]
        for column in needed:
            full = full.where(F.col(column).isNotNull())
    flags = [] if version == "v2" else ["has_dividend_today"]
    extra = {"v1": [], "v2_minimal": ["price_vs_ma_7d"], "v2": TECHNICAL}[version]
    return full.select(
        *IDENTITY, *OWN_RETURNS, *BENCH_RETURNS, *VOLATILITY, *DIVIDENDS, *flags, *ALPHA,
        *macro.daily_columns, *macro.monthly_rules, *TARGETS, *extra,
    )
