"""Data-quality audits. Each returns (check, key, value, passed), one row per finding.

An audit is one aggregate over its input followed by unpivot, not one job per rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.aggregates import count_where, null_count
from panelloom.operators.profiles import corr_with_target
from panelloom.operators.versions import compare_tables


def _report(check: str, counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row frame of offence counts -> report rows; a zero passes."""
    return counts.unpivot([], [f"`{n}`" for n in names], "key", "value").select(
        F.lit(check).alias("check"),
        "key",
        F.col("value").cast("double").alias("value"),
        (F.col("value") == 0).alias("passed"),
    )


def stack(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def critical_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _report("null", df.agg(*[null_count(c).alias(c) for c in columns]), columns)


def duplicate_key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys held by more than one row."""
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    name = ",".join(keys)
    return _report("duplicate_key", copies.agg(F.count_if(F.col("n") > 1).alias(name)), [name])


def row_count_preserved(before: DataFrame, after: DataFrame, key: str = "rows") -> DataFrame:
    """Rows gained (+) or lost (-) between two stages."""
    tagged = before.select(F.lit(-1).alias("n")).unionAll(after.select(F.lit(1).alias("n")))
    return _report(
        "row_count", tagged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(key)), [key]
    )


def domain(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Known values outside their [low, high] range, per column."""
    return _report(
        "domain",
        df.agg(*[count_where(~F.col(c).between(lo, hi)).alias(c) for c, (lo, hi) in rules.items()]),
        list(rules),
    )


def rules(df: DataFrame, check: str, offences: dict[str, Column]) -> DataFrame:
    """Number of rows that fulfil each offence predicate."""
    return _report(check, df.agg(*[count_where(p).alias(n) for n, p in offences.items()]), list(offences))


def unchanged(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values that differ (null-safe) between two versions on shared keys."""
    return compare_tables(a, b, keys, columns).select(
        F.lit("unchanged").alias("check"),
        F.col("column").alias("key"),
        F.col("differing").cast("double").alias("value"),
        (F.col("differing") == 0).alias("passed"),
    )


def leaking_correlation(df: DataFrame, columns: Sequence[str], target: Column, limit: float = 0.95) -> DataFrame:
    """Features correlated with the target beyond the limit."""
    return corr_with_target(df, columns, target).select(
        F.lit("leak_correlation").alias("check"),
        F.col("column").alias("key"),
        F.col("corr").alias("value"),
        (F.coalesce(F.abs("corr"), F.lit(0.0)) <= limit).alias("passed"),
    )


def suspicious_names(report: DataFrame, words: Sequence[str], allowed: Sequence[str] = ()) -> DataFrame:
    """Report rows of a per-column audit, marked by whether the column's name hints at the future.

    `report` is any report whose key is a column name, e.g. `leaking_correlation`; a hint fails
    the row unless the name is allowed.
    """
    hit = reduce(lambda x, y: x | y, [F.contains(F.lower("key"), F.lit(w)) for w in words])
    return report.select(
        F.lit("leak_name").alias("check"),
        "key",
        "value",
        (F.col("passed") & (~hit | F.col("key").isin(list(allowed)))).alias("passed"),
    )


def prediction_leakage(
    predictions: DataFrame,
    calendar: DataFrame,
    gap: int,
    signal: str = "signal_date",
    execution: str = "execution_date",
    trained_to: str = "trained_to",
) -> DataFrame:
    """Training ends before the signal, at least `gap` sessions lie between, execution is the
    next session. `calendar` is (date, session_idx, next_session)."""
    at_signal = calendar.select(
        F.col("date").alias(signal), F.col("session_idx").alias("__s"), F.col("next_session").alias("__x")
    )
    at_train = calendar.select(F.col("date").alias(trained_to), F.col("session_idx").alias("__t"))
    joined = predictions.join(at_signal, signal, "left").join(at_train, trained_to, "left")
    return rules(
        joined,
        "prediction_leak",
        {
            "trained_after_signal": ~(F.col(trained_to) < F.col(signal)),
            "gap_too_short": ~(F.col("__s") - F.col("__t") >= gap),
            "not_next_session": ~F.col(execution).eqNullSafe(F.col("__x")),
        },
    )


def adjusted_price_audit(
    prices: DataFrame, events: DataFrame, tolerance: float = 0.01, event_date: str = "ex_date"
) -> DataFrame:
    """Does close - adj_close equal the cash paid on ex-dates? One row per event on a session."""
    joined = prices.alias("p").join(
        events.alias("e"),
        (F.col("p.asset") == F.col("e.asset")) & (F.col("p.date") == F.col(f"e.{event_date}")),
        "inner",
    )
    gap = F.col("p.close") - F.col("p.adj_close")
    return joined.select(
        F.col("p.asset").alias("asset"),
        F.col("p.date").alias("ex_date"),
        F.col("p.close").alias("close"),
        F.col("p.adj_close").alias("adj_close"),
        F.col("e.value").alias("dividend_value"),
        gap.alias("gap"),
        (gap / F.nullif(F.col("p.close"), F.lit(0.0)) * 100.0).alias("gap_pct"),
        (F.col("e.value") / F.nullif(F.col("p.close"), F.lit(0.0)) * 100.0).alias("dividend_pct"),
        (gap / F.nullif(F.col("e.value"), F.lit(0.0))).alias("gap_ratio"),
        (F.abs(gap - F.col("e.value")) < tolerance).alias("matches"),
    )


def redundant_columns(df: DataFrame, constants: Sequence[str], twins: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Columns that hold at most one value, and pairs whose two members never differ.

    `passed` is True for a column that carries information. A minimum equal to the maximum
    detects a constant column without counting distinct values.
    """
    counts = df.agg(
        *[F.when(F.min(c) == F.max(c), 1).otherwise(F.when(F.count(c) == 0, 1).otherwise(0)).alias(c) for c in constants],
        *[F.when(F.count_if(~a.eqNullSafe(b)) == 0, 1).otherwise(0).alias(n) for n, (a, b) in twins.items()],
    )
    return _report("redundant", counts, [*constants, *twins])


def temporal_coverage(parts: dict[str, tuple[DataFrame, str, str | None]], required_end: str) -> DataFrame:
    """(source, asset, rows, first_date, last_date, stale_days, passed) per table and asset.

    `parts` maps a table name to (frame, date column, asset column or None).
    """
    frames = []
    for name, (df, date, asset) in parts.items():
        key = F.col(asset) if asset else F.lit("*")
        frames.append(
            df.groupBy(F.lit(name).alias("source"), key.alias("asset")).agg(
                F.count(F.lit(1)).alias("rows"),
                F.min(date).alias("first_date"),
                F.max(date).alias("last_date"),
            )
        )
    end = F.to_date(F.lit(required_end))
    return reduce(DataFrame.unionByName, frames).select(
        "*",
        F.greatest(F.datediff(end, F.col("last_date")), F.lit(0)).alias("stale_days"),
        (F.col("last_date") >= end).alias("passed"),
    )


def class_balance(df: DataFrame, label: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and share of positives, overall or per key (split, fold, asset)."""
    known = df.where(label.isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(label).alias("positives"),
        F.avg(label.cast("double")).alias("positive_share"),
    )


def prediction_contract(
    periods: DataFrame,
    assets_per_date: int,
    sessions_per_period: int,
    first_year: int,
    last_year: int,
    signal: str = "signal_date",
    asset: str = "asset",
) -> DataFrame:
    """Every date has its assets once, lies in the year range, and its period is whole."""
    cells = periods.groupBy(signal, asset).agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(~(F.col("sessions_held") == sessions_per_period)).alias("short"),
    )
    dates = cells.groupBy(signal).agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(F.col("copies") > 1).alias("repeated"),
        F.sum("short").alias("short"),
    )
    counts = dates.agg(
        F.count_if(F.col("assets") != assets_per_date).alias("dates_with_missing_assets"),
        F.sum("repeated").alias("repeated_keys"),
        F.count_if(~F.year(signal).between(first_year, last_year)).alias("dates_out_of_range"),
        F.sum("short").alias("short_periods"),
    )
    return _report(
        "prediction_contract",
        counts,
        ["dates_with_missing_assets", "repeated_keys", "dates_out_of_range", "short_periods"],
    )


def cost_reconciliation(ledger: DataFrame, rate: float, tolerance: float = 1e-9) -> DataFrame:
    """Turnover is half the absolute weight change, bought + sold is all of it, cost is the rate
    times what was traded, and an unchanged holding costs nothing."""

    def apart(a: Column, b: Column) -> Column:
        return F.abs(a - b) > tolerance

    return rules(
        ledger,
        "cost",
        {
            "turnover": apart(F.col("turnover"), F.col("abs_change") * 0.5),
            "notional": apart(F.col("bought") + F.col("sold"), F.col("abs_change")),
            "cost": apart(F.col("cost"), (F.col("bought") + F.col("sold")) * rate),
            "held_at_no_cost": (F.col("abs_change") <= tolerance) & (F.col("cost") > tolerance),
        },
    )
