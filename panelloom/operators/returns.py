"""Price, dividend and total returns of a panel, and the benchmark's own returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelloom.functions import rolling as R
from panelloom.functions.scalars import flag
from panelloom.keys import KEYS, PanelKeys, calendar_order


def events_on_sessions(
    events: DataFrame,
    panel: DataFrame,
    keys: PanelKeys = KEYS,
    event_date: str = "ex_date",
    value: str = "value",
    on_missing_session: str = "drop",
) -> DataFrame:
    """Event values summed per (asset, session date).

    An event dated on no session is dropped by the later equi-join (`drop`) or moved to the
    next session of its asset (`next`). An event after the last session has no session to go to.
    """
    daily = events.groupBy(keys.asset, F.col(event_date).alias(keys.date)).agg(
        F.sum(value).alias("dividend_value")
    )
    if on_missing_session == "drop":
        return daily
    if on_missing_session != "next":
        raise ValueError("on_missing_session is 'drop' or 'next'")
    # Sessions and event days on one line, walked downwards; on a shared day the session is first.
    # Both sides hold at most one row per asset and day, and each is read once.
    line = (
        panel.select(*keys.pair, F.col(keys.date).alias("__session"))
        .unionByName(daily, allowMissingColumns=True)
    )
    w = Window.partitionBy(keys.asset).orderBy(F.col(keys.date).desc(), F.col("__session").isNull())
    moved = line.withColumn("__session", R.forward_fill(w, F.col("__session"))).where(
        F.col("dividend_value").isNotNull() & F.col("__session").isNotNull()
    )
    return moved.groupBy(keys.asset, F.col("__session").alias(keys.date)).agg(
        F.sum("dividend_value").alias("dividend_value")
    )


def total_returns(
    prices: DataFrame,
    events: DataFrame,
    keys: PanelKeys = KEYS,
    on_missing_session: str = "drop",
    keep: Sequence[str] = (),
    order: WindowSpec | None = None,
) -> DataFrame:
    """Prices (asset, date, close, volume) and events -> the total-return table.

    `keep` names further price columns to carry along; `order` replaces the (asset, date) window
    by one over kept columns, so that later windows can share its sort.
    """
    paid = events_on_sessions(events, prices, keys, on_missing_session=on_missing_session)
    joined = prices.select(*keys.pair, "close", "volume", *keep).join(paid, keys.pair, "left")
    previous = F.lag("close", 1).over(order if order is not None else keys.history())
    based = joined.select(
        *keys.pair,
        "close",
        previous.alias("close_prev"),
        "volume",
        flag(F.col("volume") > 0).alias("has_trading"),
        F.coalesce(F.col("dividend_value"), F.lit(0.0)).alias("dividend_value"),
        *keep,
    )
    base = F.nullif(F.col("close_prev"), F.lit(0.0))
    price_part = (F.col("close") - F.col("close_prev")) / base
    cash_part = F.col("dividend_value") / base
    return based.select(
        "*",
        price_part.alias("price_return"),
        cash_part.alias("dividend_return"),
        (price_part + cash_part).alias("total_return"),
    )


def benchmark_returns(
    series: DataFrame, date: str = "date", price: str = "close", out: str = "bench_return"
) -> DataFrame:
    """Daily return of a one-row-per-date series, computed before any panel join."""
    return series.select(
        date,
        F.col(price).alias("bench_close"),
        R.simple_return(calendar_order(date), F.col(price)).alias(out),
    )
