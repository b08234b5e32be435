"""Session calendars: the sorted distinct dates of a panel, one row per session.

A calendar is bounded by calendar time (at most 366 rows a year), whatever the panel holds:
the distinct is combined map-side and only dates are shuffled, so the global order below runs
over a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.scalars import month_start
from panelloom.keys import calendar_order


def sessions(panel: DataFrame, date: str = "date") -> DataFrame:
    """(date, session_idx, next_session); session_idx counts from 1."""
    dates = panel.select(date).where(F.col(date).isNotNull()).distinct()
    order = calendar_order(date)
    return dates.select(
        date,
        F.row_number().over(order).cast("long").alias("session_idx"),
        F.lead(date, 1).over(order).alias("next_session"),
    )


def next_session(panel: DataFrame, date: str = "date", out: str = "execution_date") -> DataFrame:
    """Adds the first session after each row's date (NULL on the last one)."""
    cal = sessions(panel, date).select(date, F.col("next_session").alias(out))
    return panel.join(cal, date, "left")


def every_nth_session(calendar: DataFrame, n: int, idx: str = "session_idx") -> DataFrame:
    """Sessions 1, n+1, 2n+1, ...: decision dates whose n-session horizons do not overlap."""
    return calendar.where((F.col(idx) - 1) % n == 0)


def first_session_of_month(calendar: DataFrame, date: str = "date") -> DataFrame:
    """(month, decision_date)."""
    return calendar.groupBy(month_start(F.col(date)).alias("month")).agg(
        F.min(date).alias("decision_date")
    )
