"""Joins of a panel with series, events, schedules and other versions of itself.

No join here carries a broadcast hint: adaptive execution measures each side and broadcasts it
under `spark.sql.autoBroadcastJoinThreshold`, and beyond that keeps the sort-merge join with
skew splitting. All of them are equi-joins or windows, never nested loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import rolling as R
from panelloom.functions.scalars import month_index, safe_div
from panelloom.keys import KEYS, PanelKeys, calendar_order


def attach_series(
    panel: DataFrame, series: DataFrame, columns: dict[str, str], date: str = "date"
) -> DataFrame:
    """Left join of a per-date series; `columns` maps series names to names on the panel."""
    side = series.select(date, *[F.col(src).alias(dst) for src, dst in columns.items()])
    return panel.join(side, date, "left")


def lagged_month_join(
    panel: DataFrame,
    series: DataFrame,
    rules: dict[str, str],
    date: str = "date",
    month: str = "month",
    release_day: int = 15,
) -> DataFrame:
    """Joins monthly series under their publication lag; `rules` maps a column to its rule.

    `mid_month`: the previous month from `release_day` on, else the one before it.
    `always_two`: always two months back.

    The values one and two months back are read off the series by a RANGE frame over the month
    number, for every month the panel touches; the panel is then joined once, on its own month,
    whatever the number of series and rules.
    """
    if not set(rules.values()) <= {"mid_month", "always_two"}:
        raise ValueError("a rule is 'mid_month' or 'always_two'")
    wanted = panel.select(month_index(F.col(date)).alias("__m")).distinct()
    known = series.select(month_index(F.col(month)).alias("__m"), *rules)
    spine = (
        wanted.withColumn("__wanted", F.lit(True))
        .unionByName(known, allowMissingColumns=True)
        .groupBy("__m")
        .agg(F.max("__wanted").alias("__wanted"), *[F.max(c).alias(c) for c in rules])
    )
    w = Window.orderBy("__m")

    def back(column: str, months: int) -> Column:
        return F.max(column).over(w.rangeBetween(-months, -months))

    lagged = spine.select(
        "__m",
        "__wanted",
        *[back(c, n).alias(f"__{c}_{n}") for c in rules for n in (1, 2)],
    ).where("__wanted").drop("__wanted")
    released = F.dayofmonth(date) >= release_day
    picked = {
        c: F.when(released, F.col(f"__{c}_1")).otherwise(F.col(f"__{c}_2"))
        if rule == "mid_month"
        else F.col(f"__{c}_2")
        for c, rule in rules.items()
    }
    return (
        panel.withColumn("__m", month_index(F.col(date)))
        .join(lagged, "__m", "left")
        .select(*panel.columns, *[value.alias(c) for c, value in picked.items()])
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    columns: Sequence[str] = (),
    direction: str = "backward",
    per_column: bool = False,
) -> DataFrame:
    """Last known right row on or before (`backward`) or on or after (`forward`) each date.

    `per_column` takes the last known value of every column by itself instead of the last row.

    The two sides are unioned and filled along one window, so nothing is matched pairwise. Both
    are first reduced to one row per (by, date): several right rows of one date count as the
    largest of them, and a key that holds very many rows is cut down map-side to at most one
    probe and one value per date. The result is joined back on (by, date).
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    by = list(by)
    probe = left.select(*by, on).distinct()
    if per_column:
        held = {c: F.max(c) for c in columns}
    else:
        held = {"__value": F.max(F.struct(*columns))}
    side = right.groupBy(*by, on).agg(*[value.alias(c) for c, value in held.items()])
    merged = probe.select(*by, on, F.lit(True).alias("__probe")).unionByName(
        side.withColumn("__probe", F.lit(False)), allowMissingColumns=True
    )
    # A forward fill walks the dates downwards, so that both directions use a growing frame (one
    # step per row) and never a shrinking one; on one date the values come before the probe.
    walk = F.col(on) if direction == "backward" else F.col(on).desc()
    w = Window.partitionBy(*by).orderBy(walk, "__probe") if by else Window.orderBy(walk, "__probe")
    filled = merged.select(
        *by, on, "__probe", *[R.forward_fill(w, F.col(c)).alias(c) for c in held]
    ).where("__probe")
    names = list(columns) if per_column else [F.col(f"__value.{c}").alias(c) for c in columns]
    return left.join(filled.select(*by, on, *names), [*by, on], "left")


def trailing_months_agg(
    panel: DataFrame,
    events: DataFrame,
    n: int,
    aggs: dict[str, callable],
    keys: PanelKeys = KEYS,
    event_date: str = "payment_date",
    value: str = "value",
) -> DataFrame:
    """Aggregates of the monthly event totals in the n calendar months before each date's month.

    Only distinct (asset, month) rows enter the window; each entry of `aggs` maps the monthly
    total and its frame to a Column.
    """
    monthly = events.groupBy(
        keys.asset, month_index(F.col(event_date)).alias("__month")
    ).agg(F.sum(value).alias("__total"))
    wanted = panel.select(keys.asset, month_index(F.col(keys.date)).alias("__month")).distinct()
    spine = (
        wanted.withColumn("__wanted", F.lit(True))
        .unionByName(monthly, allowMissingColumns=True)
        .groupBy(keys.asset, "__month")
        .agg(F.max("__wanted").alias("__wanted"), F.max("__total").alias("__total"))
    )
    frame = Window.partitionBy(keys.asset).orderBy("__month").rangeBetween(-n, -1)
    ready = spine.select(
        keys.asset,
        "__month",
        "__wanted",
        *[make(F.col("__total"), frame).alias(name) for name, make in aggs.items()],
    ).where("__wanted").drop("__wanted")
    return (
        panel.withColumn("__month", month_index(F.col(keys.date)))
        .join(ready, [keys.asset, "__month"], "left")
        .drop("__month")
    )


def holding_returns(
    executions: DataFrame,
    returns: DataFrame,
    n: int,
    keys: PanelKeys = KEYS,
    execution: str = "execution_date",
    ret: str = "total_return",
) -> DataFrame:
    """Return of the n sessions of each asset strictly after its execution date.

    Adds period_return (NULL under n sessions), sessions_held, start_date and end_date.
    Return rows are numbered per asset and an execution takes the number of the last row on or
    before it, so the n rows after it are a RANGE frame over that number: one shuffle, no join
    on dates, and executions that fall on no session of the asset work too.
    """
    marks = executions.select(keys.asset, F.col(execution).alias(keys.date)).distinct()
    rows = returns.select(
        *keys.pair, F.col(ret).cast("double").alias("__ret"), F.lit(1).alias("__is_row")
    ).unionByName(
        marks.select(
            *keys.pair, F.lit(None).cast("double").alias("__ret"), F.lit(0).alias("__is_row")
        )
    )
    by_date = Window.partitionBy(keys.asset).orderBy(keys.date, F.col("__is_row").desc())
    numbered = rows.withColumn(
        "__pos",
        F.sum("__is_row").over(by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    later = Window.partitionBy(keys.asset).orderBy("__pos").rangeBetween(1, n)
    row_date = F.when(F.col("__is_row") == 1, F.col(keys.date))
    held = F.count(row_date).over(later)
    known = F.coalesce(F.product(F.col("__ret") + 1.0).over(later), F.lit(1.0))
    periods = numbered.select(
        keys.asset,
        F.col(keys.date).alias(execution),
        "__is_row",
        F.when(held == n, known - 1.0).alias("period_return"),
        held.alias("sessions_held"),
        F.min(row_date).over(later).alias("start_date"),
        F.max(row_date).over(later).alias("end_date"),
    ).where("__is_row = 0").drop("__is_row")
    return executions.join(periods, [keys.asset, execution], "left")


def range_compound(
    periods: DataFrame,
    series: DataFrame,
    ret: str,
    out: str = "bench_period_return",
    start: str = "start_date",
    end: str = "end_date",
    date: str = "date",
) -> DataFrame:
    """Compounds a per-date return series over each period's [start, end], both ends included.

    Growth up to the end divided by growth before the start: two equi-joins with a
    calendar-sized table instead of a range join. A period with an open end stays NULL.
    """
    marks = (
        periods.select(F.col(start).alias(date))
        .union(periods.select(F.col(end).alias(date)))
        .where(F.col(date).isNotNull())
        .distinct()
    )
    line = series.select(date, F.col(ret).alias("__ret"))
    spine = marks.join(line, date, "full_outer")
    w = calendar_order(date)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    curve = spine.select(
        date,
        F.coalesce(R.running_compound(w, F.col("__ret")), F.lit(1.0)).alias("__to_end"),
        F.coalesce(F.product(F.col("__ret") + 1.0).over(earlier), F.lit(1.0)).alias("__before_start"),
    )
    opened = curve.select(F.col(date).alias(start), "__before_start")
    closed = curve.select(F.col(date).alias(end), "__to_end")
    return (
        periods.join(opened, start, "left")
        .join(closed, end, "left")
        .withColumn(out, safe_div(F.col("__to_end"), F.col("__before_start")) - 1.0)
        .drop("__to_end", "__before_start")
    )


def schedule_lookup(
    dates: DataFrame, schedule: DataFrame, date: str = "date", valid_until: str = "valid_until"
) -> DataFrame:
    """First schedule row still valid on each date; dates after the last one get NULLs.

    `schedule` has one row per `valid_until`.
    """
    columns = [c for c in schedule.columns if c != valid_until] + [valid_until]
    side = schedule.withColumn(date, F.col(valid_until))
    return asof_join(dates, side, on=date, columns=columns, direction="forward")


def coverage(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: distinct keys in a, in b, in both, only in a, only in b."""
    key = list(key)
    sides = a.select(*key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(*key, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    seen = sides.groupBy(*key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    return seen.agg(
        F.count_if(F.col("__a") == 1).alias("in_a"),
        F.count_if(F.col("__b") == 1).alias("in_b"),
        F.count_if((F.col("__a") == 1) & (F.col("__b") == 1)).alias("in_both"),
        F.count_if((F.col("__a") == 1) & (F.col("__b") == 0)).alias("only_a"),
        F.count_if((F.col("__a") == 0) & (F.col("__b") == 1)).alias("only_b"),
    )


def missing_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    key = list(key)
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti")
