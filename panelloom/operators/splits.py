"""Leakage-safe splits. Memberships are row expressions or calendar joins; no panel is sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import month_index
from panelloom.operators.calendar import sessions
from panelloom.operators.joins import asof_join


def temporal_split(df: DataFrame, date: str, train_end: str, val_end: str, test_end: str | None = None) -> DataFrame:
    """`split` = train up to train_end, val up to val_end, test after; rows past test_end drop."""
    d = F.col(date)
    label = (
        F.when(d <= F.to_date(F.lit(train_end)), "train")
        .when(d <= F.to_date(F.lit(val_end)), "val")
        .otherwise("test")
    )
    kept = df.where(d.isNotNull())
    if test_end is not None:
        kept = kept.where(d <= F.to_date(F.lit(test_end)))
    return kept.withColumn("split", label)


def split_overlap(df: DataFrame, date: str, split: str = "split") -> DataFrame:
    """Per split: rows, first and last date, and whether any of its dates is in another split."""
    per_date = df.groupBy(date).agg(F.count_distinct(split).alias("__splits"))
    return (
        df.join(per_date, date)
        .groupBy(split)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(date).alias("first_date"),
            F.max(date).alias("last_date"),
            F.count_if(F.col("__splits") > 1).alias("shared_rows"),
        )
    )


def _fold_literal(folds: Sequence[dict]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(f["fold"]).alias("fold"),
                F.to_date(F.lit(f["train_end"])).alias("train_end"),
                F.to_date(F.lit(f["eval_start"])).alias("eval_start"),
                F.to_date(F.lit(f["eval_end"])).alias("eval_end"),
            )
            for f in folds
        ]
    )


def yearly_folds(dates: DataFrame, date: str = "date", train_years: int = 3) -> list[dict]:
    """One evaluation fold per calendar year of the dates, to the last one, after `train_years` years of training.

    The first and the last date come to the driver; no dates give no folds.
    """
    first, last = dates.agg(F.year(F.min(date)), F.year(F.max(date))).first()
    years = range(first + train_years, last + 1) if first is not None else ()
    return [{"fold": str(y), "train_end": f"{y - 1}-12-31", "eval_start": f"{y}-01-01", "eval_end": f"{y}-12-31"} for y in years]


def expanding_folds(df: DataFrame, date: str, folds: Sequence[dict]) -> DataFrame:
    """One row per (row, fold) that uses it, with `role` train or eval.

    The fold table is a literal, so membership is decided map-side: no join and no shuffle.
    """
    d = F.col(date)
    member = F.filter(
        _fold_literal(folds),
        lambda f: (d <= f["train_end"]) | d.between(f["eval_start"], f["eval_end"]),
    )
    return df.withColumn("__fold", F.explode(member)).select(
        *df.columns,
        F.col("__fold.fold").alias("fold"),
        F.when(d <= F.col("__fold.train_end"), "train").otherwise("eval").alias("role"),
    )


def eval_gap(df: DataFrame, n: int, date: str = "date", keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Drops eval rows in the first n sessions of their evaluation period.

    Sessions are ranked on the distinct (fold, date) pairs, which the calendar bounds.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    early = (
        df.where(F.col("role") == "eval")
        .select(*keys, date)
        .distinct()
        .withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= n)
        .select(*keys, date, F.lit("eval").alias("role"))
    )
    return df.join(early, [*keys, date, "role"], "left_anti")


def purge_date(calendar: DataFrame, boundaries: DataFrame, n: int, boundary: str = "train_end") -> DataFrame:
    """Adds `purged_end`: the (n+1)-th session counted back from the last one on or before the
    boundary, so that an n-session target of the last training row ends inside the training."""
    known = asof_join(
        boundaries.withColumn("date", F.col(boundary)), calendar.select("date", "session_idx"),
        on="date", columns=["session_idx"], direction="backward",
    ).drop("date")
    back = calendar.select(F.col("date").alias("purged_end"), (F.col("session_idx") + n).alias("session_idx"))
    return known.join(back, "session_idx", "left").drop("session_idx")


def purge(df: DataFrame, boundary: str, n: int, date: str = "date") -> DataFrame:
    """Training rows up to a boundary date, without the last n sessions before it."""
    upto = df.where(F.col(date) <= F.to_date(F.lit(boundary)))
    cal = sessions(upto, date)
    last = cal.agg((F.max("session_idx") - n).alias("last_kept")).scalar()
    kept = cal.where(F.col("session_idx") <= last).select(date)
    return upto.join(kept, date, "left_semi")


def retrain_plan(
    signal_dates: DataFrame, calendar: DataFrame, schedule: DataFrame, n: int
) -> DataFrame:
    """(signal_date, model_id, train_end, valid_until, purged_end) for dates inside the schedule.

    `schedule` is (model_id, train_end, valid_until).
    """
    purged = purge_date(calendar, schedule, n)
    side = purged.withColumn("signal_date", F.col("valid_until"))
    found = asof_join(
        signal_dates.select("signal_date").distinct(),
        side,
        on="signal_date",
        columns=["model_id", "train_end", "valid_until", "purged_end"],
        direction="forward",
    )
    return found.where(F.col("model_id").isNotNull())


def monthly_folds(df: DataFrame, date: str, init_months: int = 12, gap_months: int = 1) -> DataFrame:
    """One row per (row, test month) that uses it, with `role` train or test.

    For figures per fold, give it sums per month instead of rows: a month is then repeated, not its rows.
    Test months start once `init_months` training months and the gap lie before them. The months
    are few (a calendar), and each row computes the test months it trains for from its own
    month, so the blow-up is the training sets themselves.
    """
    month = month_index(F.col(date))
    span = df.agg(F.struct(F.min(month).alias("first"), F.max(month).alias("last")).alias("span"))
    rows = df.withColumn("__m", month).withColumn("__span", span.scalar())
    rows = rows.withColumns({"__first": F.col("__span.first"), "__last": F.col("__span.last")})
    start = F.col("__first") + init_months + gap_months
    first_use = F.greatest(F.col("__m") + gap_months + 1, start)
    trains = F.when(first_use <= F.col("__last"), F.sequence(first_use, F.col("__last")))
    tests = F.when(F.col("__m") >= start, F.array(F.col("__m")))
    uses = F.concat(
        F.transform(F.coalesce(trains, F.array().cast("array<int>")), lambda m: F.struct(m.alias("m"), F.lit("train").alias("role"))),
        F.transform(F.coalesce(tests, F.array().cast("array<int>")), lambda m: F.struct(m.alias("m"), F.lit("test").alias("role"))),
    )
    year, month0 = F.floor((F.col("__use.m") - 1) / 12), F.pmod(F.col("__use.m") - 1, F.lit(12))
    return rows.withColumn("__use", F.explode(uses)).select(
        *df.columns,
        F.make_date(year.cast("int"), (month0 + 1).cast("int"), F.lit(1)).alias("test_month"),
        F.col("__use.role").alias("role"),
    )


def impute(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, constant: float | None = None) -> DataFrame:
    """Fills NULLs with a constant, or with the mean of `fit_on` (the training rows)."""
    if constant is not None:
        return df.fillna(constant, subset=list(columns))
    if fit_on is None:
        raise ValueError("give the training rows to fit on, or a constant")
    means = fit_on.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("__means")[c]) for c in columns}
    return df.withColumn("__means", means).withColumns(filled).drop("__means")
