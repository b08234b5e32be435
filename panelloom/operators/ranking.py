"""Ranking of assets within a date and audits of the top pick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.aggregates import count_where
from panelloom.functions.scalars import best_first, known_score
from panelloom.operators.metrics import binomial_interval


def rank_by_score(
    df: DataFrame,
    date: str = "signal_date",
    asset: str = "asset",
    prob: str = "prob",
    out: str = "rank",
    bands: int = 64,
) -> DataFrame:
    """1 for the best score of the date; ties go to the smaller asset key, unknown scores last.

    The rank is the number of rows in higher score bands plus the place inside the own band, so
    that a date with very many assets is sorted by many tasks. The bands are cut at approximate
    quantiles of the scores at hand, wherever they crowd, and unknown scores are a band of their
    own; where the cuts lie has no influence on the rank. `bands=1` sorts each date in one task,
    which reads df once and suits dates with few assets.
    """
    order = best_first(F.col(prob), F.col(asset))
    if bands == 1:
        w = Window.partitionBy(date).orderBy(order)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    score = known_score(F.col(prob))
    cuts = df.agg(F.percentile_approx(score, [i / bands for i in range(1, bands)], 10_000)).scalar()
    # The number of cuts above a score: 0 for the best band. Without a known score there are no cuts.
    above_it = F.size(F.filter("__cuts", lambda cut: cut > score))
    staged = df.withColumn("__cuts", cuts)
    banded = staged.withColumn("__band", F.when(score.isNull(), F.lit(bands)).otherwise(above_it)).drop("__cuts")
    higher = Window.partitionBy(date).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    above = banded.groupBy(date, "__band").agg(F.count(F.lit(1)).alias("__n")).select(
        date, "__band", F.coalesce(F.sum("__n").over(higher), F.lit(0)).alias("__above")
    )
    inside = Window.partitionBy(date, "__band").orderBy(order)
    return (
        banded.withColumn("__place", F.row_number().over(inside))
        .join(above, [date, "__band"])
        .select(*df.columns, (F.col("__above") + F.col("__place")).alias(out))
    )


def top_picks(
    df: DataFrame,
    date: str = "signal_date",
    asset: str = "asset",
    prob: str = "prob",
    target: str = "target",
    alpha: str = "alpha",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Best-scored asset per date, whether it beat the benchmark and whether it was the best one.

    One aggregate per date: min_by over the score order is combined map-side, so a date with very
    many assets is never sorted. Unknown scores are no candidates.
    """
    order = best_first(F.col(prob), F.col(asset))
    known = df.where(known_score(F.col(prob)).isNotNull())
    picked = known.groupBy(*keys, date).agg(
        F.min_by(F.struct(asset, prob, target, alpha), order).alias("pick"),
        F.max(alpha).alias("best_alpha"),
        F.count(F.lit(1)).alias("candidates"),
    )
    return picked.select(
        *keys,
        date,
        F.col(f"pick.{asset}").alias("picked_asset"),
        F.col(f"pick.{prob}").alias("picked_prob"),
        F.col(f"pick.{target}").alias("beat_benchmark"),
        F.col(f"pick.{alpha}").alias("picked_alpha"),
        "best_alpha",
        (F.col(f"pick.{alpha}") == F.col("best_alpha")).alias("was_best"),
        "candidates",
    )


def pick_summary(picks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dates, hits, hit rate with its interval, and how often the pick was the best asset."""
    counts = picks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dates"),
        count_where(F.col("beat_benchmark")).alias("hits"),
        count_where(F.col("was_best")).alias("best_hits"),
        F.avg("picked_alpha").alias("mean_alpha"),
    )
    ci = binomial_interval(F.col("hits"), F.col("dates"))
    return counts.select(
        "*",
        ci["rate"].alias("hit_rate"),
        ci["ci_lower"].alias("ci_lower"),
        ci["ci_upper"].alias("ci_upper"),
        (F.col("best_hits") / F.col("dates")).alias("best_rate"),
    )


def pick_concentration(picks: DataFrame, keys: Sequence[str] = ("picked_asset",)) -> DataFrame:
    """How often each asset is picked, its share of all picks and its own hit rate."""
    total = picks.agg(F.count(F.lit(1)).alias("all_picks")).scalar()
    return picks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("picks"),
        F.avg(F.col("beat_benchmark").cast("double")).alias("hit_rate"),
    ).select("*", (F.col("picks") / total).alias("pick_share"))


def compare_rates(summary: DataFrame, reference: dict[str, float]) -> DataFrame:
    """Hit rate against named reference rates: difference and whether the interval holds them."""
    refs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("reference"), F.lit(float(v)).alias("reference_rate")) for k, v in reference.items()])
    )
    return summary.select("hit_rate", "ci_lower", "ci_upper", refs.alias("__r")).select(
        "__r.reference",
        "__r.reference_rate",
        "hit_rate",
        (F.col("hit_rate") - F.col("__r.reference_rate")).alias("difference"),
        F.col("__r.reference_rate").between(F.col("ci_lower"), F.col("ci_upper")).alias("inside_interval"),
    )


def score_gap(df: DataFrame, date: str = "signal_date", asset: str = "asset", prob: str = "prob") -> DataFrame:
    """(date, best, second, gap): score distance between the first and second rank.

    Filtering the row number to 2 limits each task to two candidates per date before the shuffle.
    Unknown scores are no candidates.
    """
    w = Window.partitionBy(date).orderBy(best_first(F.col(prob), F.col(asset)))
    two = df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    best = F.max(F.when(F.col("__rn") == 1, known_score(F.col(prob))))
    second = F.max(F.when(F.col("__rn") == 2, known_score(F.col(prob))))
    return two.groupBy(date).agg(best.alias("best"), second.alias("second"), (best - second).alias("gap"))
