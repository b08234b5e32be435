"""Aggregations of a long attribution table (row_id, asset, date, feature, value, contribution,
label, prob), and producers of such a table for linear scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.aggregates import count_where
from panelloom.functions.scalars import month_start
from panelloom.operators.metrics import roc_auc


def _group_of(groups: dict[str, Sequence[str]]) -> Column:
    """Group name of the `feature` column from a literal map; NULL for a feature in no group."""
    pairs = [(f, g) for g, members in groups.items() for f in members]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return table[F.col("feature")]


def global_importance(attr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per feature: mean absolute, mean and spread of the contributions, rank, direction."""
    c = F.col("contribution")
    stats = attr.groupBy(*keys, "feature").agg(
        F.avg(F.abs(c)).alias("importance"),
        F.avg(c).alias("mean_contribution"),
        F.stddev_pop(c).alias("std_contribution"),
        F.count(c).alias("rows"),
    )
    # One row per feature is left: the ranking window is as long as the feature list.
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature")
    return stats.select(
        "*",
        F.row_number().over(w).cast("long").alias("rank"),
        F.when(F.col("mean_contribution") > 0, "raises").otherwise("lowers").alias("direction"),
    )


def group_importance(attr: DataFrame, groups: dict[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Summed importance, share of the total and mean direction per feature group."""
    ranked = global_importance(attr, keys).withColumn("feature_group", _group_of(groups))
    w = Window.partitionBy(*keys)
    sums = ranked.where(F.col("feature_group").isNotNull()).groupBy(*keys, "feature_group").agg(
        F.sum("importance").alias("importance"),
        F.avg("mean_contribution").alias("mean_contribution"),
        F.count(F.lit(1)).alias("features"),
    )
    return sums.select("*", (F.col("importance") / F.sum("importance").over(w)).alias("share"))


def importance_by(attr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute and mean contribution per feature within each key (asset, month, ...)."""
    return attr.groupBy(*by, "feature").agg(
        F.avg(F.abs("contribution")).alias("importance"), F.avg("contribution").alias("mean_contribution")
    )


def by_month(attr: DataFrame, date: str = "date") -> DataFrame:
    return attr.withColumn("month", month_start(F.col(date)))


def outcome_flags(df: DataFrame, threshold: float = 0.5, label: str = "label", prob: str = "prob") -> DataFrame:
    """Adds pred, correct, tp, tn, fp, fn."""
    y, p = F.col(label), F.col("pred")
    return df.withColumn("pred", F.col(prob) >= threshold).select(
        "*",
        (p == y).alias("correct"),
        (p & y).alias("tp"),
        (~p & ~y).alias("tn"),
        (p & ~y).alias("fp"),
        (~p & y).alias("fn"),
    )


def example_rows(flags: DataFrame, key: str = "row_id", prob: str = "prob") -> DataFrame:
    """(example, row, prob): one row per kind, all picked in a single aggregate.

    Most confident right and wrong rows, borderline true positive and negative (closest to 0.5),
    most confident false positive and negative; ties go to the smaller row key.
    """
    p = F.col(prob)
    near = F.abs(p - 0.5)
    kinds = {
        "correct_high": (F.col("correct"), -p),
        "incorrect_high": (~F.col("correct"), -p),
        "borderline_tp": (F.col("tp"), near),
        "borderline_tn": (F.col("tn"), near),
        "confident_fp": (F.col("fp"), -p),
        "confident_fn": (F.col("fn"), p),
    }
    picks = flags.agg(
        *[
            F.min(F.when(condition, F.struct(order.alias("o"), F.col(key).alias("row"), p.alias("prob")))).alias(name)
            for name, (condition, order) in kinds.items()
        ]
    )
    return (
        picks.unpivot([], list(kinds), "example", "pick")
        .where(F.col("pick").isNotNull())
        .select("example", "pick.row", "pick.prob")
    )


def correct_vs_incorrect(attr: DataFrame) -> DataFrame:
    """Mean contribution per feature among right rows, wrong rows, false positives and negatives."""
    flagged = outcome_flags(attr)

    def mean_where(name: str, negate: bool = False) -> Column:
        condition = ~F.col(name) if negate else F.col(name)
        return F.avg(F.when(condition, F.col("contribution")))

    stats = flagged.groupBy("feature").agg(
        mean_where("correct").alias("correct_mean"),
        mean_where("correct", negate=True).alias("incorrect_mean"),
        F.coalesce(mean_where("fp"), F.lit(0.0)).alias("fp_mean"),
        F.coalesce(mean_where("fn"), F.lit(0.0)).alias("fn_mean"),
    )
    diff = F.col("correct_mean") - F.col("incorrect_mean")
    w = Window.orderBy(F.col("abs_difference").desc(), "feature")
    return stats.select("*", diff.alias("difference"), F.abs(diff).alias("abs_difference")).withColumn(
        "rank", F.row_number().over(w).cast("long")
    )


def confident_errors(flags: DataFrame, keys: Sequence[str] = ("asset",), high: float = 0.7, low: float = 0.3, prob: str = "prob") -> DataFrame:
    """Wrong rows with an extreme score per key: count, share of the key's errors, mean score."""
    wrong = ~F.col("correct")
    extreme = wrong & ((F.col(prob) > high) | (F.col(prob) < low))
    return flags.groupBy(*keys).agg(
        count_where(wrong).alias("errors"),
        count_where(extreme).alias("confident_errors"),
        F.avg(F.when(extreme, F.col(prob))).alias("mean_prob"),
    ).withColumn("share_of_errors", F.col("confident_errors") / F.nullif(F.col("errors"), F.lit(0)))


def concentration(importance: DataFrame, value: str = "importance") -> DataFrame:
    """Share of the top feature and of the top three; one row per feature enters."""
    return importance.agg(
        (F.max_by(value, -F.col("rank")) / F.sum(value)).alias("top1_share"),
        (F.sum(F.when(F.col("rank") <= 3, F.col(value))) / F.sum(value)).alias("top3_share"),
        F.max_by("feature", -F.col("rank")).alias("top_feature"),
    )


def _top_of_cells(df: DataFrame, keep: Sequence[str], k: int) -> DataFrame:
    """The k largest and k smallest contributions of each row's `cells` array.

    Both orders are sorted inside the row, whose array is as long as the feature list.
    """
    up = F.sort_array(
        F.transform("__cells", lambda c: F.struct((-c["contribution"]).alias("o"), c["feature"].alias("f"), c["value"].alias("v"), c["contribution"].alias("c")))
    )
    down = F.sort_array(
        F.transform("__cells", lambda c: F.struct(c["contribution"].alias("o"), c["feature"].alias("f"), c["value"].alias("v"), c["contribution"].alias("c")))
    )

    def side(name: str, ordered: Column) -> Column:
        return F.transform(
            F.slice(ordered, 1, k),
            lambda c, i: F.struct(
                F.lit(name).alias("side"), (i + 1).cast("long").alias("place"),
                c["f"].alias("feature"), c["v"].alias("value"), c["c"].alias("contribution"),
            ),
        )

    cells = F.explode(F.concat(side("raises", up), side("lowers", down)))
    return df.select(*keep, cells.alias("__top")).select(*keep, "__top.*")


def local_top(attr: DataFrame, k: int = 5) -> DataFrame:
    """Per row of a long table, its k largest and k smallest contributions with place and side.

    The rows of one row_id are gathered into an array as long as the feature list. They are gathered by a
    window after the shuffle: as an aggregate they would be sorted before it as well, which spills as
    many bytes as the whole long table once a task's rows outgrow its memory.
    """
    w = Window.partitionBy("row_id").orderBy("row_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = attr.select(
        "row_id",
        F.collect_list(F.struct("feature", "value", "contribution")).over(whole).alias("__cells"),
        F.row_number().over(w).alias("__first"),
    ).where("__first = 1")
    return _top_of_cells(gathered, ["row_id"], k)


def _contribution_cells(
    df: DataFrame, coefficients: dict[str, float], keep: Sequence[str], means: DataFrame | None
) -> DataFrame:
    """keep columns and an array of (feature, value, contribution), one entry per feature."""
    features = list(coefficients)
    fit = (means if means is not None else df).agg(
        F.struct(*[F.avg(c).alias(c) for c in features]).alias("m")
    ).scalar()
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
                (F.lit(float(w)) * (F.col(c) - F.col("__m")[c])).alias("contribution"),
            )
            for c, w in coefficients.items()
        ]
    )
    return df.withColumn("__m", fit).select(*keep, cells.alias("__cells"))


def linear_contributions(
    df: DataFrame, coefficients: dict[str, float], keep: Sequence[str], means: DataFrame | None = None
) -> DataFrame:
    """Long table with contribution = coefficient * (value - mean) per feature.

    Means come from `means` (a frame to fit on) or from df itself, as a one-row subquery.
    """
    cells = _contribution_cells(df, coefficients, keep, means)
    return cells.select(*keep, F.explode("__cells").alias("__cell")).select(*keep, "__cell.*")


def linear_local_top(
    df: DataFrame, coefficients: dict[str, float], keep: Sequence[str], k: int = 5, means: DataFrame | None = None
) -> DataFrame:
    """`local_top` of the linear contributions without building the long table: no shuffle."""
    return _top_of_cells(_contribution_cells(df, coefficients, keep, means), keep, k)


def permuted(df: DataFrame, feature: str, key: Sequence[str], seed: int = 42, bucket_rows: int = 100_000) -> DataFrame:
    """df with one feature shuffled among rows by two hash orders.

    Rows are dealt into buckets by the hash of their key, then each row takes the value of the
    row with the same place under a second hash order of the same bucket. Buckets are even
    because the hash covers the whole unique key, and as many as the counted rows need.
    """
    buckets = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / bucket_rows), F.lit(1))).scalar()
    first = F.xxhash64(F.lit(seed), *key)
    second = F.xxhash64(F.lit(seed + 1), *key)
    bucket = F.pmod(first, buckets).alias("__b")
    taker = df.withColumn("__b", bucket).withColumn(
        "__p", F.row_number().over(Window.partitionBy("__b").orderBy(first, *key))
    )
    giver = (
        df.select(*key, F.col(feature).alias("__value"))
        .withColumn("__b", bucket)
        .withColumn("__p", F.row_number().over(Window.partitionBy("__b").orderBy(second, *key)))
        .select("__b", "__p", "__value")
    )
    return taker.join(giver, ["__b", "__p"]).withColumn(feature, F.col("__value")).select(*df.columns)


def permutation_importance(
    df: DataFrame, features: Sequence[str], score: callable, key: Sequence[str], label: str = "label", seed: int = 42, bucket_rows: int = 100_000
) -> DataFrame:
    """(feature, base_auc, permuted_auc, auc_drop); `score` maps a frame to it plus `prob`."""
    runs = score(df).select(F.lit("").alias("feature"), label, "prob")
    for f in features:
        runs = runs.unionByName(score(permuted(df, f, key, seed, bucket_rows)).select(F.lit(f).alias("feature"), label, "prob"))
    aucs = roc_auc(runs, ["feature"], label)
    base = aucs.where(F.col("feature") == "").select("auc").scalar()
    return aucs.where(F.col("feature") != "").select(
        "feature", base.alias("base_auc"), F.col("auc").alias("permuted_auc"), (base - F.col("auc")).alias("auc_drop")
    )
