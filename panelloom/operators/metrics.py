"""Classification metrics over (label, prob, keys), one aggregate per group.

`label` is a boolean column, `prob` a score; NULL and NaN are unknown and left out. For rank statistics the
scores are counted per distinct value (map-side) into a written table, so the rows are read once. Only that table
is ordered: as it is while it is small, else over two nested levels of score bands, cut at quantiles of the
distinct scores, so that no task sorts a whole group. Both give the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.aggregates import count_where
from panelloom.functions.scalars import band, hash_slot, known_score, safe_div
from panelloom.sources.tables import materialise

# Score bands per level: OUTER bands with INNER bands each.
OUTER, INNER = 32, 32
#: distinct scores, over all groups, that one task may order without bands
ONE_TASK = 1_000_000


def classify(prob: Column, threshold: float = 0.5) -> Column:
    return prob >= F.lit(threshold)


def confusion(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*keys).agg(
        count_where(y & p).alias("tp"),
        count_where(~y & p).alias("fp"),
        count_where(~y & ~p).alias("tn"),
        count_where(y & ~p).alias("fn"),
    )


def classification_report(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1; an empty denominator gives 0."""
    return confusion(df, keys, label, pred).select("*", *_report_columns())


def _report_columns() -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return [
        (tp + fp + tn + fn).alias("rows"),
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def _known(df: DataFrame, label: str, prob: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & known_score(F.col(prob)).isNotNull())


def _score_counts(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """(keys, score, pos, neg) of each distinct score, as a written table, with its outer and inner band if it has many."""
    known = _known(df, label, prob).select(*keys, label, F.col(prob).cast("double").alias("score"))
    counts = known.groupBy(*keys, "score").agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    return _banded(materialise(counts, "scores"))


def _banded(counts: DataFrame) -> DataFrame:
    """Adds the bands to a written table of more than ONE_TASK scores: how many cuts lie at or below the score, first
    among the OUTER cuts, then among the INNER ones inside that band. Any cuts give the same statistics;
    quantiles of the distinct scores make bands of about as many of them."""
    if counts.count() <= ONE_TASK:
        return counts
    n = OUTER * INNER
    found = counts.agg(F.percentile_approx("score", [i / n for i in range(1, n)], 10_000).alias("all"))
    # once for the whole table: all cuts, and every INNER-th of them
    cuts = found.select(F.struct("all", F.filter("all", lambda _, i: (i + 1) % INNER == 0).alias("outer"))).scalar()

    def upto(found: Column) -> Column:
        return F.size(F.filter(found, lambda cut: cut <= F.col("score")))

    staged = counts.withColumn("__cuts", cuts).withColumn("outer", upto(F.col("__cuts.outer")))
    inner = upto(F.slice("__cuts.all", F.col("outer") * INNER + 1, F.lit(INNER)))
    return staged.withColumn("inner", F.col("outer") * (INNER + 1) + inner).drop("__cuts")


def _u_statistic(counts: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(keys, pos, neg, u, carried sums): u counts (positive, negative) pairs in right order, ties
    by half.

    u of a group is the sum of u inside its bands plus, for every band, its positives times the
    negatives of the bands below. Applied from the inside out, each window holds the distinct
    scores of one inner band, then the inner bands of one outer band, then the outer bands.
    """
    sums = [F.sum(c).alias(c) for c in ("pos", "neg", "u", *carry)]
    level = counts.withColumn("u", F.col("pos") * F.col("neg") * 0.5)
    nested = (([*keys, "outer", "inner"], "score"), ([*keys, "outer"], "inner"), ([*keys], "outer"))
    for parents, order in nested if "outer" in counts.columns else (([*keys], "score"),):
        if order != "score":
            level = level.groupBy(*parents, order).agg(*sums)
        below = F.coalesce(
            F.sum("neg").over(
                Window.partitionBy(*parents).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        )
        level = level.withColumn("u", F.col("u") + F.col("pos") * below.cast("double"))
    return level.groupBy(*keys).agg(*sums)


def _auc() -> Column:
    return safe_div(F.col("u"), F.col("pos").cast("double") * F.col("neg")).alias("auc")


def roc_auc(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", prob: str = "prob"
) -> DataFrame:
    """(keys, positives, negatives, auc); ties count half, a group of one class gets NULL."""
    stat = _u_statistic(_score_counts(df, keys, label, prob), keys)
    return stat.select(*keys, F.col("pos").alias("positives"), F.col("neg").alias("negatives"), _auc())


def _curve(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """Per distinct score: own counts, counts at or above it, the group's totals, and the counts of the next lower score.

    In bands, counts above a score = counts of the higher bands + inside its own inner band, and the last score of
    a band is followed by the first of the next lower one.
    """
    counts = _score_counts(df, keys, label, prob)
    own = [*keys, "inner"] if "inner" in counts.columns else [*keys]
    down = Window.partitionBy(*own).orderBy(F.col("score").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.struct("pos", "neg")
    inside = counts.select(
        *own, "score", "pos", "neg",
        F.sum("pos").over(upto).alias("cp"), F.sum("neg").over(upto).alias("cn"), F.lead(step).over(down).alias("next"),
    )
    whole = Window.partitionBy(*keys)
    if own == [*keys]:
        facts = inside.select("*", F.sum("pos").over(whole).cast("double").alias("pos_all"), F.sum("neg").over(whole).cast("double").alias("neg_all"))
    else:
        bands = counts.groupBy(*own).agg(F.sum("pos").alias("band_pos"), F.sum("neg").alias("band_neg"), F.max_by(step, "score").alias("first"))
        lower = whole.orderBy(F.col("inner").desc())
        higher = lower.rowsBetween(Window.unboundedPreceding, -1)
        offsets = bands.select(
            *own,
            F.coalesce(F.sum("band_pos").over(higher), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("band_neg").over(higher), F.lit(0)).alias("neg_above"),
            F.lead("first").over(lower).alias("below"),
            F.sum("band_pos").over(whole).cast("double").alias("pos_all"),
            F.sum("band_neg").over(whole).cast("double").alias("neg_all"),
        )
        facts = inside.join(offsets, own).withColumns({"cp": F.col("cp") + F.col("pos_above"), "cn": F.col("cn") + F.col("neg_above"), "next": F.coalesce("next", "below")})
    return facts.select(
        *keys,
        F.col("score").alias("threshold"),
        safe_div(F.col("cp"), F.col("pos_all")).alias("tpr"),
        safe_div(F.col("cn"), F.col("neg_all")).alias("fpr"),
        safe_div(F.col("pos").cast("double"), F.col("pos_all")).alias("tpr_gain"),
        safe_div(F.col("neg").cast("double"), F.col("neg_all")).alias("fpr_gain"),
        # the first point of a group, and those whose next step has another slope
        ((F.col("cp") == F.col("pos")) & (F.col("cn") == F.col("neg")) | F.col("next").isNull() | (F.col("pos") * F.col("next.neg") != F.col("neg") * F.col("next.pos"))).alias("corner"),
    )


def roc_curve(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", prob: str = "prob", thinned: bool = False
) -> DataFrame:
    """(keys, threshold, tpr, fpr), one row per distinct score.

    `thinned` leaves out points on the straight line between the points beside them, but never the first and the
    last one: the curve and its area stay the same.
    """
    curve = _curve(df, keys, label, prob)
    return (curve.where("corner") if thinned else curve).select(*keys, "threshold", "tpr", "fpr")


def trapezoid_auc(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", prob: str = "prob"
) -> DataFrame:
    """Area under the ROC points by the trapezoid rule: each point knows how much it added to
    both rates, so its trapezoid needs no neighbour."""
    area = F.col("fpr_gain") * (F.col("tpr") - F.col("tpr_gain") / 2)
    return _curve(df, keys, label, prob).groupBy(*keys).agg(
        F.sum(area).alias("auc"), F.count(F.lit(1)).alias("points")
    )


def segment_report(
    df: DataFrame, keys: Sequence[str], label: str = "label", prob: str = "prob", threshold: float = 0.5
) -> DataFrame:
    """classification_report and ROC AUC side by side per segment, from one pass over the rows:
    the counts per distinct score hold both."""
    counts = _score_counts(df, keys, label, prob)
    chosen = classify(F.col("score"), threshold)
    split = counts.withColumns(
        {"tp": F.when(chosen, F.col("pos")).otherwise(0), "fp": F.when(chosen, F.col("neg")).otherwise(0)}
    )
    stat = _u_statistic(split, keys, ["tp", "fp"])
    cells = stat.withColumns({"tn": F.col("neg") - F.col("fp"), "fn": F.col("pos") - F.col("tp")})
    return cells.select(*keys, "tp", "fp", "tn", "fn", *_report_columns(), _auc())


def fold_pair_statistics(df: DataFrame, fold: str, n_folds: int, label: str = "label", prob: str = "prob") -> DataFrame:
    """(pos_fold, neg_fold, pos, neg, u): pairs with the positive in one fold and the negative in
    the other.

    The pooled AUC of any resampling of folds is a ratio of two sums over these n_folds**2 rows,
    so a bootstrap never touches the predictions again. Folds are numbered 0..n_folds-1; each
    distinct score is repeated n_folds times per side, after it has been counted.
    """
    known = _known(df, label, prob).select(fold, label, F.col(prob).cast("double").alias("score"))
    counts = known.groupBy(fold, "score").agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    own, zero = F.col(fold).cast("int"), F.lit(0).cast("long")
    uses = []
    for other in range(n_folds):
        uses.append(F.struct(own.alias("pos_fold"), F.lit(other).alias("neg_fold"), F.col("pos").alias("pos"), zero.alias("neg")))
        uses.append(F.struct(F.lit(other).alias("pos_fold"), own.alias("neg_fold"), zero.alias("pos"), F.col("neg").alias("neg")))
    pairs = (
        counts.select("score", F.explode(F.array(*uses)).alias("__u"))
        .select("score", "__u.*")
        .groupBy("pos_fold", "neg_fold", "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    return _u_statistic(_banded(materialise(pairs, "scores")), ["pos_fold", "neg_fold"])


def bootstrap_auc(pair_stats: DataFrame, n_folds: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(draw, auc): pooled AUC of `draws` resamplings of the folds with replacement."""
    spark = pair_stats.sparkSession
    slots = spark.range(draws).select(
        F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("slot")
    )
    picks = slots.groupBy(
        "draw", hash_slot(seed, n_folds, F.col("draw"), F.col("slot")).cast("int").alias("picked")
    ).agg(F.count(F.lit(1)).alias("times"))
    as_pos = picks.select("draw", F.col("picked").alias("pos_fold"), F.col("times").alias("pos_times"))
    as_neg = picks.select("draw", F.col("picked").alias("neg_fold"), F.col("times").alias("neg_times"))
    drawn = as_pos.join(pair_stats, "pos_fold").join(as_neg, ["draw", "neg_fold"])
    weight = F.col("pos_times") * F.col("neg_times")
    return drawn.groupBy("draw").agg(
        safe_div(
            F.sum(weight * F.col("u")), F.sum(weight.cast("double") * F.col("pos") * F.col("neg"))
        ).alias("auc")
    )


def bootstrap_interval(draws: DataFrame, column: str = "auc", level: float = 0.95) -> DataFrame:
    """Percentile interval over the draws (as many rows as draws, so an exact percentile fits)."""
    tail = (1 - level) / 2
    return draws.agg(
        F.percentile(column, tail).alias("lower"),
        F.percentile(column, 1 - tail).alias("upper"),
        F.avg(column).alias("mean"),
        F.count(column).alias("draws"),
    )


def paired_bootstrap(a: DataFrame, b: DataFrame, level: float = 0.95) -> DataFrame:
    """Interval of auc(b) - auc(a) over shared draws and whether it excludes zero."""
    diff = a.select("draw", F.col("auc").alias("a")).join(b.select("draw", F.col("auc").alias("b")), "draw")
    bounds = bootstrap_interval(diff.select((F.col("b") - F.col("a")).alias("diff")), "diff", level)
    return bounds.withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0))


def binomial_interval(hits: Column, n: Column, z: float = 1.96) -> dict[str, Column]:
    """rate, lower and upper of the normal interval of a proportion."""
    rate = safe_div(hits.cast("double"), n.cast("double"))
    half = F.lit(z) * F.sqrt(rate * (1.0 - rate) / n)
    return {"rate": rate, "ci_lower": rate - half, "ci_upper": rate + half}


def calibration(df: DataFrame, bins: int = 10, keys: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """Per probability bin: rows, mean probability, observed rate."""
    slot = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(label).isNotNull()).groupBy(*keys, slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(prob).alias("mean_prob"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )


def stability(segments: DataFrame, metric: str, keys: Sequence[str] = (), edges: Sequence[float] = (0.05, 0.10)) -> DataFrame:
    """Spread of a metric over segments, and its verdict against two thresholds."""
    spread = F.stddev_samp(metric)
    return segments.groupBy(*keys).agg(
        F.count(metric).alias("segments"),
        F.avg(metric).alias("mean"),
        spread.alias("std"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        band(spread, edges, ["stable", "moderate", "unstable"]).alias("verdict"),
    )


def positive_hit_rate(df: DataFrame, keys: Sequence[str] = (), label: str = "label", prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """Hit rate among the rows predicted positive."""
    chosen = df.where(classify(F.col(prob), threshold) & F.col(label).isNotNull())
    return chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("predicted_positive"), F.avg(F.col(label).cast("double")).alias("hit_rate")
    )


def reproduce(measured: DataFrame, expected: dict[str, float], tolerance: float = 0.001) -> DataFrame:
    """(metric, measured, expected, difference, passed) for a one-row frame of metrics."""
    names = list(expected)
    wide = measured.select(*[F.col(n).cast("double").alias(n) for n in names])
    table = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(expected[n])))])
    return wide.unpivot([], names, "metric", "measured").select(
        "metric",
        "measured",
        table[F.col("metric")].alias("expected"),
        F.abs(F.col("measured") - table[F.col("metric")]).alias("difference"),
        (F.abs(F.col("measured") - table[F.col("metric")]) <= tolerance).alias("passed"),
    )
