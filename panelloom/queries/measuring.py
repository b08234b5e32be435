"""Evaluation-metric queries (survey ids MT*), mostly over every order as a scored row."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.aggregates import weighted_mean
from panelloom.operators import metrics as M
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.queries.windows import r6

_AUC = """
SELECT {keys} AS k, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n,
       (sum(CASE WHEN label THEN avg_rank ELSE 0 END) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2e0)
         / nullif(CAST(count(*) FILTER (label) AS DOUBLE) * count(*) FILTER (NOT label), 0) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY prob) + (count(*) OVER (PARTITION BY {keys}, prob) - 1) / 2e0 AS avg_rank FROM {source})
GROUP BY {keys}"""


def auc_sql(keys: str, source: str = "scored") -> str:
    """(k, p, n, auc) by the rank-sum form with average ranks."""
    return _AUC.format(keys=keys, source=source)


@query("mt1_threshold_class", sql("scored", "SELECT row_id, prob >= 0.5e0 AS pred FROM scored"))
def mt1(spark, sf):
    return roles.scored_orders(spark, sf).select("row_id", M.classify(F.col("prob")).alias("pred"))


_CM = """
count(*) FILTER (label AND prob >= 0.5e0) AS tp, count(*) FILTER (NOT label AND prob >= 0.5e0) AS fp,
count(*) FILTER (NOT label AND prob < 0.5e0) AS tn, count(*) FILTER (label AND prob < 0.5e0) AS fn"""


@query("mt2_confusion_matrix", sql("scored", f"SELECT segment, {_CM} FROM scored GROUP BY 1"))
def mt2(spark, sf):
    df = roles.scored_orders(spark, sf).withColumn("pred", M.classify(F.col("prob")))
    return M.confusion(df, ["segment"])


_REPORT = """
tp, fp, tn, fn, tp + fp + tn + fn AS rows, round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 6) + 0e0 AS accuracy,
round(COALESCE(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) + 0e0 AS precision, round(COALESCE(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) + 0e0 AS recall,
round(COALESCE(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0e0 AS f1"""


def _rounded(df, *keys):
    return df.select(*keys, "tp", "fp", "tn", "fn", "rows", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query("mt3_classification_report", sql("scored", f"SELECT {_REPORT} FROM (SELECT {_CM} FROM scored)"))
def mt3(spark, sf):
    df = roles.scored_orders(spark, sf).withColumn("pred", M.classify(F.col("prob")))
    return _rounded(M.classification_report(df))


@query(
    "mt4_roc_auc_ties",
    sql("scored", f"SELECT k AS segment, p AS positives, n AS negatives, round(auc, 6) + 0e0 AS auc FROM ({auc_sql('segment')})"),
)
def mt4(spark, sf):
    return M.roc_auc(roles.scored_orders(spark, sf), ["segment"]).select("segment", "positives", "negatives", r6("auc"))


@query(
    "mt4_roc_auc_fine_scores",
    """
WITH scored AS (SELECT l_returnflag AS segment, ((l_orderkey * 7919 + l_partkey * 31) % 1000003) / 1000003e0 AS prob, l_linestatus = 'F' AS label FROM lineitem)
SELECT k AS segment, p AS positives, n AS negatives, round(auc, 6) + 0e0 AS auc FROM ("""
    + auc_sql("segment")
    + ")",
)
def mt4_fine(spark, sf):
    df = roles.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("segment"),
        ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31) % 1000003 / 1000003.0).alias("prob"),
        (F.col("l_linestatus") == "F").alias("label"),
    )
    return M.roc_auc(df, ["segment"]).select("segment", "positives", "negatives", r6("auc"))


_CURVE = """
WITH s AS (SELECT prob, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM scored GROUP BY 1),
c AS (SELECT prob, pos, neg, sum(pos) OVER (ORDER BY prob DESC) / CAST(sum(pos) OVER () AS DOUBLE) AS tpr,
             sum(neg) OVER (ORDER BY prob DESC) / CAST(sum(neg) OVER () AS DOUBLE) AS fpr FROM s)
"""


@query("mt5_roc_curve", sql("scored", _CURVE + "SELECT prob AS threshold, round(tpr, 9) + 0e0 AS tpr, round(fpr, 9) + 0e0 AS fpr FROM c"))
def mt5(spark, sf):
    df = M.roc_curve(roles.scored_orders(spark, sf))
    return df.select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(
    "mt5_thinned_roc_curve",
    sql(
        "scored",
        _CURVE
        + """, n AS (SELECT *, lead(pos) OVER (ORDER BY prob DESC) AS np, lead(neg) OVER (ORDER BY prob DESC) AS nn, row_number() OVER (ORDER BY prob DESC) AS i FROM c)
SELECT prob AS threshold, round(tpr, 9) + 0e0 AS tpr, round(fpr, 9) + 0e0 AS fpr FROM n WHERE i = 1 OR np IS NULL OR pos * nn <> neg * np""",
    ),
)
def mt5_thinned(spark, sf):
    df = M.roc_curve(roles.scored_orders(spark, sf), thinned=True)
    return df.select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(
    "mt5_trapezoid_auc",
    sql(
        "scored",
        _CURVE
        + """
SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) + 0e0 AS auc, count(*) AS points
FROM (SELECT *, COALESCE(lag(fpr) OVER (ORDER BY prob DESC), 0) AS pf, COALESCE(lag(tpr) OVER (ORDER BY prob DESC), 0) AS pt FROM c)""",
    ),
)
def mt5_area(spark, sf):
    return M.trapezoid_auc(roles.scored_orders(spark, sf)).select(r6("auc"), "points")


def _segments(key: str) -> str:
    return f"""
SELECT r.{key}, {_REPORT}, round(a.auc, 6) + 0e0 AS auc
FROM (SELECT {key}, {_CM} FROM scored GROUP BY 1) r JOIN ({auc_sql(key)}) a ON a.k = r.{key}"""


@query("mt6_metrics_by_segment", sql("scored", _segments("segment")))
def mt6(spark, sf):
    df = M.segment_report(roles.scored_orders(spark, sf), ["segment"])
    return _rounded(df, "segment", r6("auc"))


@query("mt6_metrics_by_month", sql("scored", _segments("month")))
def mt6_month(spark, sf):
    df = M.segment_report(roles.scored_orders(spark, sf), ["month"])
    return _rounded(df, "month", r6("auc"))


@query(
    "mt7_pooled_and_weighted_auc",
    sql(
        "scored",
        f"""
WITH scored_all AS (SELECT *, 1 AS one FROM scored), pooled AS ({auc_sql('one', 'scored_all')}),
folds AS ({auc_sql('segment')})
SELECT (SELECT round(auc, 6) FROM pooled) AS pooled_auc, round(sum(auc * (p + n)) / sum(p + n), 6) + 0e0 AS weighted_auc, round(avg(auc), 6) + 0e0 AS mean_auc FROM folds""",
    ),
)
def mt7(spark, sf):
    df = roles.scored_orders(spark, sf)
    pooled = M.roc_auc(df).select("auc").scalar()
    rows = F.col("positives") + F.col("negatives")
    return M.roc_auc(df, ["segment"]).agg(
        F.round(F.max(pooled), 6).alias("pooled_auc"),
        F.round(weighted_mean(F.col("auc"), rows), 6).alias("weighted_auc"),
        F.round(F.avg("auc"), 6).alias("mean_auc"),
    )


_N_FOLDS = 5
_SLOT = f"CAST(('0x' || substr(md5('{{seed}}|' || d.draw || '|' || s.slot), 1, 12)) AS BIGINT) % {_N_FOLDS}"


def _boot_sql(model: str, seed: int = 42) -> str:
    """Pooled AUC per draw over the folds of `scored_folds`, by summing fold-pair statistics."""
    slot = _SLOT.format(seed=seed)
    return f"""
picks AS (SELECT draw, f, count(*) AS times FROM (SELECT d.draw, {slot} AS f FROM range(1000) d(draw), range({_N_FOLDS}) s(slot)) GROUP BY 1, 2),
score_{model} AS (SELECT fold, {model} AS prob, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM sf GROUP BY 1, 2),
pair_{model} AS (SELECT a.fold AS pf, b.fold AS nf, sum(CAST(a.pos * b.neg AS DOUBLE) * CASE WHEN a.prob > b.prob THEN 1 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END) AS u,
             sum(CAST(a.pos * b.neg AS DOUBLE)) AS pn FROM score_{model} a, score_{model} b GROUP BY 1, 2),
draw_{model} AS (SELECT x.draw, sum(x.times * y.times * p.u) / sum(x.times * y.times * p.pn) AS auc
         FROM picks x JOIN picks y USING (draw) JOIN pair_{model} p ON p.pf = x.f AND p.nf = y.f GROUP BY 1)"""


_SF = "sf AS (SELECT CAST(substr(segment, 1, 1) AS BIGINT) - 1 AS fold, prob, ((row_id * 104729) % 1000) / 1000e0 AS prob_b, label FROM scored)"


def _fold_scores(spark, sf):
    fold = (F.substring("segment", 1, 1).cast("int") - 1).alias("fold")
    other = ((F.col("row_id") * 104729 % 1000) / 1000.0).alias("prob_b")
    return roles.scored_orders(spark, sf).select(fold, "prob", other, "label")


def _boot(df, prob: str, draws: int = 1000):
    return M.bootstrap_auc(M.fold_pair_statistics(df, "fold", _N_FOLDS, prob=prob), _N_FOLDS, draws)


@query(
    "mt8_fold_bootstrap_draws",
    sql("scored", f"WITH {_SF}, {_boot_sql('prob').strip()} SELECT draw, round(auc, 6) + 0e0 AS auc FROM draw_prob"),
)
def mt8(spark, sf):
    return _boot(_fold_scores(spark, sf), "prob").select("draw", r6("auc"))


@query(
    "mt8_paired_bootstrap_interval",
    sql(
        "scored",
        f"""WITH {_SF}, {_boot_sql('prob').strip()}, {_boot_sql('prob_b').strip().split(',' + chr(10), 1)[1]},
j AS (SELECT b.auc - a.auc AS diff FROM draw_prob a JOIN draw_prob_b b USING (draw)),
q AS (SELECT quantile_cont(diff, 0.025) AS lower, quantile_cont(diff, 0.975) AS upper, avg(diff) AS mean, count(*) AS draws FROM j)
SELECT round(lower, 6) + 0e0 AS lower, round(upper, 6) + 0e0 AS upper, round(mean, 6) + 0e0 AS mean, draws, lower > 0 OR upper < 0 AS significant FROM q""",
    ),
)
def mt8_paired(spark, sf):
    df = _fold_scores(spark, sf)
    out = M.paired_bootstrap(_boot(df, "prob"), _boot(df, "prob_b"))
    return out.select(r6("lower"), r6("upper"), r6("mean"), "draws", "significant")


@query(
    "mt9_binomial_interval",
    sql(
        "scored",
        """
SELECT segment, hits, n, round(hits / CAST(n AS DOUBLE), 6) + 0e0 AS rate,
       round(hits / CAST(n AS DOUBLE) - 1.96e0 * sqrt(hits / CAST(n AS DOUBLE) * (1 - hits / CAST(n AS DOUBLE)) / n), 6) + 0e0 AS ci_lower,
       round(hits / CAST(n AS DOUBLE) + 1.96e0 * sqrt(hits / CAST(n AS DOUBLE) * (1 - hits / CAST(n AS DOUBLE)) / n), 6) + 0e0 AS ci_upper
FROM (SELECT segment, count(*) FILTER (label) AS hits, count(*) AS n FROM scored GROUP BY 1)""",
    ),
)
def mt9(spark, sf):
    counts = roles.scored_orders(spark, sf).groupBy("segment").agg(
        F.count_if("label").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    ci = M.binomial_interval(F.col("hits"), F.col("n"))
    return counts.select("segment", "hits", "n", *[F.round(c, 6).alias(name) for name, c in ci.items()])


@query(
    "mt10_calibration_bins",
    sql(
        "scored",
        """
SELECT CAST(least(floor(prob * 10), 9) + 0e0 AS INTEGER) AS bin, count(*) AS rows, round(avg(prob), 6) + 0e0 AS mean_prob, round(avg(CAST(label AS INTEGER)), 6) + 0e0 AS observed_rate
FROM scored GROUP BY 1""",
    ),
)
def mt10(spark, sf):
    return M.calibration(roles.scored_orders(spark, sf)).select("bin", "rows", r6("mean_prob"), r6("observed_rate"))


@query(
    "mt11_monthly_stability",
    sql(
        "scored",
        """
WITH m AS (SELECT segment, month, avg(CAST((prob >= 0.5e0) = label AS INTEGER)) AS accuracy FROM scored GROUP BY 1, 2)
SELECT segment, count(*) AS segments, round(avg(accuracy), 6) + 0e0 AS mean, round(stddev_samp(accuracy), 6) + 0e0 AS std, round(min(accuracy), 6) + 0e0 AS min, round(max(accuracy), 6) + 0e0 AS max,
       CASE WHEN stddev_samp(accuracy) < 0.05e0 THEN 'stable' WHEN stddev_samp(accuracy) < 0.1e0 THEN 'moderate' ELSE 'unstable' END AS verdict
FROM m GROUP BY 1""",
    ),
)
def mt11(spark, sf):
    scored = roles.scored_orders(spark, sf)
    hit = (M.classify(F.col("prob")) == F.col("label")).cast("double")
    monthly = scored.groupBy("segment", "month").agg(F.avg(hit).alias("accuracy"))
    out = M.stability(monthly, "accuracy", ["segment"])
    return out.select("segment", "segments", r6("mean"), r6("std"), r6("min"), r6("max"), "verdict")


@query(
    "mt12_metric_reproduction",
    sql(
        "scored",
        """
WITH r AS (SELECT avg(CAST((prob >= 0.5e0) = label AS INTEGER)) AS accuracy, avg(CAST(label AS INTEGER)) AS base_rate FROM scored)
SELECT 'accuracy' AS metric, round(accuracy, 6) + 0e0 AS measured, 0.5e0 AS expected, round(abs(accuracy - 0.5e0), 6) + 0e0 AS difference, abs(accuracy - 0.5e0) <= 0.01e0 AS passed FROM r
UNION ALL SELECT 'base_rate', round(base_rate, 6), 0.9e0, round(abs(base_rate - 0.9e0), 6), abs(base_rate - 0.9e0) <= 0.01e0 FROM r""",
    ),
)
def mt12(spark, sf):
    hit = (M.classify(F.col("prob")) == F.col("label")).cast("double")
    measured = roles.scored_orders(spark, sf).agg(
        F.avg(hit).alias("accuracy"), F.avg(F.col("label").cast("double")).alias("base_rate")
    )
    out = M.reproduce(measured, {"accuracy": 0.5, "base_rate": 0.9}, tolerance=0.01)
    return out.select("metric", r6("measured"), "expected", r6("difference"), "passed")


@query(
    "mt13_hit_rate_of_positive_predictions",
    sql(
        "scored",
        "SELECT segment, count(*) AS predicted_positive, round(avg(CAST(label AS INTEGER)), 6) + 0e0 AS hit_rate FROM scored WHERE prob >= 0.5e0 GROUP BY 1",
    ),
)
def mt13(spark, sf):
    out = M.positive_hit_rate(roles.scored_orders(spark, sf), ["segment"])
    return out.select("segment", "predicted_positive", r6("hit_rate"))
