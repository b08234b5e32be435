"""Model queries (survey ids ML*) on features of the return panel, and their result tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from panelloom.operators import calendar as cal
from panelloom.operators import explain as E
from panelloom.operators import metrics as M
from panelloom.operators import models as ml
from panelloom.operators import splits
from panelloom.operators.profiles import union_labelled
from panelloom.queries import roles, tables
from panelloom.queries.joining import schedule
from panelloom.queries.measuring import auc_sql
from panelloom.queries.registry import query, sql
from panelloom.queries.splitting import folds as yearly_folds
from panelloom.queries.windows import r6
from panelloom.sources.tables import materialise

FEATURES = roles.FEATURES
#: settings drawn from the grid
SEARCH_DRAWS = 100


def _boosted_fits(train, features, label="label"):
    """Boosted fits in full settings, stopped early by the last tenth of the training dates."""
    first, last = train.agg(F.min("date"), F.max("date")).first()
    tail = F.col("date") > F.lit(last - (last - first) / 10)
    return ml.boosted_fits(train, features, label, validation=tail)


def _boosted(train, features, label="label", **params):
    return _boosted_fits(train, features, label)(**params)


def _logistic_fits(train, features, label="label"):
    return partial(ml.fit_logistic, train, features, label)


def _frame(spark, sf):
    """Feature rows as a written table: an iterative fit reads them many times."""
    return materialise(roles.features_frame(roles.market(spark, sf)), "features")


def _split(spark, sf):
    frame = splits.temporal_split(_frame(spark, sf), "date", "1998-12-31", "1999-12-31")
    return {name: frame.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}


@query("ml1_feature_vector")
def ml1(spark, sf):
    frame = roles.features_frame(roles.market(spark, sf))
    names = ml.feature_columns(frame, ["asset", "date", "label", "target_alpha_7d", "total_return", "prob"])
    return ml.assemble(frame, names).select("asset", "date", F.col("features").cast("string").alias("features"))


@query("ml2_logistic_regression")
def ml2(spark, sf):
    part = _split(spark, sf)
    model = ml.fit_logistic(part["train"], FEATURES)
    return ml.coefficients(model, FEATURES, part["train"])


@query("ml3_random_forest")
def ml3(spark, sf):
    part = _split(spark, sf)
    model = ml.fit_forest(part["train"], FEATURES)
    return ml.importances(model, FEATURES, part["train"])


@query("ml4_boosted_trees")
def ml4(spark, sf):
    part = _split(spark, sf)
    tail = F.col("date") > "1998-06-30"
    reports = {}
    for name, values in (("baseline", ml.BOOSTED), ("tuned", ml.TUNED)):
        model = ml.fit_boosted(part["train"], FEATURES, validation=tail, settings=values)
        reports[name] = ml.evaluate(ml.score(model, part["test"].drop("prob"), FEATURES), ["asset"])
    return union_labelled(reports, "settings")


@query("ml5_temporal_search")
def ml5(spark, sf):
    frame, years = _frame(spark, sf).drop("prob"), yearly_folds(spark, sf)
    folds = materialise(splits.eval_gap(splits.expanding_folds(frame, "date", years), 7), "folds")
    # The searched grid, all axes that these trees have.
    grid = {
        "maxDepth": [4, 5, 6, 7],
        "stepSize": [0.03, 0.05, 0.07, 0.1],
        "maxIter": [100, 150, 200],
        "subsamplingRate": [0.6, 0.7, 0.8, 0.9],
        "featureSubsetStrategy": ["0.6", "0.8", "all"],
        "minInstancesPerNode": [1, 5, 10],
        "minInfoGain": [0.0, 0.001, 0.01],
        "maxBins": [32, 64],
    }
    drawn = ml.draw_settings(spark, grid, SEARCH_DRAWS, seed=42)
    settings = [r.asDict() for r in drawn.drop("setting").collect()]
    results = ml.search(folds, FEATURES, settings, _boosted_fits, fold_names=[f["fold"] for f in years])
    return ml.composite_score(ml.summarise_folds(results))


_VARIANTS = {"a": 7919, "b": 104729, "c": 1299709, "d": 15485863}

_VARIANT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS setting, CAST(year(o_orderdate) AS INTEGER) AS fold, ((o_orderkey * {mult}) % 1000) / 1000e0 AS prob, o_totalprice > 250000 AS label, '{name}' || year(o_orderdate) AS g FROM orders"
    for name, mult in _VARIANTS.items()
)

_RESULTS_SQL = f"""WITH scored AS ({_VARIANT_SQL}),
results AS (SELECT substr(k, 1, 1) AS setting, CAST(substr(k, 2) AS INTEGER) AS fold, auc, p + n AS rows FROM ({auc_sql('g')}))"""


def _variant_results(spark, sf):
    """AUC per (setting, fold) of four scores of every order; folds are order years."""
    key = F.col("o_orderkey")
    scores = F.explode(
        F.array(*[F.struct(F.lit(n).alias("setting"), (key * m % 1000 / 1000.0).alias("prob")) for n, m in _VARIANTS.items()])
    )
    scored = roles.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("fold"), (F.col("o_totalprice") > 250000).alias("label"), scores.alias("s")
    ).select("fold", "label", "s.setting", "s.prob")
    auc = M.roc_auc(scored, ["setting", "fold"])
    return auc.select("setting", "fold", "auc", (F.col("positives") + F.col("negatives")).alias("rows"))


@query(
    "ml5_composite_score",
    f"""{_RESULTS_SQL},
s AS (SELECT setting, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, min(auc) AS min_auc, max(auc) AS max_auc, sum(auc * rows) / sum(rows) AS weighted_auc, count(*) AS folds FROM results GROUP BY 1),
c AS (SELECT *, (std_auc - min(std_auc) OVER ()) / (max(std_auc) OVER () - min(std_auc) OVER ()) AS std_norm FROM s),
d AS (SELECT *, 0.7e0 * mean_auc + 0.02e0 * (1 - std_norm) + 0.1e0 * min_auc AS composite FROM c)
SELECT setting, round(mean_auc, 6) + 0e0 AS mean_auc, round(std_auc, 6) + 0e0 AS std_auc, round(min_auc, 6) + 0e0 AS min_auc, round(max_auc, 6) + 0e0 AS max_auc, round(weighted_auc, 6) + 0e0 AS weighted_auc,
       folds, round(std_norm, 6) + 0e0 AS std_norm, round(composite, 6) + 0e0 AS composite, row_number() OVER (ORDER BY composite DESC, setting) AS rank FROM d""",
)
def ml5_composite(spark, sf):
    df = ml.composite_score(ml.summarise_folds(_variant_results(spark, sf)))
    exact = ("setting", "folds", "rank")
    return df.select(*[c if c in exact else r6(c) for c in df.columns])


@query("ml6_feature_ablation")
def ml6(spark, sf):
    part = _split(spark, sf)
    base, others = FEATURES[:3], FEATURES[3:]
    sets = {"baseline": base, **{f"plus_{f}": [*base, f] for f in others}, "all": FEATURES, "without_benchmark": [f for f in FEATURES if not f.startswith("bench")]}
    return ml.ablation_rounds(part["train"], part["val"].drop("prob"), sets, _boosted, "baseline", {f"plus_{f}": f for f in others})


@query(
    "ml6_ablation_table",
    f"""{_RESULTS_SQL}
SELECT setting AS feature_set, round(auc, 6) + 0e0 AS auc, round(auc - max(CASE WHEN setting = 'a' THEN auc END) OVER (), 6) + 0e0 AS delta_auc, row_number() OVER (ORDER BY auc DESC, setting) AS rank
FROM (SELECT setting, avg(auc) AS auc FROM results GROUP BY 1)""",
)
def ml6_table(spark, sf):
    means = _variant_results(spark, sf).groupBy(F.col("setting").alias("feature_set")).agg(F.avg("auc").alias("auc"))
    return ml.ablation_table(means, "a").select("feature_set", r6("auc"), r6("delta_auc"), "rank")


@query("ml7_walk_forward_scores")
def ml7(spark, sf):
    market = roles.market(spark, sf)
    frame = materialise(roles.features_frame(market), "features").drop("prob")
    calendar = materialise(cal.sessions(market.returns), "sessions")
    dates = cal.every_nth_session(calendar, 7).select(F.col("date").alias("signal_date"))
    plan = materialise(splits.retrain_plan(dates, calendar, schedule(spark, sf), 7), "plan")
    ranked = ml.walk_forward(frame, plan, FEATURES, ml.fit_logistic)
    return ranked.select("signal_date", "asset", "prob", "rank", "label", "model_id", "trained_to")


@query(
    "ml8_version_decision",
    f"""{_RESULTS_SQL},
w AS (SELECT fold, max(CASE WHEN setting = 'a' THEN auc END) AS a, max(CASE WHEN setting = 'b' THEN auc END) AS b FROM results GROUP BY 1),
f AS (SELECT avg(a) AS mean_a, avg(b) AS mean_b, avg(b) - avg(a) AS gain, stddev_samp(b) - stddev_samp(a) AS std_change, count(*) FILTER (b > a) AS folds_won_b, count(*) FILTER (a > b) AS folds_won_a, count(*) FILTER (a = b) AS folds_tied FROM w)
SELECT round(mean_a, 6) + 0e0 AS mean_a, round(mean_b, 6) + 0e0 AS mean_b, round(gain, 6) + 0e0 AS gain, round(std_change, 6) + 0e0 AS std_change, folds_won_b, folds_won_a, folds_tied,
       abs(gain) >= 0.01e0 AS gain_relevant, CASE WHEN std_change < 0 THEN 'more_stable' WHEN std_change < 0.01e0 THEN 'similar' ELSE 'less_stable' END AS stability,
       CASE WHEN gain >= 0.01e0 AND folds_won_b > folds_won_a THEN 'adopt' WHEN gain > 0 THEN 'consider' ELSE 'keep' END AS decision FROM f""",
)
def ml8(spark, sf):
    df = ml.version_decision(_variant_results(spark, sf).withColumnRenamed("setting", "version"), "a", "b")
    return df.select(*[r6(c) if c in ("mean_a", "mean_b", "gain", "std_change") else c for c in df.columns])


@query("ml8_feature_versions")
def ml8_versions(spark, sf):
    """The feature tables against each other: the same model and folds on v1 and v2."""
    results, years = None, yearly_folds(spark, sf)
    for version in ("v1", "v2"):
        table = tables.order_table(spark, sf, version).withColumnRenamed("target_7d", "label")
        names = ml.feature_columns(table, ["asset", "date", "label", "target_alpha_7d"])
        rows = table.withColumns({c: F.col(c).cast("double") for c in names})
        folds = materialise(splits.eval_gap(splits.expanding_folds(rows, "date", years), 7), "folds")
        found = ml.search(folds, names, [{}], _logistic_fits, fold_names=[f["fold"] for f in years])
        found = found.withColumn("version", F.lit(version))
        results = found if results is None else results.unionByName(found)
    return ml.version_decision(results, "v1", "v2")


@query(
    "ml8_leaderboard",
    f"""{_RESULTS_SQL} SELECT setting AS model, round(auc, 6) + 0e0 AS auc, row_number() OVER (ORDER BY auc DESC, setting) AS place FROM (SELECT setting, avg(auc) AS auc FROM results GROUP BY 1)""",
)
def ml8_board(spark, sf):
    means = _variant_results(spark, sf).groupBy(F.col("setting").alias("model")).agg(F.avg("auc").alias("auc"))
    return ml.leaderboard(means).select("model", r6("auc"), "place")


_IMP = "imp AS (SELECT feature, avg(abs(contribution)) AS importance FROM attr GROUP BY 1)"


@query(
    "ml9_importance_table",
    sql(
        "attr",
        f"WITH {_IMP} SELECT feature, round(importance, 6) + 0e0 AS importance, round(importance * 100 / sum(importance) OVER (), 6) + 0e0 AS share_pct, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp",
    ),
)
def ml9(spark, sf):
    table = ml.importance_table(E.global_importance(roles.attributions(spark, sf)).select("feature", "importance"))
    return table.select("feature", r6("importance"), r6("share_pct"), "rank")


@query(
    "ml9_importance_by_group",
    sql(
        "attr",
        f"""WITH {_IMP} SELECT CASE WHEN feature IN ('l_quantity', 'l_extendedprice') THEN 'size' ELSE 'rate' END AS feature_group, count(*) AS features,
       round(sum(importance) * 100 / (SELECT sum(importance) FROM imp), 6) + 0e0 AS total FROM imp GROUP BY 1""",
    ),
)
def ml9_groups(spark, sf):
    table = ml.importance_table(E.global_importance(roles.attributions(spark, sf)).select("feature", "importance"))
    return ml.importance_by_group(table, roles.GROUPS).select("feature_group", "features", r6("total"))


@query("ex9_permutation_importance")
def permutation(spark, sf):
    frame = _frame(spark, sf).where("label IS NOT NULL").drop("prob")
    filled = frame.fillna(0.0, subset=FEATURES)

    def score(df):
        lift = F.col("alpha_30d") - F.col("volatility_30d") + F.col("return_7d")
        return df.withColumn("prob", 1.0 / (1.0 + F.exp(-20.0 * lift)))

    return E.permutation_importance(filled, ["alpha_30d", "volatility_30d", "return_7d"], score, ["asset", "date"])
