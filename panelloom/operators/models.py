"""Distributed model fitting with MLlib, and the result tables around it.

Only the fitted model objects and the few rows of a results table live on the driver; feature
rows stay in DataFrames from scan to prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import prod

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.aggregates import weighted_mean
from panelloom.functions.scalars import band, hash_order
from panelloom.operators.metrics import segment_report
from panelloom.operators.ranking import rank_by_score
from panelloom.sources.tables import literal_table, materialise, scratch_dir

# Model settings.
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 10, "seed": 42}
BOOSTED = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}
TUNED = {"maxIter": 150, "maxDepth": 6, "stepSize": 0.07, "subsamplingRate": 0.7, "seed": 42}
#: model runs that one driver has under way at most
MOST_RUNS = 32


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """All numeric and boolean columns except ids and targets."""
    usable = {"double", "float", "int", "bigint", "boolean", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if c not in set(exclude) and t in usable]


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector; NULLs become NaN and stay visible to the caller."""
    numeric = df.withColumns({c: F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(numeric)


def _prepare(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.withColumns(
        {**{c: F.col(c).cast("double") for c in features}, "__label": F.col(label).cast("double")}
    )


def _stages(features: Sequence[str], scale: bool) -> list:
    filled = [f"__f_{c}" for c in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="__raw" if scale else "__features"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True))
    return stages


def balanced_weight(df: DataFrame, label: str = "label", out: str = "class_weight") -> DataFrame:
    """Weight n / (2 * rows of the class), so that both classes count the same."""
    counts = df.agg(
        F.struct(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")).alias("c")
    ).scalar()
    kept = df.where(F.col(label).isNotNull()).withColumn("__c", counts)
    total = F.col("__c.pos") + F.col("__c.neg")
    own = F.when(F.col(label), F.col("__c.pos")).otherwise(F.col("__c.neg"))
    return kept.withColumn(out, total / (2.0 * own)).drop("__c")


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", **params) -> PipelineModel:
    """Standardised logistic regression with balanced classes; imputation is fitted on train."""
    weighted = balanced_weight(_prepare(train, features, label), label)
    settings = {"maxIter": 100, "regParam": 0.0, **params}
    model = LogisticRegression(
        featuresCol="__features", labelCol="__label", weightCol="class_weight", standardization=False, **settings
    )
    return Pipeline(stages=[*_stages(features, scale=True), model]).fit(weighted)


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", **params) -> PipelineModel:
    weighted = balanced_weight(_prepare(train, features, label), label)
    model = RandomForestClassifier(
        featuresCol="__features", labelCol="__label", weightCol="class_weight", **{**FOREST, **params}
    )
    return Pipeline(stages=[*_stages(features, scale=False), model]).fit(weighted)


def fit_boosted(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    validation: Column | None = None,
    settings: dict = BOOSTED,
    **params,
) -> PipelineModel:
    """Gradient-boosted trees under BOOSTED or TUNED settings, single ones replaced by `params`;
    `validation` marks the tail of train used for early stopping."""
    return boosted_fits(train, features, label, validation, settings)(**params)


def boosted_fits(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    validation: Column | None = None,
    settings: dict = BOOSTED,
) -> Callable[..., PipelineModel]:
    """`fit_boosted` on one set of training rows, as a function of `params`: imputation is fitted once for all of them."""
    ready = _prepare(train.where(F.col(label).isNotNull()), features, label)
    extra = {}
    if validation is not None:
        ready = ready.withColumn("__validation", validation)
        extra = {"validationIndicatorCol": "__validation"}
    filling, assembling = _stages(features, scale=False)
    filled = filling.fit(ready)
    vectors = assembling.transform(filled.transform(ready))

    def fit(**params) -> PipelineModel:
        model = GBTClassifier(featuresCol="__features", labelCol="__label", **{**settings, **params}, **extra)
        return PipelineModel([filled, assembling, model.fit(vectors)])

    return fit


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str = "prob") -> DataFrame:
    """df plus the probability of the positive class."""
    numeric = df.withColumns({f"__in_{c}": F.col(c) for c in features}).withColumns(
        {c: F.col(c).cast("double") for c in features}
    )
    scored = model.transform(numeric).withColumn(out, vector_to_array(F.col("probability"))[1])
    restored = {c: F.col(f"__in_{c}") for c in features}
    return scored.withColumns(restored).select(*df.columns, out)


def coefficients(model: PipelineModel, features: Sequence[str], like: DataFrame) -> DataFrame:
    """(feature, coefficient, magnitude, rank) of a fitted logistic regression."""
    values = model.stages[-1].coefficients.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    table = literal_table(like.sparkSession, "feature string, coefficient double", rows)
    return rank_importance(table.withColumn("magnitude", F.abs("coefficient")), "magnitude")


def importances(model: PipelineModel, features: Sequence[str], like: DataFrame) -> DataFrame:
    """(feature, importance, share_pct, rank) of a fitted tree ensemble."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return importance_table(literal_table(like.sparkSession, "feature string, importance double", rows))


def rank_importance(table: DataFrame, by: str, name: str = "feature") -> DataFrame:
    w = Window.orderBy(F.col(by).desc(), name)
    return table.withColumn("rank", F.row_number().over(w).cast("long"))


def importance_table(table: DataFrame, name: str = "feature", value: str = "importance") -> DataFrame:
    """Adds share_pct of the total and the rank; one row per feature enters."""
    share = F.col(value) * 100.0 / F.nullif(F.sum(value).over(Window.partitionBy()), F.lit(0.0))
    return rank_importance(table.withColumn("share_pct", share), value, name)


def importance_by_group(table: DataFrame, groups: dict[str, Sequence[str]], value: str = "share_pct") -> DataFrame:
    """(feature_group, features, total) for the groups of a literal map."""
    pairs = [(f, g) for g, members in groups.items() for f in members]
    table_of = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    named = table.withColumn("feature_group", table_of[F.col("feature")])
    return named.where(F.col("feature_group").isNotNull()).groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("features"), F.sum(value).alias("total")
    )


def evaluate(scored: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """AUC and threshold metrics of scored rows, one row per key, from one pass over the rows."""
    return segment_report(scored, keys, label)


def draw_settings(spark, grid: dict[str, Sequence], draws: int, seed: int = 42) -> DataFrame:
    """`draws` settings of the grid in hash order of their number: (setting, one column each).

    The grid is numbered, not listed: a setting's values are read off its number, one digit per
    parameter.
    """
    total = prod(len(values) for values in grid.values())
    columns, stride = [], 1
    for name, values in grid.items():
        digit = F.floor(F.col("id") / stride) % len(values)
        columns.append(F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int")).alias(name))
        stride *= len(values)
    numbered = spark.range(total).select(F.col("id").alias("setting"), *columns)
    return numbered.orderBy(hash_order(seed, F.col("setting")), "setting").limit(draws)


def summarise_folds(results: DataFrame, keys: Sequence[str] = ("setting",), metric: str = "auc", weight: str = "rows") -> DataFrame:
    """Mean, population std, min, max and row-weighted mean of a metric over folds."""
    return results.groupBy(*keys).agg(
        F.avg(metric).alias("mean_auc"),
        F.stddev_pop(metric).alias("std_auc"),
        F.min(metric).alias("min_auc"),
        F.max(metric).alias("max_auc"),
        weighted_mean(F.col(metric), F.col(weight)).alias("weighted_auc"),
        F.count(F.lit(1)).alias("folds"),
    )


def composite_score(summary: DataFrame) -> DataFrame:
    """0.7 * mean + 0.02 * (1 - normalised std) + 0.1 * min, with its rank.

    One row per setting enters, so the whole-table windows are as long as the search.
    """
    everything = Window.partitionBy()
    low, high = F.min("std_auc").over(everything), F.max("std_auc").over(everything)
    normalised = (F.col("std_auc") - low) / F.nullif(high - low, F.lit(0.0))
    scored = summary.withColumn("std_norm", F.coalesce(normalised, F.lit(0.0))).withColumn(
        "composite",
        0.7 * F.col("mean_auc") + 0.02 * (1.0 - F.col("std_norm")) + 0.1 * F.col("min_auc"),
    )
    w = Window.orderBy(F.col("composite").desc(), summary.columns[0])
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def score_runs(runs: Sequence[tuple[dict, Callable[[], DataFrame]]], threads: int | None = None) -> DataFrame:
    """One written table with the rows of all runs, each under its literal key columns.

    A run fits a model and returns scored rows; several run at a time, as one fit has small jobs that follow each
    other and idle moments between them. Metrics over all runs are then one plan over one table, not a branch per run.
    """

    def write(number: int) -> str:
        keys, run = runs[number]
        scored = run()
        target = f"{scratch_dir(scored.sparkSession, 'runs')}"
        scored.select(*[F.lit(v).alias(k) for k, v in keys.items()], "*").write.parquet(target)
        return target

    spark = SparkSession.getActiveSession()
    return spark.read.parquet(*in_threads(write, range(len(runs)), threads))


def in_threads(do: Callable, items: Iterable, threads: int | None = None) -> list:
    """`do` of every item, in their order, under the caller's session: 4 to MOST_RUNS at a time, about two per core."""
    spark = SparkSession.getActiveSession()
    if threads is None:
        threads = min(max(4, 2 * spark.sparkContext.defaultParallelism), MOST_RUNS)
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(do), items))


def search(
    folds: DataFrame,
    features: Sequence[str],
    settings: Sequence[dict],
    fits: Callable,
    label: str = "label",
    fold: str = "fold",
    fold_names: Sequence[str] = (),
) -> DataFrame:
    """(setting, fold, auc, rows): every setting fitted on every fold's training rows.

    `fits(train, features, label)` does what all settings share, once per fold, and returns the fit of one setting.
    One fit per (setting, fold); each fit is a distributed job, and all metrics are one aggregate. The rows of a
    fold are kept in the executors' memory, or on their disks, until all its fits are done: a fit reads them many times.
    """

    def prepared(name: str) -> tuple[DataFrame, Callable]:
        part = folds.where(F.col(fold) == name)
        train, held = (part.where(F.col("role") == role).persist() for role in ("train", "eval"))
        kept.extend([train, held])
        return held, fits(train, features, label)

    def run(params: dict, name: str) -> Callable[[], DataFrame]:
        def scored() -> DataFrame:
            held, fit = shared[name]
            return score(fit(**params), held, features).select(label, "prob")

        return scored

    kept: list[DataFrame] = []
    try:
        shared = dict(zip(fold_names, in_threads(prepared, fold_names)))
        runs = [({"setting": number, "fold": name}, run(params, name)) for number, params in enumerate(settings) for name in fold_names]
        scored = score_runs(runs)
    finally:
        for rows in kept:
            rows.unpersist()
    return evaluate(scored, ["setting", "fold"], label).select("setting", "fold", "auc", "rows")


def ablation(
    train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], fit: Callable, baseline: str, label: str = "label"
) -> DataFrame:
    """(feature_set, n_features, auc, delta_auc, rank): each feature set against the baseline."""

    def run(features: Sequence[str]) -> Callable[[], DataFrame]:
        return lambda: score(fit(train, features, label), test, features).select(label, "prob")

    runs = [({"feature_set": name, "n_features": len(features)}, run(features)) for name, features in sets.items()]
    aucs = evaluate(score_runs(runs), ["feature_set", "n_features"], label).select("feature_set", "n_features", "auc")
    return ablation_table(aucs, baseline)


def winning_features(table: DataFrame, singles: dict[str, str]) -> list[str]:
    """Features whose own set (`singles`: set name to feature) gained over the baseline, best first; ties by set name."""
    gained = table.where((F.col("delta_auc") > 0) & F.col("feature_set").isin(*singles)).orderBy(F.col("delta_auc").desc(), "feature_set")
    return [singles[r.feature_set] for r in gained.select("feature_set").collect()]


def ablation_rounds(
    train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], fit: Callable, baseline: str, singles: dict[str, str], label: str = "label"
) -> DataFrame:
    """`ablation` of the sets, and of one more, `winners`: the baseline with every feature that gained on its own.

    The first round is written; its few names of winners come to the driver. Without a winner there is no second
    round. delta_auc and rank are against the same baseline over both rounds.
    """
    first = materialise(ablation(train, test, sets, fit, baseline, label), "ablation")
    won = winning_features(first, singles)
    if not won:
        return first
    features = [*sets[baseline], *won]
    second = ablation(train, test, {"winners": features}, fit, baseline, label)
    both = first.drop("delta_auc", "rank").unionByName(second.drop("delta_auc", "rank"))
    return ablation_table(both, baseline)


def ablation_table(results: DataFrame, baseline: str) -> DataFrame:
    """Adds delta_auc against the baseline row and the rank of each set."""
    base = F.max(F.when(F.col("feature_set") == baseline, F.col("auc"))).over(Window.partitionBy())
    w = Window.orderBy(F.col("auc").desc(), "feature_set")
    return results.select("*", (F.col("auc") - base).alias("delta_auc"), F.row_number().over(w).cast("long").alias("rank"))


def walk_forward(
    df: DataFrame, plan: DataFrame, features: Sequence[str], fit: Callable, label: str = "label", date: str = "date"
) -> DataFrame:
    """Scores every planned signal date with the model of its schedule row, then ranks.

    `plan` is (signal_date, model_id, purged_end), best a written table. Dates up to the end of
    their model's training are not out of sample and are left out. One fit per schedule row, not
    per date; the schedule is the short list the caller wrote, so its rows may come to the driver.
    """
    plan = plan.where(F.col("purged_end") < F.col("signal_date"))
    models = plan.select("model_id", "purged_end").distinct().orderBy("model_id").collect()

    def run(row) -> Callable[[], DataFrame]:
        def scored() -> DataFrame:
            model = fit(df.where(F.col(date) <= F.lit(row["purged_end"])), features, label)
            due = plan.where(F.col("model_id") == row["model_id"]).select(
                F.col("signal_date").alias(date), F.col("purged_end").alias("trained_to")
            )
            return score(model, df.join(due, date), features)

        return scored

    out = score_runs([({"model_id": row["model_id"]}, run(row)) for row in models])
    # One row per asset and signal date: a plain window per date, without a second scoring pass.
    return rank_by_score(out.withColumnRenamed(date, "signal_date"), bands=1)


def version_decision(fold_results: DataFrame, a: str, b: str, min_gain: float = 0.01) -> DataFrame:
    """One row comparing two versions over folds: gain, stability, folds won, decision."""
    wide = fold_results.groupBy("fold").agg(
        F.max(F.when(F.col("version") == a, F.col("auc"))).alias("a"),
        F.max(F.when(F.col("version") == b, F.col("auc"))).alias("b"),
    )
    facts = wide.agg(
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        (F.avg("b") - F.avg("a")).alias("gain"),
        (F.stddev_samp("b") - F.stddev_samp("a")).alias("std_change"),
        F.count_if(F.col("b") > F.col("a")).alias("folds_won_b"),
        F.count_if(F.col("a") > F.col("b")).alias("folds_won_a"),
        F.count_if(F.col("a") == F.col("b")).alias("folds_tied"),
    )
    return facts.select(
        "*",
        (F.abs("gain") >= min_gain).alias("gain_relevant"),
        band(F.col("std_change"), [0.0, 0.01], ["more_stable", "similar", "less_stable"]).alias("stability"),
        F.when((F.col("gain") >= min_gain) & (F.col("folds_won_b") > F.col("folds_won_a")), F.lit("adopt"))
        .when(F.col("gain") > 0, F.lit("consider"))
        .otherwise(F.lit("keep"))
        .alias("decision"),
    )


def leaderboard(results: DataFrame, by: str = "auc", name: str = "model") -> DataFrame:
    """Models ordered by a metric."""
    w = Window.orderBy(F.col(by).desc_nulls_last(), name)
    return results.withColumn("place", F.row_number().over(w).cast("long"))
