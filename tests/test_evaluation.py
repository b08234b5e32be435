"""Metrics, quantiles, ranking, backtest and explanation against brute force."""

import datetime as dt
import math
import random
import threading

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions import rolling
from panelloom.operators import backtest as bt
from panelloom.operators import explain as E
from panelloom.operators import joins
from panelloom.operators import metrics as M
from panelloom.operators import models as ml
from panelloom.operators import profiles as P
from panelloom.operators import quality as Q
from panelloom.operators import ranking as rk
from panelloom.operators import splits

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def brute_auc(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_ties_one_class_and_unknown(frame):
    rows = [("m", True, 0.5), ("m", False, 0.5), ("m", True, 0.9), ("m", False, None), ("one", True, 0.3), ("one", None, 0.1)]
    got = {r.k: r for r in M.roc_auc(frame("k string, label boolean, prob double", rows), ["k"]).collect()}
    assert got["m"].auc == 0.75 and got["one"].auc is None and got["one"].positives == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.sampled_from([0.0, 0.1, 0.25, 0.2500001, 0.5, 0.75, 1.0])), min_size=1, max_size=40))
def test_auc_equals_all_pairs_and_mirrors(spark, rows):
    df = spark.createDataFrame(rows, "label boolean, prob double")
    want = brute_auc(rows)
    got = M.roc_auc(df).first().auc
    assert (got is None) == (want is None)
    if want is not None:
        mirrored = M.roc_auc(df.withColumn("prob", 1 - F.col("prob"))).first().auc
        area = M.trapezoid_auc(df).first().auc
        assert math.isclose(got, want) and math.isclose(mirrored, 1 - want, abs_tol=1e-12) and math.isclose(area, want)


def test_close_scores_inside_one_inner_band(frame):
    rng = random.Random(5)
    rows = [(rng.random() < 0.5, 0.5 + rng.random() * 1e-8) for _ in range(300)]
    got = M.roc_auc(frame("label boolean, prob double", rows)).first().auc
    assert math.isclose(got, brute_auc(rows))


def test_bootstrap_equals_pooling_the_drawn_folds(frame):
    rng = random.Random(2)
    rows = [(f, rng.random() < 0.4, round(rng.random(), 2)) for f in range(3) for _ in range(30)]
    df = frame("fold int, label boolean, prob double", rows)
    stats = M.fold_pair_statistics(df, "fold", 3)
    draws = {r.draw: r.auc for r in M.bootstrap_auc(stats, 3, draws=20, seed=9).collect()}
    from panelloom.functions.scalars import hash_slot

    slots = df.sparkSession.range(20).select(
        F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot")
    ).withColumn("f", hash_slot(9, 3, F.col("draw"), F.col("slot")))
    picked = {}
    for r in slots.collect():
        picked.setdefault(r.draw, []).append(r.f)
    for draw, folds in picked.items():
        pooled = [(y, p) for f in folds for g, y, p in rows if g == f]
        assert math.isclose(draws[draw], brute_auc(pooled))


def test_report_zero_division(frame):
    df = frame("label boolean, pred boolean", [(False, False), (False, False)])
    row = M.classification_report(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_segment_report_equals_its_parts(frame):
    rng = random.Random(8)
    rows = [(rng.choice("xyz"), rng.random() < 0.5, round(rng.random(), 2)) for _ in range(200)]
    df = frame("k string, label boolean, prob double", rows)
    whole = {r.k: r for r in M.segment_report(df, ["k"]).collect()}
    parts = {r.k: r for r in M.classification_report(df.withColumn("pred", M.classify(F.col("prob"))), ["k"]).collect()}
    aucs = {r.k: r.auc for r in M.roc_auc(df, ["k"]).collect()}
    for k, row in whole.items():
        assert (row.tp, row.fp, row.tn, row.fn) == (parts[k].tp, parts[k].fp, parts[k].tn, parts[k].fn)
        assert math.isclose(row.auc, aucs[k]) and math.isclose(row.f1, parts[k].f1)


def test_exact_quantiles_beyond_the_sketch(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, 1.0, rng.gauss(0, 100)]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = {r.prob: r.quantile for r in P.exact_quantiles(df, ["v"], probs, accuracy=200).collect()}
    values.sort()
    for p in probs:
        rank = p * (len(values) - 1)
        low, high = values[math.floor(rank)], values[math.ceil(rank)]
        assert math.isclose(got[p], low + (high - low) * (rank - math.floor(rank)), abs_tol=1e-9), p


def test_quantiles_of_tiny_columns(frame):
    df = frame("v double, w double", [(3.0, None), (1.0, 5.0), (None, None), (2.0, None)])
    got = {(r.column, r.prob): r.quantile for r in P.exact_quantiles(df, ["v", "w"], [0.5, 0.95]).collect()}
    assert got["v", 0.5] == 2.0 and math.isclose(got["v", 0.95], 2.9) and got["w", 0.95] == 5.0


def test_banded_rank_equals_plain_rank(frame):
    rng = random.Random(6)
    rows = [(day(d), f"a{i:03d}", rng.choice([None, 0.5, round(rng.random(), 3)])) for d in range(3) for i in range(200)]
    df = frame("signal_date date, asset string, prob double", rows)
    banded = {(r.signal_date, r.asset): r["rank"] for r in rk.rank_by_score(df, bands=16).collect()}
    plain = {(r.signal_date, r.asset): r["rank"] for r in rk.rank_by_score(df, bands=1).collect()}
    assert banded == plain


def test_top_pick_ties_go_to_the_smaller_key(frame):
    rows = [(day(0), "b", 0.7, True, 0.1), (day(0), "a", 0.7, False, 0.2), (day(0), "c", 0.1, True, 0.3)]
    row = rk.top_picks(frame("signal_date date, asset string, prob double, target boolean, alpha double", rows)).first()
    assert (row.picked_asset, row.beat_benchmark, row.was_best, row.candidates) == ("a", False, False, 3)


def brute_hysteresis(rows, delta):
    by = {}
    for d, a, p in rows:
        by.setdefault(d, {})[a] = p
    held, out = None, []
    for d in sorted(by):
        best = min(by[d], key=lambda a: (-by[d][a], a))
        if held is None or (held in by[d] and by[d][best] - by[d][held] > delta):
            held, switched = best, True
        else:
            switched = False
        out.append((d, held, switched))
    return out


def test_hysteresis_equals_walking_the_dates(frame):
    rng = random.Random(11)
    rows = [(day(7 * d), a, rng.randrange(100) / 100) for d in range(80) for a in "abcd" if rng.random() < 0.9]
    df = frame("signal_date date, asset string, prob double", rows)
    for delta in (0.0, 0.25, 0.6):
        got = sorted((r.signal_date, r.held_asset, r.switched) for r in bt.hysteresis(df, delta).collect())
        assert got == brute_hysteresis(rows, delta)


def test_chain_of_100000_dates_is_doubled(spark):
    """A pointer to the next date but one, and one that ends: 17 rounds instead of 100,000 steps; no list of dates."""
    n = 100_000
    to = F.when(F.col("d") < n - 3, F.col("d") + F.when(F.col("d") % 10 == 4, 3).otherwise(2))
    table = spark.range(n).select(F.col("id").alias("d")).withColumn("to", to)
    found = bt.chain(table, "d", "to")
    want, at = set(), 0
    while at is not None:
        want.add(at)
        at = (at + (3 if at % 10 == 4 else 2)) if at < n - 3 else None
    assert {r.d for r in found.collect()} == want
    assert "collect_list" not in found._jdf.queryExecution().toString()


def plain_curve(rows):
    """Points by falling score, and those that are no inner point of a straight line, from integer counts."""
    scores = sorted({p for y, p in rows if y is not None and p is not None}, reverse=True)
    steps = [(s, sum(y and p == s for y, p in rows if y is not None), sum(not y and p == s for y, p in rows if y is not None)) for s in scores]
    pos, neg, cp, cn, points, kept = sum(s[1] for s in steps), sum(s[2] for s in steps), 0, 0, [], []
    for i, (score, p, n) in enumerate(steps):
        cp, cn = cp + p, cn + n
        points.append((score, cp / pos, cn / neg))
        if i in (0, len(steps) - 1) or p * steps[i + 1][2] != n * steps[i + 1][1]:
            kept.append(points[-1])
    return points, kept


def test_curves_and_areas_with_and_without_bands(frame, monkeypatch):
    rng = random.Random(12)
    rows = [(rng.random() < 0.4 if rng.random() < 0.95 else None, rng.choice([rng.randrange(60) / 60, 0.5, None])) for _ in range(400)]
    rows += [(True, 0.991 + i / 1e4) for i in range(9)] + [(False, -0.1 - i / 1e4) for i in range(9)] + [(y, 0.9 + i / 1e4) for i in range(9) for y in (True, False)]
    df = frame("label boolean, prob double", rows)
    points, kept = plain_curve(rows)
    assert len(kept) < len(points) - 15
    area = sum((b[2] - a[2]) * (b[1] + a[1]) / 2 for a, b in zip([(0, 0, 0), *kept], kept))
    for most in (1_000_000, 0):
        monkeypatch.setattr(M, "ONE_TASK", most)
        for thinned, want in ((False, points), (True, kept)):
            got = sorted((tuple(r) for r in M.roc_curve(df, thinned=thinned).collect()), reverse=True)
            assert [g[0] for g in got] == [w[0] for w in want] and all(abs(x - y) < 1e-12 for g, w in zip(got, want) for x, y in zip(g, w))
        assert abs(M.roc_auc(df).first().auc - area) < 1e-12 and abs(M.trapezoid_auc(df).first().auc - area) < 1e-12


def test_yearly_folds_reach_the_last_date(frame):
    df = frame("date date", [(day(i),) for i in range(0, 2000, 30)])
    folds = splits.yearly_folds(df, train_years=2)
    assert folds[0]["train_end"][:4] == str(int(folds[0]["fold"]) - 1) and folds[-1]["eval_end"] >= str(day(1980)) and len(folds) == int(folds[-1]["fold"]) - int(folds[0]["fold"]) + 1
    assert splits.yearly_folds(df.limit(0)) == []


def test_the_winners_of_the_first_round_are_fitted_together(frame):
    rng = random.Random(3)
    rows = [(i, a := rng.random(), b := rng.random(), rng.random(), 0.0, a + b > 1) for i in range(400)]
    df = frame("i int, a double, b double, c double, base double, label boolean", rows)
    sets = {"baseline": ["base"], **{f"plus_{f}": ["base", f] for f in "abc"}}
    found = {r.feature_set: r for r in ml.ablation_rounds(df.where("i < 250"), df.where("i >= 250"), sets, ml.fit_logistic, "baseline", {f"plus_{f}": f for f in "abc"}).collect()}
    gained = [f for f in "abc" if found[f"plus_{f}"].delta_auc > 0]
    assert {"a", "b"} <= set(gained) and found["winners"].n_features == 1 + len(gained)
    assert found["winners"]["rank"] == 1 and found["baseline"].delta_auc == 0 and found["winners"].delta_auc > found["plus_a"].delta_auc


def periods_frame(frame, rows):
    return frame("signal_date date, asset string, prob double, period_return double", rows)


def test_weights_cash_week_and_bounds(frame):
    rows = [(day(0), "a", 0.6, 0.1), (day(0), "b", 0.58, 0.0), (day(7), "a", 0.1, 0.2), (day(7), "b", 0.2, None)]
    w = bt.weights(periods_frame(frame, rows))
    sums = {(r.strategy, r.signal_date): r.s for r in w.groupBy("strategy", "signal_date").agg(F.sum("weight").alias("s")).collect()}
    assert sums["threshold", day(0)] == 1.0 and sums["threshold", day(7)] == 0.0
    assert all(0 <= s <= 1 + 1e-12 for s in sums.values()) and len(sums) == 10
    gross = {(r.strategy, r.signal_date): r.gross_return for r in bt.portfolio_returns(w, periods_frame(frame, rows)).collect()}
    assert gross["top1", day(7)] == 0.0 and math.isclose(gross["equal_weight", day(7)], 0.1)


def test_turnover_first_period_and_unchanged_holding(frame):
    rows = [("s", day(0), "a", 0.0), ("s", day(7), "a", 1.0), ("s", day(14), "a", 1.0), ("s", day(21), "b", 1.0)]
    w = frame("strategy string, signal_date date, asset string, weight double", rows)
    one = [r.turnover for r in bt.turnover(w).orderBy("signal_date").collect()]
    actual = [r.turnover for r in bt.turnover(w, "actual").orderBy("signal_date").collect()]
    assert one == [1.0, 0.5, 0.0, 1.0] and actual == [0.0, 0.5, 0.0, 1.0]


def test_buy_and_hold_equals_per_asset_capital(frame):
    rows = [(day(0), "a", 0.5, 0.1), (day(0), "b", 0.5, -0.5), (day(7), "a", 0.5, 0.2), (day(14), "b", 0.5, 1.0), (day(14), "a", 0.5, None)]
    got = [r.capital for r in bt.buy_and_hold(periods_frame(frame, rows), 100.0).orderBy("signal_date").collect()]
    assert all(math.isclose(x, y) for x, y in zip(got, [80.0, 91.0, 116.0]))


def test_curve_metrics_on_a_known_curve(frame):
    curve = frame(
        "scenario string, strategy string, signal_date date, net_return double, cumulative_return double",
        [("z", "s", day(0), 0.0, 0.0), ("z", "s", day(7), 0.1, 0.1), ("z", "s", day(365), -0.1, -0.01)],
    )
    bench = frame(
        "signal_date date, bench_period_return double, cumulative_return double",
        [(day(0), 0.0, 0.0), (day(7), 0.0, 0.0), (day(365), 0.0, 0.0)],
    )
    row = bt.performance(curve, bench).first()
    assert math.isclose(row.max_drawdown, -0.1) and math.isclose(row.total_return, -0.01)
    assert math.isclose(row.cagr, 0.99 ** (365.25 / 365) - 1) and math.isclose(row.share_above_benchmark, 1 / 3)


def test_break_even_rate_uses_the_first_failure(frame):
    grid = frame("strategy string, rate double, total_return double", [("s", 0.0, 0.3), ("s", 0.1, 0.2), ("s", 0.2, 0.05), ("s", 0.3, 0.2), ("w", 0.0, 0.0)])
    got = {r.strategy: (r.first_failing_rate, r.break_even_rate) for r in bt.break_even_rate(grid, F.lit(0.1)).collect()}
    assert got == {"s": (0.2, 0.1), "w": (0.0, None)}


def test_range_compound_ends_included_and_open_period(frame):
    series = frame("date date, r double", [(day(i), None if i == 0 else 0.1) for i in range(6)])
    periods = frame("start_date date, end_date date", [(day(1), day(3)), (day(0), day(0)), (None, None)])
    got = {r.start_date: r.bench_period_return for r in joins.range_compound(periods, series, "r").collect()}
    assert math.isclose(got[day(1)], 1.1**3 - 1) and got[day(0)] == 0.0 and got[None] is None


def test_permutation_is_a_rearrangement(spark):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("v"))
    out = E.permuted(df, "v", ["id"], bucket_rows=125)
    values = [r.v for r in out.collect()]
    assert sorted(values) == [float(i) for i in range(500)]
    assert out.where("v <> id").count() > 400


def test_example_rows_and_local_top(frame):
    rows = [(1, 0.9, True), (2, 0.95, False), (3, 0.51, True), (4, 0.2, True), (5, 0.45, False)]
    got = {r.example: r["row"] for r in E.example_rows(E.outcome_flags(frame("row_id int, prob double, label boolean", rows))).collect()}
    assert got == {"correct_high": 1, "incorrect_high": 2, "borderline_tp": 3, "borderline_tn": 5, "confident_fp": 2, "confident_fn": 4}
    attr = frame("row_id int, feature string, value double, contribution double", [(1, "x", 0.0, 0.3), (1, "y", 0.0, -0.2), (1, "z", 0.0, 0.1)])
    top = {(r.side, r.place): r.feature for r in E.local_top(attr, 1).collect()}
    assert top == {("raises", 1): "x", ("lowers", 1): "y"}


def test_version_decision_and_composite(frame):
    rows = [("f1", "a", 0.60), ("f1", "b", 0.63), ("f2", "a", 0.61), ("f2", "b", 0.62), ("f3", "a", 0.62), ("f3", "b", 0.62)]
    row = ml.version_decision(frame("fold string, version string, auc double", rows), "a", "b").first()
    assert (row.folds_won_b, row.folds_won_a, row.folds_tied, row.decision) == (2, 0, 1, "adopt")
    res = frame("setting int, fold string, auc double, rows int", [(1, "x", 0.6, 10), (1, "y", 0.6, 30), (2, "x", 0.5, 10), (2, "y", 0.7, 30)])
    out = ml.composite_score(ml.summarise_folds(res)).orderBy("rank").collect()
    assert [r.setting for r in out] == [1, 2] and math.isclose(out[1].weighted_auc, 0.65)


def test_drawn_settings_cover_the_grid_and_repeat(spark):
    grid = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    rows = [tuple(r) for r in ml.draw_settings(spark, grid, 6).collect()]
    assert {r[1:] for r in rows} == {(a, b) for a in (1, 2, 3) for b in (0.1, 0.2)}
    assert rows == [tuple(r) for r in ml.draw_settings(spark, grid, 6).collect()]


def test_quality_reports(frame):
    df = frame("k int, v double", [(1, 1.0), (1, None), (2, -3.0)])
    got = {(r.check, r.key): (r.value, r.passed) for r in Q.stack([
        Q.critical_nulls(df, ["k", "v"]),
        Q.duplicate_key_check(df, ["k"]),
        Q.domain(df, {"v": (0, 1)}),
        Q.row_count_preserved(df, df.where("k = 1")),
    ]).collect()}
    assert got == {
        ("null", "k"): (0.0, True), ("null", "v"): (1.0, False), ("duplicate_key", "k"): (1.0, False),
        ("domain", "v"): (1.0, False), ("row_count", "rows"): (-1.0, False),
    }


def test_models_learn_a_separable_rule(spark):
    df = spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 7 == 0, None).otherwise(F.lit(1.0)).alias("gap"),
        (F.col("id") % 20 >= 10).alias("label"),
    )
    for fit in (ml.fit_logistic, lambda d, f: ml.fit_forest(d, f, numTrees=5, maxDepth=3), lambda d, f: ml.fit_boosted(d, f, maxIter=3, maxDepth=2)):
        model = fit(df, ["x", "gap"])
        assert ml.evaluate(ml.score(model, df, ["x", "gap"])).first().auc > 0.99


def test_search_prepares_a_fold_once_for_all_settings(spark):
    """Each setting scores as a fit of its own; what the settings share is done once per fold, and its rows are released."""
    df = spark.range(300).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 20 * 1.0).alias("x"), (F.hash("id") % 5).cast("double").alias("y"),
        ((F.col("id") % 20 >= 10) == (F.hash("id", F.lit(1)) % 4 != 0)).alias("label"),
        F.explode(F.array(F.lit("1"), F.lit("2"))).alias("fold"),
        F.when(F.col("id") % 3 == 0, "eval").otherwise("train").alias("role"),
    )
    prepared = []

    def fits(train, features, label):
        prepared.append(train.first().fold)
        return ml.boosted_fits(train, features, label)

    chosen = [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 3, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 4}]
    found = {(r.setting, r.fold): (r.auc, r.rows) for r in ml.search(df, ["x", "y"], chosen, fits, fold_names=["1", "2"]).collect()}
    assert sorted(prepared) == ["1", "2"] and len(found) == 6
    for number, params in enumerate(chosen):
        train, held = (df.where(f"fold = '1' and role = '{role}'") for role in ("train", "eval"))
        alone = ml.evaluate(ml.score(ml.fit_boosted(train, ["x", "y"], **params), held, ["x", "y"])).first()
        assert found[number, "1"] == found[number, "2"] == (alone.auc, alone.rows)
    part = df.where(F.col("fold") == "1")
    assert not part.where(F.col("role") == "train").storageLevel.useMemory and not part.where(F.col("role") == "eval").storageLevel.useMemory


def test_runs_are_under_way_on_all_cores(spark):
    """Eight runs that wait for each other end only if they run at the same time."""
    meet = threading.Barrier(8)

    def run():
        meet.wait(60)
        return spark.range(2)

    out = ml.score_runs([({"run": i}, run) for i in range(8)]).collect()
    assert sorted((r.run, r.id) for r in out) == [(i, j) for i in range(8) for j in range(2)]


def test_walk_forward_scores_only_out_of_sample_dates(frame):
    rng = random.Random(3)
    rows = [(a, day(i), float(i % 5), rng.random() < 0.5) for i in range(60) for a in "ab"]
    df = frame("asset string, date date, x double, label boolean", rows)
    plan = frame(
        "signal_date date, model_id string, purged_end date",
        [(day(10), "m1", day(20)), (day(30), "m1", day(20)), (day(50), "m2", day(40))],
    )
    from functools import partial

    out = ml.walk_forward(df, plan, ["x"], partial(ml.fit_logistic, maxIter=5)).collect()
    assert {(r.signal_date, r.model_id) for r in out} == {(day(30), "m1"), (day(50), "m2")}
    assert sorted(r["rank"] for r in out) == [1, 1, 2, 2]


def test_feature_vector_keeps_the_gaps(frame):
    df = frame("asset string, x double, n int, flag boolean, label boolean", [("a", None, 2, True, False)])
    names = ml.feature_columns(df, ["asset", "label"])
    values = ml.assemble(df, names).first().features.toArray().tolist()
    assert names == ["x", "n", "flag"] and math.isnan(values[0]) and values[1:] == [2.0, 1.0]


def test_one_order_of_scores_everywhere(frame):
    nan, inf = float("nan"), float("inf")
    draw = random.Random(3)
    rows = [("2024-01-02", "a", 0.5), ("2024-01-02", "b", None), ("2024-01-02", "c", 0.9), ("2024-01-02", "d", nan), ("2024-01-02", "e", -5.0), ("2024-01-02", "f", 0.9)]
    rows += [("2024-01-09", a, s) for a, s in zip("abcdef", [None, nan, None, -3.0, -3.0, -inf])]
    rows += [("2024-01-16", a, s) for a, s in zip("abcdef", [None, nan, None, None, nan, None])]
    rows += [("2024-01-23", f"z{i:03}", draw.choice([None, nan, 1e-7, 2e-7, draw.random() * 1e-6, 7.0])) for i in range(200)]
    df = frame("signal_date string, asset string, prob double", rows, ["signal_date"])

    def place(row):
        unknown = row[2] is None or row[2] != row[2]
        return unknown, 0 if unknown else -row[2], row[1]

    want = {}
    for date in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == date), key=place), 1):
            want[date, r[1]] = i
    for bands in (1, 2, 7, 64):
        assert {(str(r.signal_date), r.asset): r["rank"] for r in rk.rank_by_score(df, bands=bands).collect()} == want
    best = {date: min((r for r in rows if r[0] == date), key=place) for date in {r[0] for r in rows}}
    best = {date: r[1] for date, r in best.items() if not place(r)[0]}
    full = df.selectExpr("*", "true AS target", "0.1D AS alpha")
    assert {str(r.signal_date): r.picked_asset for r in rk.top_picks(full).collect()} == best
    held = bt.weights(df).where("weight > 0").collect()
    assert {str(r.signal_date): r.asset for r in held if r.strategy == "top1"} == best
    assert {r.asset for r in held if r.strategy == "top2" and str(r.signal_date) == "2024-01-02"} == {"c", "f"}
    assert {str(r.signal_date): r.held_asset for r in bt.hysteresis(df.where("signal_date < '2024-01-20'"), 0.01).collect()} == {"2024-01-02": "c", "2024-01-09": "c", "2024-01-16": "c"}
    assert {str(r.signal_date): (r.best, r.second) for r in rk.score_gap(df).collect()}["2024-01-02"] == (0.9, 0.9)


def test_rank_statistics_leave_unknown_scores_out(frame):
    nan = float("nan")
    rows = [(True, nan), (False, 0.2), (True, 0.7), (False, 0.9), (True, None), (None, 0.1)]
    df = frame("label boolean, prob double", rows)
    assert M.roc_auc(df).first().auc == 0.5
    assert M.trapezoid_auc(df).first().auc == 0.5


def test_rank_statistics_of_crowded_scores(frame):
    draw = random.Random(9)
    rows = [(draw.random() < 0.4, draw.choice([draw.random() * 1e-6, 1e-7, 2.5])) for _ in range(3000)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = frame("label boolean, prob double", rows)
    assert abs(M.roc_auc(df).first().auc - want) < 1e-12 and abs(M.trapezoid_auc(df).first().auc - want) < 1e-9
    assert M.roc_auc(df.limit(0)).count() == 1


def test_a_bad_value_stays_in_its_frames(frame):
    nan = float("nan")
    for bad in (nan, float("inf"), 1e17, -1e17):
        values = [1.0 + (i % 5) / 7 for i in range(30)]
        values[4] = bad
        df = frame("asset string, date string, close double", [("a", f"2024-01-{i + 1:02}", v) for i, v in enumerate(values)], ["date"])
        fr = rolling.Frames(Window.partitionBy("asset").orderBy("date"))
        mean = rolling.moving_average(fr, F.col("close"), 3)
        got = [r.m for r in fr.select(df, mean.alias("m")).orderBy("date").collect()]
        for i in range(7, 30):
            assert abs(got[i] - sum(values[i - 2 : i + 1]) / 3) < 1e-12
        fr = rolling.Frames(Window.partitionBy("asset").orderBy("date"))
        growth = rolling.trailing_compound(fr, F.col("close") / 100, 5)
        got = [r.g for r in fr.select(df, growth.alias("g")).orderBy("date").collect()]
        for i in range(10, 30):
            want = 1.0
            for v in values[i - 5 : i]:
                want *= 1 + v / 100
            assert abs(got[i] - (want - 1)) < 1e-12


def test_local_top_of_a_long_table_is_not_aggregated_before_its_shuffle(frame):
    rows = [(i, f, 1.0 * j, (i * 7 + j * 3) % 5 - 2.0) for i in range(40) for j, f in enumerate("wxyz")]
    rows += [(3, "w", 0.0, 9.0)] * 2 + [(None, "x", 1.0, 0.5), (None, "y", None, None)]
    attr = frame("row_id int, feature string, value double, contribution double", rows)
    top = E.local_top(attr, 2)
    text = top._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and text.count("Exchange") == 1
    got = sorted(((r.row_id, r.side, r.place, r.feature, r.contribution) for r in top.where("row_id is not null").collect()))
    want = []
    for i in range(40):
        cells = [(c, f) for r, f, _, c in rows if r == i]
        for side, order in (("raises", sorted(cells, key=lambda x: (-x[0], x[1]))), ("lowers", sorted(cells))):
            want += [(i, side, place, f, c) for place, (c, f) in enumerate(order[:2], 1)]
    assert got == sorted(want) and top.where("row_id is null").count() == 4
