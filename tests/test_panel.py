"""Windows, joins and feature tables on hand-made panels and against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelloom.functions import rolling as R
from panelloom.keys import KEYS
from panelloom.operators import calendar as cal
from panelloom.operators import features as feat
from panelloom.operators import joins, profiles, returns, splits, versions
from panelloom.plans import feature_tables as ft

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def random_panel(n=160, assets=("a", "b"), seed=3, start=0):
    rng = random.Random(seed)
    rows = []
    for asset in assets:
        price = 100.0
        for i in range(start, start + n):
            if rng.random() < 0.15:
                continue
            price *= 1 + rng.uniform(-0.05, 0.05)
            rows.append((asset, day(i), price, rng.randint(0, 3)))
    return rows


def test_trailing_return_full_and_partial_spans(frame):
    rows = [("a", day(i), r) for i, r in enumerate([None, 0.1, 0.2, -0.5, 0.0])]
    df = frame("asset string, date date, total_return double", rows)
    full = feat.trailing_returns(df, (2,)).orderBy("date").collect()
    assert [r.return_2d if r.return_2d is None else round(r.return_2d, 9) for r in full] == [
        None, None, None, round(1.1 * 1.2 - 1, 9), round(1.2 * 0.5 - 1, 9),
    ]
    part = feat.trailing_returns(df, (2,), min_periods=1).orderBy("date").collect()
    assert [r.return_2d if r.return_2d is None else round(r.return_2d, 9) for r in part][:3] == [None, None, 0.1]


def test_total_loss_stays_a_total_loss_only_inside_the_span(frame):
    rows = [("a", day(i), r) for i, r in enumerate([0.1, -1.0, 0.3, 0.2, 0.1])]
    df = frame("asset string, date date, total_return double", rows)
    got = [r.return_2d for r in feat.trailing_returns(df, (2,)).orderBy("date").collect()]
    assert got[2] == -1.0 and got[3] == -1.0 and math.isclose(got[4], 1.3 * 1.2 - 1)


def test_spans_match_brute_force(spark, frame):
    rows = random_panel()
    df = frame("asset string, date date, close double, volume int", rows)
    got = feat.technical_features(df.withColumn("bench_return", F.lit(0.001)), betas=(), min_periods=1)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for r in got.collect():
        own = by[r.asset]
        i = next(k for k, x in enumerate(own) if x[1] == r.date)
        closes = [x[2] for x in own[: i + 1]]
        moves = [0.0] + [b - a for a, b in zip(closes, closes[1:])]
        last = moves[-14:]
        up, down = sum(max(m, 0) for m in last), sum(max(-m, 0) for m in last)
        rsi = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        assert math.isclose(r.rsi_14d, rsi, abs_tol=1e-7)
        mean = sum(closes[-7:]) / len(closes[-7:])
        assert math.isclose(r.price_vs_ma_7d, closes[-1] / mean - 1, abs_tol=1e-9)
        peak = max(closes[-30:])
        assert math.isclose(r.drawdown_30d, (peak - closes[-1]) / peak, abs_tol=1e-12)


def test_beta_masks_pairs_and_needs_variance(frame):
    rows = [("a", day(i), 100.0 + i * (-1) ** i, None if i == 5 else 0.01 * (i % 3)) for i in range(12)]
    df = frame("asset string, date date, close double, bench_return double", rows)
    got = feat.technical_features(df, rsi=(), averages=(), outperform=(), drawdowns=(), betas=(10,), min_obs=5)
    assert got.where("beta_10d IS NOT NULL").count() > 0
    flat = feat.technical_features(
        df.withColumn("bench_return", F.lit(0.01)), rsi=(), averages=(), outperform=(), drawdowns=(), betas=(10,), min_obs=5
    )
    assert flat.where("beta_10d IS NOT NULL").count() == 0


def test_rsi_is_100_without_losses(frame):
    df = frame("asset string, date date, close double", [("a", day(i), 100.0 + i) for i in range(20)])
    got = feat.technical_features(df, averages=(), betas=(), outperform=(), drawdowns=()).orderBy("date").collect()
    assert [r.rsi_14d for r in got[:13]] == [None] * 13 and got[-1].rsi_14d == 100.0


def test_calendar_days_not_rows(frame):
    rows = [("a", day(0), 10.0, 1.0), ("a", day(364), 10.0, 2.0), ("a", day(365), 10.0, 0.0), ("a", day(366), 10.0, 0.0), ("a", day(900), 10.0, 0.0)]
    df = frame("asset string, date date, close double, dividend_value double", rows)
    got = feat.dividend_features(df).orderBy("date").collect()
    assert [r.dividend_yield_12m for r in got] == [None, 0.1, 0.3, 0.2, None]
    assert [r.days_since_last_dividend for r in got] == [None, 364, 1, 2, 536]
    assert [r.dividend_history_days for r in got] == [0, 364, 365, 366, 900]


def test_total_return_first_row_zero_price_and_two_events(frame):
    prices = frame("asset string, date date, close double, volume int", [("a", day(0), 0.0, 5), ("a", day(1), 10.0, 0), ("a", day(2), 11.0, None)])
    events = frame("asset string, ex_date date, value double", [("a", day(2), 0.4), ("a", day(2), 0.6), ("a", day(9), 1.0)])
    got = returns.total_returns(prices, events).orderBy("date").collect()
    assert [r.total_return for r in got][:2] == [None, None]
    assert math.isclose(got[2].total_return, 0.2) and got[2].dividend_value == 1.0
    assert [r.has_trading for r in got] == [True, False, False]


def test_event_off_session_moves_to_next_session(frame):
    prices = frame("asset string, date date, close double, volume int", [("a", day(0), 10.0, 1), ("a", day(3), 10.0, 1)])
    events = frame("asset string, ex_date date, value double", [("a", day(1), 0.5), ("a", day(2), 0.25), ("a", day(4), 9.0)])
    drop = returns.total_returns(prices, events).orderBy("date").collect()
    move = returns.total_returns(prices, events, on_missing_session="next").orderBy("date").collect()
    assert [r.dividend_value for r in drop] == [0.0, 0.0]
    assert [r.dividend_value for r in move] == [0.0, 0.75]


def test_release_rule_on_day_14_and_15_and_month_end(frame):
    panel = frame("date date", [(dt.date(2024, 3, 14),), (dt.date(2024, 3, 15),), (dt.date(2024, 3, 31),), (dt.date(2025, 1, 31),)])
    series = frame("month date, v double", [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 2, 1), 2.0), (dt.date(2024, 11, 1), 11.0)])
    got = joins.lagged_month_join(panel, series.withColumn("u", F.col("v")), {"v": "mid_month", "u": "always_two"}).orderBy("date").collect()
    assert [r.v for r in got] == [1.0, 2.0, 2.0, None]
    assert [r.u for r in got] == [1.0, 1.0, 1.0, 11.0]


def test_asof_directions_keys_and_ties(frame):
    left = frame("k string, d date", [("x", day(5)), ("x", day(1)), ("y", day(5)), ("x", day(5))])
    right = frame("k string, d date, v int", [("x", day(2), 1), ("x", day(5), 2), ("x", day(5), 3), ("x", day(8), 4)])
    back = joins.asof_join(left, right, "d", by=["k"], columns=["v"]).collect()
    assert sorted((r.k, r.d, r.v) for r in back if r.v is not None) == [("x", day(5), 3), ("x", day(5), 3)] and len(back) == 4
    ahead = joins.asof_join(left, right, "d", by=["k"], columns=["v"], direction="forward").collect()
    assert sorted((r.k, r.d, r.v) for r in ahead if r.v is not None) == [("x", day(1), 1), ("x", day(5), 3), ("x", day(5), 3)]


def test_asof_per_column_keeps_each_last_value(frame):
    left = frame("d date", [(day(3),)])
    right = frame("d date, a int, b int", [(day(1), 1, 7), (day(2), 2, None)])
    row = joins.asof_join(left, right, "d", columns=["a", "b"], per_column=True).first()
    assert (row.a, row.b) == (2, 7)
    row = joins.asof_join(left, right, "d", columns=["a", "b"]).first()
    assert (row.a, row.b) == (2, None)


def test_holding_window_off_session_and_short(frame):
    rets = frame("asset string, date date, total_return double", [("a", day(i * 2), 0.1) for i in range(5)])
    execs = frame("asset string, execution_date date", [("a", day(1)), ("a", day(0)), ("a", day(5)), ("a", day(50)), ("z", day(1))])
    got = {(r.asset, r.execution_date): r for r in joins.holding_returns(execs, rets, 3).collect()}
    assert math.isclose(got["a", day(1)].period_return, 1.1**3 - 1) and got["a", day(1)].start_date == day(2)
    assert got["a", day(0)].start_date == day(2) and got["a", day(0)].end_date == day(6)
    assert got["a", day(5)].period_return is None and got["a", day(5)].sessions_held == 2
    assert got["a", day(50)].sessions_held == 0 and got["z", day(1)].period_return is None


def test_trailing_months_equals_theta_join(frame):
    rng = random.Random(1)
    panel = frame("asset string, date date", [("a", day(i)) for i in range(0, 900, 17)])
    events = frame("asset string, payment_date date, value double", [("a", day(rng.randrange(900)), rng.random()) for _ in range(40)])
    made = joins.trailing_months_agg(panel, events, 12, {"total": lambda t, f: F.sum(t).over(f)})
    fast = {r.date: r.total for r in made.collect()}
    ev = [(r.payment_date, r.value) for r in events.collect()]
    for d, total in fast.items():
        m = d.year * 12 + d.month
        want = [v for e, v in ev if m - 12 <= e.year * 12 + e.month < m]
        assert (total is None) == (not want) and (not want or math.isclose(total, sum(want)))


def test_appending_the_future_never_changes_the_past(frame):
    def table(n):
        rows = random_panel(n)
        cut = [r for r in rows if r[1] < day(n)]
        prices = frame("asset string, date date, close double, volume int", cut)
        events = frame("asset string, ex_date date, payment_date date, value double", [("a", day(i), day(i + 2), 0.5) for i in range(3, n, 30)])
        bench = frame("date date, close double", [(day(i), 100 + math.sin(i)) for i in range(n)])
        return ft.feature_table(prices, events, bench, version="v2", complete_only=False)

    # Prices are drawn asset by asset, so one asset keeps its first days the same for both sizes.
    short = {(r.asset, r.date): r for r in table(150).where("asset = 'a'").collect()}
    long = {(r.asset, r.date): r for r in table(240).where("asset = 'a'").collect()}
    targets = {"target_7d", "target_alpha_7d"}
    assert len(short) > 100
    for key, row in short.items():
        for name, value in row.asDict().items():
            if name not in targets:
                other = long[key][name]
                same = value == other or (isinstance(value, float) and math.isclose(value, other, abs_tol=1e-9))
                assert same, (key, name)


def test_row_order_does_not_matter(frame):
    rows = random_panel(60)
    schema = "asset string, date date, close double, volume int"
    a = feat.technical_features(frame(schema, rows), betas=(), outperform=(), averages=(7,))
    b = feat.technical_features(frame(schema, rows[::-1]).repartition(5), betas=(), outperform=(), averages=(7,))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_purge_keeps_the_last_target_inside_the_training_span(frame):
    df = frame("date date", [(day(i),) for i in range(30)])
    kept = splits.purge(df, str(day(20)), 7)
    last = kept.agg(F.max("date")).first()[0]
    assert last == day(13)  # its 7-session target ends on day 20
    plan = splits.purge_date(cal.sessions(df), frame("train_end date", [(day(20),)]), 7).first()
    assert plan.purged_end == day(13)


def test_eval_gap_and_monthly_folds(frame):
    df = frame("date date", [(day(i),) for i in range(500)])
    folds = [{"fold": "f", "train_end": str(day(99)), "eval_start": str(day(100)), "eval_end": str(day(200))}]
    out = splits.eval_gap(splits.expanding_folds(df, "date", folds), 7)
    assert out.where("role = 'eval'").agg(F.min("date")).first()[0] == day(107)
    monthly = splits.monthly_folds(df, "date", 12, 1)
    first = monthly.agg(F.min("test_month")).first()[0]
    assert first == dt.date(2025, 2, 1)
    train_end = monthly.where((F.col("test_month") == first) & (F.col("role") == "train")).agg(F.max("date")).first()[0]
    assert train_end == dt.date(2024, 12, 31)


def test_impute_fits_on_training_rows_only(frame):
    df = frame("t int, v double", [(1, 1.0), (1, 3.0), (2, 100.0), (2, None)])
    got = splits.impute(df, ["v"], fit_on=df.where("t = 1")).where("t = 2").collect()
    assert sorted(r.v for r in got) == [2.0, 100.0]


def test_first_session_and_next_session(frame):
    df = frame("date date", [(dt.date(2024, 1, 30),), (dt.date(2024, 2, 2),), (dt.date(2024, 2, 5),)])
    assert [r.decision_date for r in cal.first_session_of_month(cal.sessions(df)).orderBy("month").collect()] == [dt.date(2024, 1, 30), dt.date(2024, 2, 2)]
    nxt = {r.date: r.execution_date for r in cal.next_session(df).collect()}
    assert nxt[dt.date(2024, 1, 30)] == dt.date(2024, 2, 2) and nxt[dt.date(2024, 2, 5)] is None


def test_compare_and_coverage(frame):
    a = frame("k int, v double, u string", [(1, 1.0, "x"), (2, None, "y"), (3, 3.0, "z")])
    b = frame("k int, v double, u string", [(1, 1.0, "x"), (2, None, "q"), (4, 4.0, "w")])
    got = {r["column"]: (r.matched_keys, r.differing) for r in versions.compare_tables(a, b, ["k"], ["v", "u"]).collect()}
    assert got == {"v": (2, 0), "u": (2, 1)}
    cov = joins.coverage(a, b, ["k"]).first()
    assert tuple(cov) == (3, 3, 2, 1, 1)


def versions_of(frame, n=300):
    rows = [(i, f"k{i % 7}", None if i % 11 == 0 else i / 3, "x" if i % 5 else None) for i in range(n)]
    return rows, frame("k int, g string, v double, u string", rows)


def test_equal_versions_are_compared_without_joining_rows(frame, tmp_path):
    _, df = versions_of(frame)
    df.write.parquet(str(tmp_path / "a"))
    df.repartition(5).write.parquet(str(tmp_path / "b"))
    a, b = (df.sparkSession.read.parquet(str(tmp_path / n)) for n in "ab")
    out = versions.compare_tables(a, b, ["k", "g"], ["v", "u"])
    assert "Join" not in out._jdf.queryExecution().toString() and {tuple(r) for r in out.collect()} == {("v", 300, 0), ("u", 300, 0)}
    assert versions.changed_cells(a, b, ["k", "g"], ["v", "u"]).count() == 0


def test_one_changed_cell_is_found_by_its_key(frame):
    rows, a = versions_of(frame)
    for buckets in (1, 16, 4096):
        b = frame("k int, g string, v double, u string", [(k, g, v, "new" if k == 77 else u) for k, g, v, u in rows if k != 20])
        found = versions.Comparison(a, b, ["k"], ["g", "v", "u"], buckets)
        assert found.buckets_apart <= 2 and found.agreed_keys >= 300 - 300 * 2 // min(buckets, 16) - 40
        assert {tuple(r) for r in versions.compare_tables(a, b, ["k"], ["g", "v", "u"], buckets).collect()} == {("g", 299, 0), ("v", 299, 0), ("u", 299, 1)}
        assert [tuple(r) for r in versions.changed_cells(a, b, ["k"], ["g", "v", "u"], buckets).collect()] == [(77, "u", "x", "new")]


def test_checksums_tell_nulls_swaps_and_copies(frame):
    """Values that moved between keys, a value that went missing, and a row that came twice."""
    for changed in ([(1, "b"), (2, "a")], [(1, None), (2, "b")], [(1, "a"), (2, "b"), (2, "b"), (2, "b")]):
        a, b = frame("k int, v string", [(1, "a"), (2, "b")]), frame("k int, v string", changed)
        assert versions.Comparison(a, b, ["k"], ["v"], 1).buckets_apart == 1
    empty = frame("k int, v string", [])
    assert [tuple(r) for r in versions.compare_tables(empty, empty, ["k"], ["v"]).collect()] == [("v", 0, 0)]


def test_only_changed_partitions_are_written(frame, spark, tmp_path):
    rows, df = versions_of(frame)
    target = str(tmp_path / "t")

    def files():
        return {f.parent.name: f.name for f in (tmp_path / "t").rglob("*.parquet")}

    nulls = df.withColumn("g", F.when(F.col("g") != "k6", F.col("g")))
    assert versions.publish_changed(nulls, target, ["g"]).count() == 7
    before = files()
    assert versions.publish_changed(nulls.repartition(3), target, ["g"]).count() == 0 and files() == before
    later = nulls.where("g <=> 'k2' OR g IS NULL OR g = 'k3'").withColumn("u", F.when(F.col("k") == 9, "new").otherwise(F.col("u"))).union(spark.createDataFrame([(1, "k9", 1.0, "n")], df.schema))
    assert {r.g for r in versions.publish_changed(later, target, ["g"]).collect()} == {"k2", "k9"}
    after = files()
    assert {p for p in after if after[p] != before.get(p)} == {"g=k2", "g=k9"}
    stored = spark.read.schema(df.schema).parquet(target)
    assert stored.count() == 301 and stored.where("u = 'new'").count() == 1


def test_frames_compute_equal_values_once(frame):
    df = frame("asset string, date date, total_return double", [("a", day(i), 0.1) for i in range(5)])
    fr = R.Frames(KEYS.history())
    made = [R.trailing_compound(fr, F.col("total_return"), n) for n in (2, 3)]
    # Two counts over the frames ending at -1, -3 and -4, and two sums over frames of their own.
    assert len(fr._made) == 8 and fr.select(df, *[m.alias(f"c{i}") for i, m in enumerate(made)]).count() == 5


def test_unknown_options_are_refused(frame):
    df = frame("asset string, date date", [("a", day(0))])
    with pytest.raises(ValueError):
        joins.asof_join(df, df, "date", direction="sideways")
    with pytest.raises(ValueError):
        joins.lagged_month_join(df, df, {"v": "never"})


@pytest.mark.parametrize(("first", "last"), [(-19, 0), (-20, -1), (-90, -1), (1, 20), (3, 40), (-15, 14)])
def test_spans_in_blocks_equal_spans_that_slide(frame, first, last):
    rng = random.Random(first)
    rows = []
    for asset, n in (("a", 150), ("b", 40), ("c", 19), ("d", 20), ("e", 1), ("f", 7)):
        for i in range(n):
            x = rng.choice([None, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)])
            y = rng.choice([None, 0.1 if asset == "b" else rng.uniform(-1, 1), 0.1])
            rows.append((asset, i, x, y))
    rows += [("huge", i, 1e17 if i == 35 else 0.1 * i, 0.1 * (i % 7)) for i in range(120)]
    rows += [("nan", i, math.nan if i == 35 else 0.1 * i, 0.3) for i in range(120)]
    df = frame("asset string, date int, x double, y double", rows)
    x, y = F.col("x"), F.col("y")
    found = []
    for by in (None, ["asset"]):
        fr = R.Frames(KEYS.history(), by, short=16)
        values = [fr.sum(x, first, last), fr.product(x, first, last), fr.max(x, first, last), fr.min(x, first, last)]
        values += [fr.deviation(x, first, last), fr.slope(x, y, first, last), fr.slope(y, x, first, last)]
        made = fr.select(df, *[v.alias(f"v{k}") for k, v in enumerate(values)])
        found.append({(r["asset"], r["date"]): r for r in made.collect()})
    slid, blocks = found
    assert slid.keys() == blocks.keys() and len(slid) == len(rows)
    for key, row in slid.items():
        for k in range(7):
            a, b = row[f"v{k}"], blocks[key][f"v{k}"]
            assert (a is None) == (b is None), (key, k, a, b)
            assert a is None or a == pytest.approx(b, rel=1e-6, abs=1e-9, nan_ok=True), (key, k, a, b)


def test_spans_in_blocks_share_the_shuffle_of_the_panel(frame):
    df = frame("asset string, date int, total_return double", [("a", i, 0.1) for i in range(50)])
    text = feat.volatility(df, (130, 252))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_profiles_of_parts_merge_to_the_whole(frame):
    rng = random.Random(5)
    rows = [("hot", 1.0)] * 8000 + [("hot", rng.paretovariate(1.1)) for _ in range(6000)]
    rows += [("cold", rng.uniform(0, 50)) for _ in range(700)] + [("cold", None), ("cold", math.nan), ("none", None), (None, -0.0), (None, 0.0)]
    parts = profiles.profile_parts(frame("part string, x double", rows), ["part"], ["x"])
    assert {r["part"]: (r["rows"], r["known"]) for r in parts.collect()} == {"hot": (14000, 14000), "cold": (702, 700), "none": (1, 0), None: (2, 2)}
    known = sorted(x for _, x in rows if x is not None and not math.isnan(x))
    (whole,) = profiles.merged_profile(parts, (0.25, 0.5, 0.95)).collect()
    assert (whole["rows"], whole["known"], whole["least"], whole["most"]) == (len(rows), len(known), known[0], known[-1])
    assert abs(whole["distinct_values"] - len(set(known))) <= 0.04 * len(set(known))
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p95", 0.95)):
        below, upto = (sum(f(x) for x in known) / len(known) for f in (lambda x: x < whole[name], lambda x: x <= whole[name]))
        assert below <= q + 0.01 and upto >= q - 0.01
    alone = {r["part"]: r for r in profiles.merged_profile(parts, (0.5,), ["part"]).collect()}
    assert alone["none"]["p50"] is None and alone["none"]["distinct_values"] == 0 and alone[None]["distinct_values"] == 1
    empty = profiles.profile_parts(frame("part string, x double", []), ["part"], ["x"])
    assert profiles.merged_profile(empty).count() == 0


@pytest.mark.parametrize(("first", "last"), [(-89, 0), (-90, -1), (-30, -1), (-44, 0), (-24, -2)])
def test_spans_in_parts_equal_spans_that_slide(frame, first, last):
    rng = random.Random(first)
    rows = [("a", i, rng.choice([None, rng.uniform(-1, 1), rng.uniform(-1, 1)]), rng.uniform(-1, 1)) for i in range(150)]
    rows += [("short", i, rng.uniform(-1, 1), None if i % 3 else 0.2) for i in range(25)]
    rows += [("level", i, 0.1, 0.1 * (i % 7)) for i in range(120)] + [("none", i, None, 0.3) for i in range(100)]
    rows += [("huge", i, 1e17 if i == 35 else 0.1 * i, 0.1 * (i % 7)) for i in range(140)]
    rows += [("nan", i, math.nan if i == 35 else 0.1 * i, 0.3) for i in range(140)] + [("one", 0, 0.4, 0.1)]
    df = frame("asset string, date int, x double, y double", rows)
    x, y = F.col("x"), F.col("y")
    found = []
    for by in (None, ["asset"]):
        fr = R.Frames(KEYS.history(), by)
        values = [fr.sum(x, first, last), fr.product(x, first, last), fr.max(x, first, last), fr.min(x, first, last)]
        values += [fr.deviation(x, first, last), fr.slope(x, y, first, last), fr.slope(y, x, first, last)]
        made = fr.select(df, *[v.alias(f"v{k}") for k, v in enumerate(values)])
        found.append({(r["asset"], r["date"]): r for r in made.collect()})
    slid, parts = found
    assert slid.keys() == parts.keys() and len(slid) == len(rows)
    for key, row in slid.items():
        for k in range(7):
            a, b = row[f"v{k}"], parts[key][f"v{k}"]
            assert (a is None) == (b is None), (key, k, a, b)
            assert a is None or a == pytest.approx(b, rel=1e-6, abs=1e-9, nan_ok=True), (key, k, a, b)
        if key[0] == "level" and row["v4"] is not None:
            assert parts[key]["v4"] == 0.0


def test_middle_spans_are_not_aggregated_anew_for_every_row(frame):
    df = frame("asset string, date int, total_return double", [("a", i, 0.1) for i in range(50)])
    for made in (feat.volatility(df, (30, 90)), feat.trailing_returns(df, (30, 90))):
        text = made._jdf.queryExecution().executedPlan().toString()
        assert "RowFrame, -9, currentrow" in text
        assert not any(f"RowFrame, -{n}, -1" in text for n in (30, 90)) and len(text) < 100_000
