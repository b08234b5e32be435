"""Portfolio backtest over long-form weights (strategy, signal_date, asset, weight).

All strategies and cost scenarios live in one frame under a key column. A curve has one row per
rebalance, so the running windows per strategy are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import rolling as R
from panelloom.functions.scalars import best_first, hash_order, known_score, safe_div
from panelloom.operators.joins import range_compound
from panelloom.sources.tables import materialise

PERIODS_PER_YEAR = 365.25 / 7


def weights(periods: DataFrame, threshold: float = 0.55, seed: int = 42) -> DataFrame:
    """Weights of the five strategies for every (signal_date, asset) of `periods`.

    `periods` has signal_date, asset, prob. top1, top2 (equal halves), threshold (equal among
    scores at or above it, else all cash), equal_weight, random (one asset, chosen by the hash
    of seed, date and asset). Unknown scores are never picked by score: without a known one top1
    stays in cash. The facts of a date are one aggregate (map-side combined) joined back, and the
    strategies are rows exploded from a literal: no sort of a whole date.
    """
    periods = periods.withColumn("prob", known_score(F.col("prob")))
    order = best_first(F.col("prob"), F.col("asset"))
    w = Window.partitionBy("signal_date").orderBy(order)
    second = (
        periods.select("signal_date", "asset", "prob")
        .withColumn("__rn", F.row_number().over(w))
        .where("__rn <= 2")
        .groupBy("signal_date")
        .agg(F.max(F.when((F.col("__rn") == 2) & F.col("prob").isNotNull(), F.col("asset"))).alias("__second"))
    )
    facts = periods.groupBy("signal_date").agg(
        F.min_by(F.when(F.col("prob").isNotNull(), F.col("asset")), order).alias("__first"),
        F.count_if(F.col("prob") >= threshold).alias("__selected"),
        F.count(F.lit(1)).alias("__assets"),
        F.min_by("asset", hash_order(seed, F.col("signal_date"), F.col("asset"))).alias("__random"),
    )
    asset = F.col("asset")

    def one(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(F.lit(0.0))

    chosen = {
        "top1": one(asset == F.col("__first"), F.lit(1.0)),
        "top2": one((asset == F.col("__first")) | (asset == F.col("__second")), F.lit(0.5)),
        "threshold": one(F.col("prob") >= threshold, F.lit(1.0) / F.nullif(F.col("__selected"), F.lit(0))),
        "equal_weight": F.lit(1.0) / F.col("__assets"),
        "random": one(asset == F.col("__random"), F.lit(1.0)),
    }
    cells = periods.select("signal_date", "asset", "prob").join(facts, "signal_date").join(second, "signal_date")
    strategy = F.explode(
        F.array(*[F.struct(F.lit(name).alias("strategy"), value.alias("weight")) for name, value in chosen.items()])
    )
    return cells.select("signal_date", "asset", strategy.alias("s")).select(
        "s.strategy", "signal_date", "asset", "s.weight"
    )


def _doubled(table: DataFrame) -> DataFrame:
    """Every node of (node, jump, reached) jumps twice as far, and reaches what its jump went to."""
    further = table.select(F.col("node").alias("jump"), F.col("jump").alias("__jump"))
    hits = table.where("reached AND jump IS NOT NULL").select(F.col("jump").alias("node"), F.lit(True).alias("__hit"))
    joined = table.join(further, "jump", "left").join(hits, "node", "left")
    return joined.select("node", F.col("__jump").alias("jump"), (F.col("reached") | F.coalesce(F.col("__hit"), F.lit(False))).alias("reached"))


def chain(pointers: DataFrame, node: str, to: str) -> DataFrame:
    """The nodes that following `to` from the smallest node reaches, that one included; NULL ends the chain.

    Pointer doubling: after k self-joins every node knows the node 2^k steps on, and the first 2^k nodes of the
    chain are known. Every third join is written, so neither the plan nor a lost executor's work grows with
    them, and a chain of n nodes takes log2(n) joins over any number of tasks. `pointers` is read several times,
    best a written table.
    """
    first = pointers.agg(F.min(node)).first()[0]
    known = F.col(node) == F.lit(first)
    table = pointers.select(F.col(node).alias("node"), F.col(to).alias("jump"), F.coalesce(known, F.lit(False)).alias("reached"))
    while True:
        table = materialise(_doubled(_doubled(_doubled(table))), "chain")
        if table.where("reached AND jump IS NOT NULL").isEmpty():
            return table.where("reached").select(F.col("node").alias(node))


def hysteresis(periods: DataFrame, delta: float) -> DataFrame:
    """(signal_date, held_asset, switched): keep the held asset until another leads it by more
    than `delta`.

    The state is sequential, but only along a chain of switch dates. Every date has one
    candidate (its best known score; an unknown score of the held asset gives nothing up, and on a
    date without known scores the holding stays); a window per asset finds the first later date on which that
    candidate would be given up, which makes one pointer per date. The dates on the chain of pointers from the
    first date are found by doubling them.
    """
    periods = periods.withColumn("prob", known_score(F.col("prob")))
    candidate = F.when(F.col("prob").isNotNull(), F.struct("asset", "prob"))
    best = periods.groupBy("signal_date").agg(
        F.min_by(candidate, best_first(F.col("prob"), F.col("asset"))).alias("__b")
    ).select("signal_date", F.col("__b.asset").alias("best_asset"), F.col("__b.prob").alias("best_prob"))
    # Dates walked downwards: a growing frame over the later dates, one step per row.
    later = (
        Window.partitionBy("asset")
        .orderBy(F.col("signal_date").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    given_up = F.when(F.col("best_prob") - F.col("prob") > delta, F.col("signal_date"))
    pointers = (
        periods.select("signal_date", "asset", "prob")
        .join(best, "signal_date")
        .withColumn("next_switch", F.min(given_up).over(later))
        .where(F.col("asset") == F.col("best_asset"))
        .select("signal_date", "best_asset", "next_switch")
    )
    pointers = materialise(pointers, "pointers")
    switches = chain(pointers, "signal_date", "next_switch").withColumn("switched", F.lit(True))
    w = Window.orderBy("signal_date")
    return (
        best.select("signal_date")
        .join(pointers, "signal_date", "left")
        .join(switches, "signal_date", "left")
        .withColumn("held_asset", R.forward_fill(w, F.when(F.col("switched"), F.col("best_asset"))))
        .select("signal_date", "held_asset", F.coalesce("switched", F.lit(False)).alias("switched"))
    )


def hysteresis_weights(periods: DataFrame, delta: float) -> DataFrame:
    """The hysteresis holding as a weight frame."""
    held = hysteresis(periods, delta)
    return periods.select("signal_date", "asset").join(held, "signal_date").select(
        F.lit("hysteresis").alias("strategy"),
        "signal_date",
        "asset",
        F.when(F.col("asset") == F.col("held_asset"), 1.0).otherwise(0.0).alias("weight"),
    )


def portfolio_returns(weights: DataFrame, periods: DataFrame) -> DataFrame:
    """(strategy, signal_date, gross_return): weighted sum, a missing period return counts 0."""
    joined = weights.join(periods.select("signal_date", "asset", "period_return"), ["signal_date", "asset"], "left")
    earned = F.col("weight") * F.coalesce(F.col("period_return"), F.lit(0.0))
    return joined.groupBy("strategy", "signal_date").agg(F.sum(earned).alias("gross_return"))


def drifted(weights: DataFrame, periods: DataFrame) -> DataFrame:
    """Adds `drifted`: what a weight has become at the end of its period, by the returns of its own and of the
    whole portfolio; a missing period return counts 0."""
    returns = periods.select("signal_date", "asset", F.coalesce("period_return", F.lit(0.0)).alias("__r"))
    rows = weights.join(returns, ["signal_date", "asset"], "left").withColumn("__r", F.coalesce("__r", F.lit(0.0)))
    gained = rows.groupBy("strategy", "signal_date").agg(F.sum(F.col("weight") * F.col("__r")).alias("__gain"))
    grown = F.col("weight") * (F.col("__r") + 1.0) / F.nullif(F.col("__gain") + 1.0, F.lit(0.0))
    return rows.join(gained, ["strategy", "signal_date"]).select(*weights.columns, F.coalesce(grown, F.lit(0.0)).alias("drifted"))


def weight_changes(weights: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Adds prev_weight and change per (strategy, asset) over consecutive rebalance dates.

    An asset that is absent on a date counts as weight 0 there: the grid of dates and assets is
    completed by moving each row's exit to the next rebalance date, not by a cross join. With
    `periods` the previous weight is the drifted one, else it is taken as held constant.
    """
    held = weights.withColumn("drifted", F.col("weight")) if periods is None else drifted(weights, periods)
    dates = weights.select("strategy", "signal_date").distinct()
    by_date = Window.partitionBy("strategy").orderBy("signal_date")
    dated = dates.select(
        "strategy",
        "signal_date",
        F.lag("signal_date", 1).over(by_date).alias("__prev"),
        F.lead("signal_date", 1).over(by_date).alias("__next"),
    )
    rows = held.join(dated, ["strategy", "signal_date"])
    now = rows.select("strategy", "signal_date", "asset", "weight", F.lit(0.0).alias("prev_weight"))
    handed_on = rows.where(F.col("__next").isNotNull()).select(
        "strategy",
        F.col("__next").alias("signal_date"),
        "asset",
        F.lit(0.0).alias("weight"),
        F.col("drifted").alias("prev_weight"),
    )
    both = now.unionByName(handed_on).groupBy("strategy", "signal_date", "asset").agg(
        F.sum("weight").alias("weight"), F.sum("prev_weight").alias("prev_weight")
    )
    return both.withColumn("change", F.col("weight") - F.col("prev_weight"))


def turnover(weights: DataFrame, first_turnover: str = "one", periods: DataFrame | None = None) -> DataFrame:
    """(strategy, signal_date, bought, sold, abs_change, turnover).

    turnover = half the absolute weight change. The first rebalance counts as 1 (`one`), even
    for a strategy that starts in cash, or by the same rule as the others (`actual`). With `periods`
    the trades start from drifted weights.
    """
    changes = weight_changes(weights, periods)
    sums = changes.groupBy("strategy", "signal_date").agg(
        F.sum(F.greatest("change", F.lit(0.0))).alias("bought"),
        F.sum(F.greatest(-F.col("change"), F.lit(0.0))).alias("sold"),
        F.sum(F.abs("change")).alias("abs_change"),
    )
    half = F.col("abs_change") * 0.5
    if first_turnover == "actual":
        return sums.withColumn("turnover", half)
    if first_turnover != "one":
        raise ValueError("first_turnover is 'one' or 'actual'")
    by_date = Window.partitionBy("strategy").orderBy("signal_date")
    return sums.withColumn(
        "turnover", F.when(F.row_number().over(by_date) == 1, F.lit(1.0)).otherwise(half)
    )


def _rates(rates: dict[str, float]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("rate")) for k, v in rates.items()])
    )


def net_curve(
    returns: DataFrame,
    traded: DataFrame,
    rates: dict[str, float],
    capital: float = 100_000.0,
    cost_base: str = "turnover",
) -> DataFrame:
    """Equity curve per (scenario, strategy): cost, net_return, capital, cumulative_return.

    `rates` maps scenario names to a rate; the cost of a rebalance is the rate times `cost_base`
    (turnover, or abs_change for a rate per traded side). Scenarios are exploded from a literal.
    """
    joined = returns.join(traded.select("strategy", "signal_date", "turnover", "abs_change"), ["strategy", "signal_date"])
    priced = joined.select("*", _rates(rates).alias("__s")).select(
        "strategy",
        "signal_date",
        "gross_return",
        "turnover",
        F.col("__s.scenario").alias("scenario"),
        F.col("__s.rate").alias("rate"),
        (F.col(cost_base) * F.col("__s.rate")).alias("cost"),
    )
    net = priced.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return equity_curve(net, ["scenario", "strategy"], "net_return", capital)


def equity_curve(df: DataFrame, keys: Sequence[str], ret: str, capital: float = 100_000.0, date: str = "signal_date") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date)
    growth = R.running_compound(w, F.coalesce(F.col(ret), F.lit(0.0)))
    return df.select("*", (growth * capital).alias("capital"), (growth - 1.0).alias("cumulative_return"))


def with_drawdown(curve: DataFrame, keys: Sequence[str], date: str = "signal_date") -> DataFrame:
    """Adds the running peak and the drawdown (zero or negative) of the capital."""
    w = Window.partitionBy(*keys).orderBy(date)
    return curve.withColumn("peak", R.running_max(w, F.col("capital"))).withColumn(
        "drawdown", safe_div(F.col("capital") - F.col("peak"), F.col("peak"))
    )


def benchmark_curve(
    periods: DataFrame, bench: DataFrame, ret: str = "bench_return", capital: float = 100_000.0
) -> DataFrame:
    """Benchmark over the same holding windows: one row per rebalance date.

    The window of a date is the one of its smallest asset key; an open window earns 0.
    """
    windows = periods.groupBy("signal_date").agg(
        F.min_by(F.struct("start_date", "end_date", "period_return"), "asset").alias("p")
    ).select(
        "signal_date",
        F.when(F.col("p.period_return").isNotNull(), F.col("p.start_date")).alias("start_date"),
        F.when(F.col("p.period_return").isNotNull(), F.col("p.end_date")).alias("end_date"),
    )
    earned = range_compound(windows, bench, ret, out="bench_period_return").withColumn(
        "bench_period_return", F.coalesce(F.col("bench_period_return"), F.lit(0.0))
    )
    curve = equity_curve(earned.withColumn("strategy", F.lit("benchmark")), ["strategy"], "bench_period_return", capital)
    return curve.select("strategy", "signal_date", "bench_period_return", "capital", "cumulative_return")


def buy_and_hold(periods: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Equal amounts in every asset at the start, never rebalanced: capital per date.

    An asset without a row on a date keeps its value, so its last growth is carried by summing
    the steps of all assets over time instead of filling a grid.
    """
    w = Window.partitionBy("asset").orderBy("signal_date")
    growth = R.running_compound(w, F.coalesce(F.col("period_return"), F.lit(0.0)))
    grown = periods.select("asset", "signal_date", growth.alias("g"))
    step = grown.withColumn("step", F.col("g") - F.coalesce(F.lag("g", 1).over(w), F.lit(1.0)))
    assets = periods.agg(F.count_distinct("asset").alias("n")).scalar()
    by_date = step.groupBy("signal_date").agg(F.sum("step").alias("step"))
    order = Window.orderBy("signal_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = F.sum("step").over(order)
    return by_date.select("signal_date", cumulative.alias("__gain")).select(
        F.lit("buy_and_hold").alias("strategy"),
        "signal_date",
        (F.lit(capital) * (1.0 + F.col("__gain") / assets)).alias("capital"),
        (F.col("__gain") / assets).alias("cumulative_return"),
    )


def performance(
    curve: DataFrame,
    bench: DataFrame,
    keys: Sequence[str] = ("scenario", "strategy"),
    periods_per_year: float = PERIODS_PER_YEAR,
) -> DataFrame:
    """All performance figures per curve.

    `curve` has the keys, signal_date, cumulative_return, net_return and, when known, turnover and
    cost; `bench` has signal_date, cumulative_return and bench_period_return. The return of the
    first period counts as 0; deviations are population ones; years count 365.25 days.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("signal_date")
    side = bench.select(
        "signal_date", (F.col("cumulative_return") + 1.0).alias("__bench"), F.col("bench_period_return").alias("b")
    )
    has_costs = {"turnover", "cost"} <= set(curve.columns)
    joined = curve.select(
        *keys,
        "signal_date",
        (F.col("cumulative_return") + 1.0).alias("__own"),
        F.col("net_return").alias("r"),
        (F.col("turnover") if has_costs else F.lit(0.0)).alias("turnover"),
        (F.col("cost") if has_costs else F.lit(0.0)).alias("cost"),
    ).join(side, "signal_date", "left")

    later = F.row_number().over(w) > 1
    peak = R.running_max(w, F.col("__own"))
    stepped = joined.select(
        *keys,
        "signal_date",
        "__own",
        "__bench",
        "turnover",
        "cost",
        F.when(later, F.coalesce("r", F.lit(0.0))).otherwise(F.lit(0.0)).alias("r"),
        F.when(later, F.coalesce("b", F.lit(0.0))).otherwise(F.lit(0.0)).alias("b"),
        safe_div(F.col("__own") - peak, peak).alias("dd"),
    )
    down = F.when(F.col("r") < 0, F.col("r"))
    year = F.sqrt(F.lit(periods_per_year))
    facts = stepped.groupBy(*keys).agg(
        (F.max_by("__own", "signal_date") - 1.0).alias("total_return"),
        F.max_by("__bench", "signal_date").alias("__bench_end"),
        (F.datediff(F.max("signal_date"), F.min("signal_date")) / 365.25).alias("__years"),
        (F.stddev_pop("r") * year).alias("volatility"),
        (F.coalesce(F.stddev_pop(down), F.lit(0.0)) * year).alias("__downside"),
        F.min("dd").alias("max_drawdown"),
        (F.stddev_pop(F.col("r") - F.col("b")) * year).alias("tracking_error"),
        F.avg("turnover").alias("mean_turnover"),
        F.sum("cost").alias("total_cost"),
        F.count(F.lit(1)).alias("rebalances"),
        F.avg(F.when(F.col("r") > F.col("b"), 1.0).otherwise(0.0)).alias("share_above_benchmark"),
    )
    span = F.nullif(F.col("__years"), F.lit(0.0))
    based = facts.select(
        "*",
        (F.pow(1.0 + F.col("total_return"), 1.0 / span) - 1.0).alias("cagr"),
        (F.pow(F.col("__bench_end"), 1.0 / span) - 1.0).alias("__bench_cagr"),
    ).withColumn("alpha", F.col("cagr") - F.col("__bench_cagr"))

    def per(value: str, risk: Column) -> Column:
        return F.when(risk != 0, F.col(value) / F.nullif(risk, F.lit(0.0))).otherwise(F.lit(0.0))

    return based.select(
        *keys,
        "total_return",
        "cagr",
        "volatility",
        per("cagr", F.col("volatility")).alias("sharpe"),
        per("cagr", F.col("__downside")).alias("sortino"),
        "max_drawdown",
        per("cagr", F.abs("max_drawdown")).alias("calmar"),
        "alpha",
        "tracking_error",
        per("alpha", F.col("tracking_error")).alias("information_ratio"),
        "mean_turnover",
        "total_cost",
        "rebalances",
        "share_above_benchmark",
    )


def trade_ledger(
    weights: DataFrame, returns: DataFrame, rate: float, capital: float = 100_000.0, strategy: str = "top1"
) -> DataFrame:
    """One row per rebalance of a strategy: holdings before and after, notional, cost, capital.

    The cost is the rate times the whole notional traded (bought + sold).
    """
    own = weights.where(F.col("strategy") == strategy)
    changes = weight_changes(own)
    held = F.min_by(F.struct("asset", "weight"), F.struct(-F.col("weight"), F.col("asset")))
    before = F.min_by(F.struct("asset", "prev_weight"), F.struct(-F.col("prev_weight"), F.col("asset")))
    sums = changes.groupBy("signal_date").agg(
        F.sum(F.greatest("change", F.lit(0.0))).alias("bought"),
        F.sum(F.greatest(-F.col("change"), F.lit(0.0))).alias("sold"),
        F.sum(F.abs("change")).alias("abs_change"),
        held.alias("__new"),
        before.alias("__old"),
    )
    rows = sums.join(returns.where(F.col("strategy") == strategy).drop("strategy"), "signal_date")
    cost = F.col("abs_change") * rate
    named = rows.select(
        "signal_date",
        F.when(F.col("__old.prev_weight") > 0, F.col("__old.asset")).alias("old_asset"),
        F.when(F.col("__new.weight") > 0, F.col("__new.asset")).alias("new_asset"),
        "bought",
        "sold",
        "abs_change",
        (F.col("abs_change") * 0.5).alias("turnover"),
        (F.col("bought") * rate).alias("buy_cost"),
        (F.col("sold") * rate).alias("sell_cost"),
        cost.alias("cost"),
        "gross_return",
        (F.col("gross_return") - cost).alias("net_return"),
    )
    w = Window.orderBy("signal_date")
    after = R.running_compound(w, F.col("net_return")) * capital
    return (
        named.withColumn("changed", ~F.col("old_asset").eqNullSafe(F.col("new_asset")))
        .withColumn("capital_after", after)
        .withColumn("capital_before", F.coalesce(F.lag("capital_after", 1).over(w), F.lit(float(capital))))
        .withColumn("capital_before_cost", F.col("capital_before") * (1.0 + F.col("gross_return")))
    )


def reconcile_costs(ledger: DataFrame) -> DataFrame:
    """Compounded net return against gross return minus summed costs, one row."""
    sums = ledger.agg(
        (F.product(1.0 + F.col("gross_return")) - 1.0).alias("gross"),
        (F.product(1.0 + F.col("net_return")) - 1.0).alias("net_compounded"),
        F.sum("cost").alias("total_cost"),
    )
    return sums.select(
        "*",
        (F.col("gross") - F.col("total_cost")).alias("net_simple"),
        (F.col("net_compounded") - (F.col("gross") - F.col("total_cost"))).alias("difference"),
    )


def leaderboard(metrics: DataFrame, benchmark_total: Column, by: str = "total_return", name: str = "strategy") -> DataFrame:
    """Strategies ordered by a metric, with their place and whether they beat the benchmark.

    One row per strategy enters, so the ordering is over a handful of rows.
    """
    w = Window.orderBy(F.col(by).desc_nulls_last(), name)
    return metrics.select(
        F.row_number().over(w).cast("long").alias("place"),
        name,
        by,
        (F.col("total_return") > benchmark_total).alias("above_benchmark"),
    )


def break_even_rate(sensitivity: DataFrame, benchmark_total: Column, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Per strategy: the first rate of the grid that no longer beats the benchmark, and the
    largest rate before it (NULL when even the smallest rate fails)."""
    fails = F.col("total_return") <= benchmark_total
    first = sensitivity.groupBy(*keys).agg(F.min(F.when(fails, F.col("rate"))).alias("first_failing_rate"))
    return (
        sensitivity.join(first, list(keys))
        .groupBy(*keys, "first_failing_rate")
        .agg(
            F.max(
                F.when(
                    F.col("first_failing_rate").isNull() | (F.col("rate") < F.col("first_failing_rate")),
                    F.col("rate"),
                )
            ).alias("break_even_rate")
        )
    )


def success_criteria(metrics: DataFrame, benchmark_total: Column, name: str = "strategy") -> DataFrame:
    """(strategy, criterion, value, passed) for the five acceptance rules."""
    # Acceptance limits.
    checks = {
        "net_return_above_benchmark": (F.col("total_return"), F.col("total_return") > benchmark_total),
        "sharpe_positive": (F.col("sharpe"), F.col("sharpe") > 0),
        "turnover_below_15pct": (F.col("mean_turnover"), F.col("mean_turnover") < 0.15),
        "cost_below_10pct": (F.col("total_cost"), F.col("total_cost") < 0.10),
        "above_benchmark_55pct": (F.col("share_above_benchmark"), F.col("share_above_benchmark") > 0.55),
    }
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("criterion"), v.cast("double").alias("value"), p.alias("passed"))
                for k, (v, p) in checks.items()
            ]
        )
    )
    return metrics.select(name, rows.alias("__c")).select(name, "__c.criterion", "__c.value", "__c.passed")
