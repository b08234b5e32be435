"""The given tables in the roles of a panel analysis.

asset = order priority, session = calendar day. Money and percentages are summed as whole cents
and divided once, so a role's values do not depend on the order of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.scalars import month_start
from panelloom.operators import calendar as cal
from panelloom.operators import features as feat
from panelloom.operators import joins
from panelloom.operators import explain
from panelloom.operators import returns as ret
from panelloom.sources.tables import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def exact_mean(column: str) -> Column:
    return F.sum(cents(column)) / (F.count(F.lit(1)) * 100.0)


def price_cells(spark, sf) -> DataFrame:
    """(asset, date, close, adj_close, volume, cents): close is the price of the last order key."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date"))
        .agg(
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.min("o_totalprice").alias("adj_close"),
            F.count(F.lit(1)).alias("volume"),
            F.sum(cents("o_totalprice")).alias("cents"),
        )
    )


def prices(spark, sf) -> DataFrame:
    """The price cells as a written table, for queries that need the panel and its benchmark: the
    orders are then scanned once. It has at most one row per asset and calendar day."""
    return materialise(price_cells(spark, sf), "prices")


def panel_of(cells: DataFrame) -> DataFrame:
    return cells.drop("cents")


def panel(spark, sf) -> DataFrame:
    """(asset, date, close, adj_close, volume)."""
    return panel_of(price_cells(spark, sf))


def written_panel(spark, sf) -> DataFrame:
    """The panel as a written table, for queries that read it more than once."""
    return panel_of(prices(spark, sf))


def bench_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("date").agg((F.sum("cents") / (F.sum("volume") * 100.0)).alias("close"))


def bench(spark, sf) -> DataFrame:
    """(date, close): mean order price per date."""
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        exact_mean("o_totalprice").alias("close")
    )


def shipped(spark, sf) -> DataFrame:
    """Line items with the asset of their order; only the needed columns are read."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("asset")
    )
    return table(spark, sf, "lineitem").join(orders, "l_orderkey").withColumn("date", F.to_date("l_shipdate"))


def dividends(spark, sf) -> DataFrame:
    """(asset, ex_date, payment_date, value): returned line items as cash events; paid 10 days
    later."""
    worth = F.sum(cents("l_extendedprice") * cents("l_discount")) / 1_000_000.0
    return (
        shipped(spark, sf)
        .where("l_returnflag = 'R'")
        .groupBy("asset", F.col("date").alias("ex_date"))
        .agg(worth.alias("value"))
        .select("asset", "ex_date", F.date_add("ex_date", 10).alias("payment_date"), "value")
    )


def macro_daily(spark, sf) -> DataFrame:
    """(date, macro_a, macro_b)."""
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        exact_mean("l_discount").alias("macro_a"), exact_mean("l_quantity").alias("macro_b")
    )


def macro_monthly(spark, sf) -> DataFrame:
    """(month, macro_c, macro_d)."""
    return table(spark, sf, "lineitem").groupBy(
        month_start(F.to_date("l_shipdate")).alias("month")
    ).agg(exact_mean("l_tax").alias("macro_c"), (F.sum(cents("l_extendedprice")) / 1e8).alias("macro_d"))


def total_returns(spark, sf, cells: DataFrame | None = None, on_missing_session: str = "drop") -> DataFrame:
    own = panel(spark, sf) if cells is None else panel_of(cells)
    return ret.total_returns(own, dividends(spark, sf), on_missing_session=on_missing_session)


def bench_returns(cells: DataFrame) -> DataFrame:
    """(date, bench_close, bench_return)."""
    return ret.benchmark_returns(bench_of(cells))


def _line_cells(spark, sf) -> DataFrame:
    """(asset, date, cents, lines, last_order) of the line items shipped that day."""
    return shipped(spark, sf).groupBy("asset", "date").agg(
        F.sum(cents("l_discount")).alias("cents"),
        F.count(F.lit(1)).alias("lines"),
        F.max("l_orderkey").alias("last_order"),
    )


def _returns_of(cells: DataFrame) -> DataFrame:
    return cells.select(
        "asset",
        "date",
        (F.col("cents") / (F.col("lines") * 100.0) - 0.05).alias("total_return"),
        ((F.col("last_order") * 7919 % 1000) / 1000.0).alias("prob"),
    )


def return_cells(spark, sf) -> DataFrame:
    """(asset, date, total_return, prob): small daily returns and a score, from line items."""
    return _returns_of(_line_cells(spark, sf))


@dataclass(frozen=True)
class Market:
    """The return panel and its benchmark, both read from one written table of cells."""

    returns: DataFrame  # asset, date, total_return, prob
    bench: DataFrame  # date, bench_return


def market(spark, sf) -> Market:
    """Scans and joins the line items once; the cells number at most one per asset and day."""
    cells = materialise(_line_cells(spark, sf), "cells")
    whole = cells.groupBy("date").agg(
        (F.sum("cents") / (F.sum("lines") * 100.0) - 0.05).alias("bench_return")
    )
    return Market(_returns_of(cells), whole)


def predictions(m: Market, n: int = 7) -> DataFrame:
    """(signal_date, execution_date, asset, prob, target, alpha): whole n-session horizons."""
    labelled = feat.forward_targets(m.returns, m.bench, n)
    return (
        cal.next_session(labelled)
        .where(F.col(f"target_{n}d").isNotNull())
        .select(
            F.col("date").alias("signal_date"),
            "execution_date",
            "asset",
            "prob",
            F.col(f"target_{n}d").alias("target"),
            F.col(f"target_alpha_{n}d").alias("alpha"),
        )
    )


def rebalances(m: Market) -> DataFrame:
    """Predictions on every 7th session of the prediction calendar."""
    preds = predictions(m)
    dates = cal.every_nth_session(cal.sessions(preds, "signal_date"), 7).select("signal_date")
    return preds.join(dates, "signal_date")


def periods(m: Market) -> DataFrame:
    """Rebalances with the return of the 7 sessions after execution."""
    return joins.holding_returns(rebalances(m), m.returns, 7)


def monthly_periods(m: Market) -> DataFrame:
    """Predictions of 21 sessions on the first session of each month, with the return of the 21 sessions
    after execution."""
    preds = predictions(m, 21)
    dates = cal.first_session_of_month(cal.sessions(preds, "signal_date"), "signal_date").select(F.col("decision_date").alias("signal_date"))
    return joins.holding_returns(preds.join(dates, "signal_date"), m.returns, 21)


def scored_orders(spark, sf) -> DataFrame:
    """Every order as a scored row: (row_id, date, month, segment, prob, label)."""
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        day.alias("date"),
        month_start(day).alias("month"),
        F.col("o_orderpriority").alias("segment"),
        ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("prob"),
        (F.col("o_totalprice") > 250000).alias("label"),
    )


def features_frame(m: Market) -> DataFrame:
    """The return panel with trailing features and its target, for models."""
    side = m.bench
    full = feat.volatility(feat.trailing_returns(m.returns, (7, 30)), (30,))
    full = joins.attach_series(
        full,
        feat.benchmark_trailing(side, (7, 30)),
        {"bench_return": "bench_return", "bench_return_7d": "bench_return_7d", "bench_return_30d": "bench_return_30d"},
    )
    full = full.withColumn("alpha_30d", F.col("return_30d") - F.col("bench_return_30d"))
    return feat.forward_targets(full.drop("bench_return"), side, 7).withColumnRenamed("target_7d", "label")


FEATURES = ["return_1d", "return_7d", "return_30d", "volatility_30d", "bench_return_7d", "bench_return_30d", "alpha_30d"]

# Fixed linear coefficients for the attribution queries: one per stored line-item column. Their
# many digits keep means of whole-number columns off the rounding ties of a checked result.
LINEAR = {"l_quantity": 0.0314159265, "l_discount": -4.1421356237, "l_tax": 2.7182818284, "l_extendedprice": 0.0000161803398}
GROUPS = {"size": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"]}


def line_rows(spark, sf) -> DataFrame:
    """Every line item as an explained row: (row_id, asset, date, prob, label, LINEAR columns).

    Order and line number repeat in the given table, so the key adds part, supplier and price.
    """
    return table(spark, sf, "lineitem").select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice")
        ).alias("row_id"),
        F.col("l_returnflag").alias("asset"),
        F.to_date("l_shipdate").alias("date"),
        ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 1000 / 1000.0).alias("prob"),
        (F.col("l_linestatus") == "F").alias("label"),
        *LINEAR,
    )


def attributions(spark, sf) -> DataFrame:
    return explain.linear_contributions(
        line_rows(spark, sf), LINEAR, ["row_id", "asset", "date", "prob", "label"]
    )
