"""Aggregation and profile queries (survey ids AG*)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelloom.functions import aggregates as A
from panelloom.functions.scalars import month_start
from panelloom.operators import profiles as P
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.queries.windows import r6
from panelloom.sources.tables import materialise


@query("ag1_counts_by_key", "SELECT o_orderpriority, o_orderstatus, count(*) AS rows FROM orders GROUP BY 1, 2")
def ag1(spark, sf):
    return P.counts_by(roles.table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    "ag2_summary_by_key",
    """
SELECT l_returnflag, count(*) AS rows, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
       round(avg(l_quantity), 4) + 0e0 AS avg_l_quantity, round(sum(l_quantity), 2) AS sum_l_quantity,
       min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice,
       round(avg(l_extendedprice), 4) + 0e0 AS avg_l_extendedprice, round(sum(l_extendedprice), 2) AS sum_l_extendedprice
FROM lineitem GROUP BY 1""",
)
def ag2(spark, sf):
    df = P.summary_by(roles.table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    digits = {"avg": 4, "sum": 2}
    return df.select(
        *[F.round(c, digits[c[:3]]).alias(c) if c[:3] in digits else F.col(c) for c in df.columns]
    )


_NULLABLE = """
WITH j AS (SELECT p.close, d.value, d.ex_date, m.macro_a FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date
           LEFT JOIN macro_daily m ON m.date = p.date)
"""


def _nullable(spark, sf):
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "ex_date", "value")
    joined = roles.panel(spark, sf).join(paid, ["asset", "date"], "left")
    return joined.join(roles.macro_daily(spark, sf), "date", "left").select("close", "value", "ex_date", "macro_a")


@query(
    "ag3_null_profile",
    sql(
        "panel divs macro_daily",
        _NULLABLE
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows, round((count(*) - count({c})) * 100e0 / count(*), 6) + 0e0 AS null_pct FROM j"
            for c in ("close", "value", "ex_date", "macro_a")
        ),
    ),
)
def ag3(spark, sf):
    return P.null_profile(_nullable(spark, sf)).select("column", "nulls", "rows", r6("null_pct"))


_CARD = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query(
    "ag4_cardinality_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) <= 1 AS is_constant, count(DISTINCT {c}) < 10 AS is_low_cardinality FROM lineitem"
        for c in _CARD
    ),
)
def ag4(spark, sf):
    return P.cardinality_profile(roles.table(spark, sf, "lineitem"), _CARD)


@query(
    "ag5_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) + 0e0 AS mean, round(stddev_samp({c}), 6) + 0e0 AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def ag5(spark, sf):
    df = P.describe(roles.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.select("column", "count", r6("mean"), r6("stddev"), "min", "max")


_NUM = ["o_totalprice", "o_custkey"]


@query(
    "ag6_numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) + 0e0 AS mean, round(stddev_samp({c}), 4) + 0e0 AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
       round(quantile_cont({c}::DOUBLE, 0.05), 4) + 0e0 AS p05, round(quantile_cont({c}::DOUBLE, 0.25), 4) + 0e0 AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) + 0e0 AS p50,
       round(quantile_cont({c}::DOUBLE, 0.75), 4) + 0e0 AS p75, round(quantile_cont({c}::DOUBLE, 0.95), 4) + 0e0 AS p95 FROM orders"""
        for c in _NUM
    ),
)
def ag6(spark, sf):
    orders = roles.table(spark, sf, "orders")
    sketched = materialise(P.sketches(orders, _NUM, [0.05, 0.25, 0.5, 0.75, 0.95]), "sketches")
    df = P.numeric_profile(orders, _NUM, sketched=sketched)
    rounded = [c for c in df.columns if c not in ("column", "count", "min", "max")]
    return df.select("column", "count", "min", "max", *[F.round(c, 4).alias(c) for c in rounded])


_PARTED = ["l_quantity", "l_extendedprice", "l_partkey"]


@query(
    "ag6_merged_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS known, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most,
       TRUE AS distinct_near, TRUE AS median_near FROM lineitem"""
        for c in _PARTED
    ),
)
def ag6_merged(spark, sf):
    """The profile of all rows from the written sketches of each month; estimates are held against
    the exact distinct count (5 %) and the exact ranks of the median (2 % of the rows)."""
    items = roles.table(spark, sf, "lineitem")
    monthly = items.withColumn("month", month_start(F.col("l_shipdate").cast("date")))
    merged = materialise(P.merged_profile(materialise(P.profile_parts(monthly, ["month"], _PARTED), "profile-parts")), "merged-profile")
    exact = P.cardinality_profile(items, _PARTED).select("column", F.col("distinct_values").alias("exact"))
    cells = items.select(*[F.col(c).cast("double").alias(c) for c in _PARTED]).unpivot([], _PARTED, "column", "value")
    ranks = cells.join(merged.select("column", "p50"), "column").groupBy("column").agg(
        F.avg((F.col("value") < F.col("p50")).cast("double")).alias("below"),
        F.avg((F.col("value") <= F.col("p50")).cast("double")).alias("upto"),
    )
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.col("exact") * 0.05
    return merged.join(exact, "column").join(ranks, "column").select(
        "column", "rows", "known", "least", "most", near.alias("distinct_near"),
        ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"),
    )


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "ag7_correlation_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + 0e0 AS corr FROM lineitem"
        for a, b in combinations(_CORR, 2)
    ),
)
def ag7(spark, sf):
    return P.corr_long(roles.table(spark, sf, "lineitem"), _CORR).select("column_a", "column_b", r6("corr"))


#: every measure over all rows and over the rows of one flag, so that pairs of two flags share no row
_MASKED = {f"{c}_{flag or 'all'}": (c, flag) for c in _CORR for flag in (None, "A", "N", "R")}


def _masked(name: str) -> str:
    column, flag = _MASKED[name]
    return f"CASE WHEN l_returnflag = '{flag}' THEN {column} END" if flag else column


@query(
    "ag7_correlation_tiles",
    "WITH wide AS (SELECT "
    + ", ".join(f"{_masked(n)} AS {n}" for n in _MASKED)
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + 0e0 AS corr FROM wide"
        for a, b in combinations(_MASKED, 2)
    ),
)
def ag7_tiles(spark, sf):
    wide = roles.table(spark, sf, "lineitem").select(*[F.expr(_masked(n)).alias(n) for n in _MASKED])
    return P.corr_long(wide, list(_MASKED)).select("column_a", "column_b", r6("corr"))


@query(
    "ag7_correlation_with_target",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(corr({c}, CAST(l_linestatus = 'F' AS INTEGER)), 6) + 0e0 AS corr FROM lineitem"
        for c in _CORR
    ),
)
def ag7_target(spark, sf):
    df = roles.table(spark, sf, "lineitem")
    return P.corr_with_target(df, _CORR, F.col("l_linestatus") == "F").select("column", r6("corr"))


@query(
    "ag8_first_valid_date",
    sql(
        "panel divs",
        """
SELECT p.asset, min(p.date) AS first_date, min(CASE WHEN d.value IS NOT NULL THEN p.date END) AS first_valid,
       max(CASE WHEN d.value IS NOT NULL THEN p.date END) AS last_valid,
       CAST(min(CASE WHEN d.value IS NOT NULL THEN p.date END) - min(p.date) AS INTEGER) AS days_to_valid
FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date GROUP BY 1""",
    ),
)
def ag8(spark, sf):
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value")
    return P.first_valid(roles.panel(spark, sf).join(paid, ["asset", "date"], "left"), "asset", "date", "value")


@query(
    "ag9_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def ag9(spark, sf):
    return P.duplicate_keys(roles.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "ag10_share_of_total",
    "SELECT l_returnflag, l_linestatus, count(*) AS rows, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) + 0e0 AS share_pct FROM lineitem GROUP BY 1, 2",
)
def ag10(spark, sf):
    df = P.share_of_total(roles.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return df.select("l_returnflag", "l_linestatus", "rows", r6("share_pct"))


@query(
    "ag11_monthly_totals",
    sql(
        "divs",
        "SELECT asset, CAST(date_trunc('month', payment_date) AS DATE) AS month, round(sum(value), 6) + 0e0 AS monthly_total FROM divs GROUP BY 1, 2",
    ),
)
def ag11(spark, sf):
    df = P.monthly_sum(roles.dividends(spark, sf), "asset", "payment_date", "value")
    return df.select("asset", "month", r6("monthly_total"))


@query(
    "ag12_variation_coefficient",
    "SELECT l_partkey, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN stddev_pop(l_extendedprice) / avg(l_extendedprice) END, 6) + 0e0 AS cv FROM lineitem GROUP BY 1",
)
def ag12(spark, sf):
    df = roles.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), A.variation_coefficient(F.col("l_extendedprice"), 3).alias("cv")
    )
    return df.select("l_partkey", "n", r6("cv"))


@query(
    "ag13_compounded_return",
    sql(
        "rp",
        "SELECT asset, CAST(year(date) AS INTEGER) AS y, round(exp(sum(ln(1 + total_return))) - 1, 6) + 0e0 AS compounded FROM rp GROUP BY 1, 2",
    ),
)
def ag13(spark, sf):
    df = roles.return_cells(spark, sf).groupBy("asset", F.year("date").alias("y")).agg(
        A.compound(F.col("total_return")).alias("compounded")
    )
    return df.select("asset", "y", r6("compounded"))


@query(
    "ag14_weighted_mean",
    """
SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) + 0e0 AS weighted_discount, round(stddev_pop(l_discount), 8) + 0e0 AS std_pop,
       round(stddev_samp(l_discount), 8) + 0e0 AS std_samp FROM lineitem GROUP BY 1""",
)
def ag14(spark, sf):
    return roles.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("weighted_discount"),
        F.round(F.stddev_pop("l_discount"), 8).alias("std_pop"),
        F.round(F.stddev_samp("l_discount"), 8).alias("std_samp"),
    )


@query(
    "ag15_best_row_per_group",
    """
SELECT o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1""",
)
def ag15(spark, sf):
    df = roles.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return P.best_by(df, ["o_orderpriority"], F.col("o_totalprice"), ["o_orderkey"])


@query(
    "ag16_monthly_mean",
    sql(
        "rp",
        "SELECT asset, CAST(date_trunc('month', date) AS DATE) AS month, round(avg(total_return), 8) + 0e0 AS total_return FROM rp GROUP BY 1, 2",
    ),
)
def ag16(spark, sf):
    df = P.monthly_mean(roles.return_cells(spark, sf), "date", ["total_return"], ["asset"])
    return df.select("asset", "month", F.round("total_return", 8).alias("total_return"))
