"""Projection, filter, sort, limit and set queries (survey ids PRJ*, ST*, SE*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import calendar as cal
from panelloom.operators import joins, profiles
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.sources.tables import materialise


@query("prj1_select_alias", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS price FROM orders")
def prj1(spark, sf):
    return roles.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("price")
    )


@query(
    "prj2_flag_from_predicate",
    "SELECT l_orderkey, l_linenumber, COALESCE(nullif(l_tax, 0) > 0.02e0, false) AS is_taxed FROM lineitem",
)
def prj2(spark, sf):
    taxed = F.nullif(F.col("l_tax"), F.lit(0.0)) > 0.02
    return roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.flag(taxed).alias("is_taxed"))


@query(
    "prj3_comparison_keeps_null",
    "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) > 0.05e0 AS is_high FROM lineitem",
)
def prj3(spark, sf):
    return roles.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.nullif(F.col("l_discount"), F.lit(0.0)) > 0.05).alias("is_high")
    )


@query(
    "prj4_null_default",
    """SELECT o.o_orderkey, l.l_linenumber, COALESCE(nullif(l.l_discount, 0), 1e0) AS discount, COALESCE(l.l_quantity, 0e0) AS quantity
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey""",
)
def prj4(spark, sf):
    lines = roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_discount", "l_quantity")
    joined = roles.table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    discount = F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.lit(1.0))
    return joined.select("o_orderkey", "l_linenumber", discount.alias("discount"), F.coalesce("l_quantity", F.lit(0.0)).alias("quantity"))


@query(
    "prj5_safe_division",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem",
)
def prj5(spark, sf):
    return roles.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.safe_div(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio")
    )


@query(
    "prj6_banding",
    """
SELECT band, count(*) AS n FROM (
  SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium'
              WHEN o_totalprice < 400000 THEN 'large' ELSE 'huge' END AS band FROM orders) GROUP BY 1""",
)
def prj6(spark, sf):
    label = S.band(F.col("o_totalprice"), [50000, 200000, 400000], ["small", "medium", "large", "huge"])
    return roles.table(spark, sf, "orders").groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj7_predicates",
    """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' AND o_totalprice BETWEEN 100000 AND 300000
       AND o_orderdate IS NOT NULL) OR (o_orderpriority = '5-LOW' AND o_totalprice > 450000) OR o_orderstatus = ''""",
)
def prj7(spark, sf):
    p = F.col("o_orderpriority")
    wanted = (
        p.isin("1-URGENT", "2-HIGH")
        & (F.col("o_orderstatus") != "F")
        & F.col("o_totalprice").between(100000, 300000)
        & F.col("o_orderdate").isNotNull()
    )
    big = (p == "5-LOW") & (F.col("o_totalprice") > 450000)
    orders = roles.table(spark, sf, "orders")
    return orders.where(wanted | big | (F.col("o_orderstatus") == "")).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "prj8_math",
    """
SELECT l_orderkey, l_linenumber, round(ln(1 + l_discount), 9) + 0e0 AS log_growth, round(exp(l_tax) - 1, 9) + 0e0 AS growth,
       abs(l_discount - l_tax) AS distance, round(sqrt(l_quantity), 9) + 0e0 AS root, round(power(1 + l_tax, 2), 9) + 0e0 AS squared
FROM lineitem""",
)
def prj8(spark, sf):
    return roles.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.log1p("l_discount"), 9).alias("log_growth"),
        F.round(F.expm1("l_tax"), 9).alias("growth"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("distance"),
        F.round(F.sqrt("l_quantity"), 9).alias("root"),
        F.round(F.pow(1 + F.col("l_tax"), 2), 9).alias("squared"),
    )


@query(
    "prj9_dates",
    """
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(day(d) AS INTEGER) AS dom, CAST(date_trunc('month', d) AS DATE) AS month,
       CAST(d - INTERVAL 2 MONTH AS DATE) AS two_back, CAST(d - DATE '1995-01-01' AS INTEGER) AS days, strftime(d, '%Y-%m') AS period
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def prj9(spark, sf):
    d = F.to_date("o_orderdate")
    return roles.table(spark, sf, "orders").select(
        "o_orderkey",
        F.year(d).alias("y"),
        F.dayofmonth(d).alias("dom"),
        S.month_start(d).alias("month"),
        F.add_months(d, -2).alias("two_back"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_format(d, "yyyy-MM").alias("period"),
    )


@query(
    "prj10_strings",
    r"""
SELECT page_id, regexp_extract(url, 'https?://([^/?#]+)', 1) AS host, replace(url, 'http://', 'https://') AS secure_url,
       regexp_matches(lower(url), 'future|target|next|page') AS is_suspicious, contains(url, '?') AS has_query FROM pages""",
)
def prj10(spark, sf):
    url = F.col("url")
    return roles.table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract(url, r"https?://([^/?#]+)", 1).alias("host"),
        F.replace(url, F.lit("http://"), F.lit("https://")).alias("secure_url"),
        F.lower(url).rlike("future|target|next|page").alias("is_suspicious"),
        F.contains(url, F.lit("?")).alias("has_query"),
    )


@query(
    "prj11_casts",
    """
SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER) AS is_bulk, CAST(l_returnflag = 'R' AS INTEGER)::DOUBLE AS is_returned,
       TRY_CAST(CASE WHEN l_linestatus = 'F' THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS BIGINT) AS parsed FROM lineitem""",
)
def prj11(spark, sf):
    text = F.when(F.col("l_linestatus") == "F", F.lit("n/a")).otherwise(F.col("l_linenumber").cast("string"))
    return roles.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") > 25).cast("int").alias("is_bulk"),
        (F.col("l_returnflag") == "R").cast("double").alias("is_returned"),
        text.try_cast("bigint").alias("parsed"),
    )


@query(
    "prj12_nonfinite_to_null",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem""",
)
def prj12(spark, sf):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    dirty = F.when(F.col("l_discount") == 0, inf).when(F.col("l_tax") == 0, nan).otherwise(
        S.safe_div(F.col("l_tax"), F.col("l_discount"))
    )
    return roles.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.null_if_nonfinite(dirty).alias("ratio")
    )


@query(
    "st1_order_by",
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
)
def st1(spark, sf):
    return (
        roles.table(spark, sf, "orders")
        .select("o_orderpriority", "o_orderkey", "o_totalprice")
        .orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey")
    )


@query("st2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def st2(spark, sf):
    return roles.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey"
    ).limit(20)


@query(
    "st3_head_per_group",
    sql(
        "rp_cal",
        """
SELECT y, date FROM (SELECT CAST(year(date) AS INTEGER) AS y, date, row_number() OVER (PARTITION BY year(date) ORDER BY date) AS i FROM rp_cal) WHERE i <= 3""",
    ),
)
def st3(spark, sf):
    dates = cal.sessions(roles.market(spark, sf).returns).select(F.year("date").alias("y"), "date")
    return profiles.head_per_group(dates, ["y"], [F.col("date")], 3)


@query("st4_seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def st4(spark, sf):
    orders = roles.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return profiles.seeded_sample(orders, 100, 42, ["o_orderkey"])


@query(
    "st5_nearest_to_value",
    sql("scored", "SELECT row_id, prob FROM scored ORDER BY abs(prob - 0.5e0), row_id LIMIT 5"),
)
def st5(spark, sf):
    return profiles.nearest_to(roles.scored_orders(spark, sf).select("row_id", "prob"), "prob", 0.5, 5, ["row_id"])


@query(
    "se1_union_labelled",
    sql(
        "panel divs macro_daily",
        """
SELECT 'prices' AS source, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM panel
UNION ALL SELECT 'dividends', count(*), min(ex_date), max(ex_date) FROM divs
UNION ALL SELECT 'macro', count(*), min(date), max(date) FROM macro_daily""",
    ),
)
def se1(spark, sf):
    def span(df, date):
        return df.agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))

    return profiles.union_labelled(
        {
            "prices": span(roles.panel(spark, sf), "date"),
            "dividends": span(roles.dividends(spark, sf), "ex_date"),
            "macro": span(roles.macro_daily(spark, sf), "date"),
        }
    )


@query(
    "se2_concat_fold_predictions",
    sql(
        "pred",
        """
SELECT 'fold_' || year(signal_date) AS source, signal_date, asset, prob FROM pred""",
    ),
)
def se2(spark, sf):
    preds = roles.predictions(roles.market(spark, sf)).select("signal_date", "asset", "prob")
    return preds.select(F.concat(F.lit("fold_"), F.year("signal_date")).alias("source"), "signal_date", "asset", "prob")


@query(
    "se4_key_difference",
    sql("panel divs", "SELECT asset, ex_date AS date FROM divs EXCEPT SELECT asset, date FROM panel"),
)
def se4(spark, sf):
    events = roles.dividends(spark, sf).withColumnRenamed("ex_date", "date")
    return joins.missing_keys(events, roles.panel(spark, sf), ["asset", "date"])
