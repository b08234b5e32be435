"""Split, purge and imputation queries (survey ids SP*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.scalars import month_start
from panelloom.operators import calendar as cal
from panelloom.operators import splits
from panelloom.queries import roles
from panelloom.queries.joining import SCHEDULE_SQL, schedule
from panelloom.queries.registry import query, sql
from panelloom.queries.windows import r6
from panelloom.sources.tables import materialise

# Yearly evaluation folds with an expanding training span, over the whole calendar of the orders.
FOLDS_SQL = """(SELECT y::VARCHAR AS fold, make_date(y - 1, 12, 31) AS train_end, make_date(y, 1, 1) AS eval_start, make_date(y, 12, 31) AS eval_end
FROM (SELECT unnest(range(a, b)) AS y FROM (SELECT year(min(o_orderdate)) + 3 AS a, year(max(o_orderdate)) + 1 AS b FROM orders))) f"""


def folds(spark, sf) -> list[dict]:
    return splits.yearly_folds(roles.table(spark, sf, "orders"), "o_orderdate")


@query(
    "sp1_temporal_split",
    sql(
        "rp",
        """
SELECT split, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, 0::BIGINT AS shared_rows
FROM (SELECT date, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split FROM rp)
GROUP BY 1""",
    ),
)
def sp1(spark, sf):
    df = splits.temporal_split(roles.market(spark, sf).returns, "date", "1998-12-31", "1999-12-31")
    return splits.split_overlap(df, "date")


_FOLD_ROWS = f"""
WITH m AS (SELECT rp.asset, rp.date, f.fold, CASE WHEN rp.date <= f.train_end THEN 'train' ELSE 'eval' END AS role
           FROM rp JOIN {FOLDS_SQL} ON rp.date <= f.train_end OR rp.date BETWEEN f.eval_start AND f.eval_end)
"""


@query(
    "sp2_expanding_folds",
    sql(
        "rp",
        _FOLD_ROWS + "SELECT fold, role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM m GROUP BY 1, 2",
    ),
)
def sp2(spark, sf):
    df = splits.expanding_folds(roles.return_cells(spark, sf), "date", folds(spark, sf))
    return df.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "sp3_evaluation_gap",
    sql(
        "rp",
        _FOLD_ROWS
        + """
SELECT fold, role, asset, date FROM (SELECT *, dense_rank() OVER (PARTITION BY fold, role ORDER BY date) AS i FROM m) WHERE role = 'train' OR i > 7""",
    ),
)
def sp3(spark, sf):
    df = splits.expanding_folds(roles.market(spark, sf).returns, "date", folds(spark, sf))
    return splits.eval_gap(df, 7).select("fold", "role", "asset", "date")


@query(
    "sp4_purged_training_rows",
    sql(
        "rp",
        """
WITH c AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM rp WHERE date <= DATE '1999-06-30'))
SELECT asset, date FROM rp WHERE date IN (SELECT date FROM c WHERE back >= 8)""",
    ),
)
def sp4(spark, sf):
    return splits.purge(roles.market(spark, sf).returns, "1999-06-30", 7).select("asset", "date")


@query(
    "sp5_retrain_plan",
    sql(
        "rp_cal",
        f"""
WITH s AS (SELECT * FROM {SCHEDULE_SQL}),
d AS (SELECT date AS signal_date FROM rp_cal WHERE (session_idx - 1) % 7 = 0),
p AS (SELECT s.*, (SELECT c.date FROM rp_cal c WHERE c.session_idx = (SELECT max(session_idx) FROM rp_cal x WHERE x.date <= s.train_end) - 7) AS purged_end FROM s)
SELECT d.signal_date, arg_min(p.model_id, p.valid_until) AS model_id, arg_min(p.train_end, p.valid_until) AS train_end,
       min(p.valid_until) AS valid_until, arg_min(p.purged_end, p.valid_until) AS purged_end
FROM d JOIN p ON d.signal_date <= p.valid_until GROUP BY 1""",
    ),
)
def sp5(spark, sf):
    calendar = materialise(cal.sessions(roles.market(spark, sf).returns), "sessions")
    dates = cal.every_nth_session(calendar, 7).select(F.col("date").alias("signal_date"))
    plan = splits.retrain_plan(dates, calendar, schedule(spark, sf), 7)
    return plan.select("signal_date", "model_id", "train_end", "valid_until", "purged_end")


@query(
    "sp6_non_overlapping_dates",
    sql("pred", "SELECT signal_date FROM (SELECT signal_date, row_number() OVER (ORDER BY signal_date) AS i FROM (SELECT DISTINCT signal_date FROM pred)) WHERE (i - 1) % 7 = 0"),
)
def sp6(spark, sf):
    preds = roles.predictions(roles.market(spark, sf))
    return cal.every_nth_session(cal.sessions(preds, "signal_date"), 7).select("signal_date")


@query(
    "sp7_impute_from_training_rows",
    sql(
        "panel divs",
        """
WITH j AS (SELECT p.asset, p.date, d.value FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date)
SELECT asset, date, round(COALESCE(value, (SELECT avg(value) FROM j WHERE date <= DATE '1998-12-31')), 6) + 0e0 AS value FROM j""",
    ),
)
def sp7(spark, sf):
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value")
    joined = materialise(roles.panel(spark, sf).join(paid, ["asset", "date"], "left").select("asset", "date", "value"), "joined")
    filled = splits.impute(joined, ["value"], fit_on=joined.where(F.col("date") <= "1998-12-31"))
    return filled.select("asset", "date", r6("value"))


@query(
    "sp7_impute_constant",
    sql(
        "panel divs",
        "SELECT p.asset, p.date, COALESCE(d.value, 0e0) AS value FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date",
    ),
)
def sp7_constant(spark, sf):
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value")
    joined = roles.panel(spark, sf).join(paid, ["asset", "date"], "left").select("asset", "date", "value")
    return splits.impute(joined, ["value"], constant=0.0)


@query(
    "sp8_monthly_folds",
    sql(
        "rp",
        """
WITH r AS (SELECT *, year(date) * 12 + month(date) AS m FROM rp), s AS (SELECT min(m) AS a, max(m) AS b FROM r),
t AS (SELECT UNNEST(range(a + 13, b + 1)) AS tm FROM s)
SELECT make_date(CAST((tm - 1) // 12 AS BIGINT), CAST((tm - 1) % 12 + 1 AS BIGINT), 1) AS test_month, CASE WHEN r.m = tm THEN 'test' ELSE 'train' END AS role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date
FROM r JOIN t ON r.m <= tm - 2 OR r.m = tm GROUP BY 1, 2""",
    ),
)
def sp8(spark, sf):
    returns = roles.market(spark, sf).returns
    months = returns.groupBy(month_start(F.col("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    return splits.monthly_folds(months, "month", 12, 1).groupBy("test_month", "role").agg(
        F.sum("rows").alias("rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )
