"""Join queries (survey ids JN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import calendar as cal
from panelloom.operators import features as feat
from panelloom.operators import joins, versions
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.queries.windows import r6
from panelloom.sources.tables import bucketed, materialise, scratch_dir, table_name


@query(
    "jn1_inner_composite_key",
    sql("panel divs", "SELECT p.asset, p.date, p.close, d.value FROM panel p JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date"),
)
def jn1(spark, sf):
    p, d = roles.panel(spark, sf).alias("p"), roles.dividends(spark, sf).alias("d")
    return p.join(d, (F.col("p.asset") == F.col("d.asset")) & (F.col("p.date") == F.col("d.ex_date")), "inner").select(
        "p.asset", "p.date", "p.close", "d.value"
    )


@query(
    "jn2_left_composite_key",
    sql("panel divs", "SELECT p.asset, p.date, p.close, d.value FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date"),
)
def jn2(spark, sf):
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value")
    return roles.panel(spark, sf).join(paid, ["asset", "date"], "left").select("asset", "date", "close", "value")


@query(
    "jn2_bucketed_tables",
    sql("panel divs", "SELECT p.asset, p.date, p.close, d.value FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date"),
)
def jn2_bucketed(spark, sf):
    """The same join over tables that are stored by its keys: no exchange."""
    paid = roles.dividends(spark, sf).select("asset", F.col("ex_date").alias("date"), "value")
    sides = {"panel": roles.panel(spark, sf).select("asset", "date", "close"), "paid": paid}
    stored = {n: bucketed(df, table_name(n), ["asset", "date"], 8, location=scratch_dir(spark, n)) for n, df in sides.items()}
    return stored["panel"].join(stored["paid"], ["asset", "date"], "left").select("asset", "date", "close", "value")


@query(
    "jn3_attach_series",
    sql("panel macro_daily", "SELECT p.asset, p.date, p.close, m.macro_a, m.macro_b FROM panel p LEFT JOIN macro_daily m USING (date)"),
)
def jn3(spark, sf):
    out = joins.attach_series(
        roles.panel(spark, sf), roles.macro_daily(spark, sf), {"macro_a": "macro_a", "macro_b": "macro_b"}
    )
    return out.select("asset", "date", "close", "macro_a", "macro_b")


@query(
    "jn4_publication_lag",
    sql(
        "panel macro_monthly",
        """
SELECT p.asset, p.date, c.macro_c, d.macro_d
FROM panel p
LEFT JOIN macro_monthly c ON c.month = CASE WHEN day(p.date) < 15 THEN date_trunc('month', p.date) - INTERVAL 2 MONTH ELSE date_trunc('month', p.date) - INTERVAL 1 MONTH END
LEFT JOIN macro_monthly d ON d.month = date_trunc('month', p.date) - INTERVAL 2 MONTH""",
    ),
)
def jn4(spark, sf):
    rules = {"macro_c": "mid_month", "macro_d": "always_two"}
    df = joins.lagged_month_join(roles.written_panel(spark, sf), roles.macro_monthly(spark, sf), rules)
    return df.select("asset", "date", "macro_c", "macro_d")


@query(
    "jn5_trailing_months",
    sql(
        "panel divs",
        """
WITH monthly AS (SELECT asset, CAST(date_trunc('month', payment_date) AS DATE) AS month, sum(value) AS total FROM divs GROUP BY 1, 2)
SELECT p.asset, p.date, count(m.total) AS paid_months, round(sum(m.total), 6) + 0e0 AS total_12m,
       round(CASE WHEN count(m.total) >= 3 THEN stddev_pop(m.total) / avg(m.total) END, 6) + 0e0 AS dividend_stability
FROM panel p LEFT JOIN monthly m ON m.asset = p.asset AND m.month < date_trunc('month', p.date)
     AND m.month >= date_trunc('month', p.date) - INTERVAL 12 MONTH
GROUP BY 1, 2""",
    ),
)
def jn5(spark, sf):
    panel, events = roles.written_panel(spark, sf), roles.dividends(spark, sf)
    df = joins.trailing_months_agg(
        panel.select("asset", "date"),
        events,
        12,
        {
            "paid_months": lambda total, frame: F.count(total).over(frame),
            "total_12m": lambda total, frame: F.sum(total).over(frame),
            "dividend_stability": lambda total, frame: F.when(
                F.count(total).over(frame) >= 3, F.stddev_pop(total).over(frame) / F.avg(total).over(frame)
            ),
        },
    )
    return df.select("asset", "date", "paid_months", r6("total_12m"), r6("dividend_stability"))


@query(
    "jn6_asof_backward",
    sql("panel macro_daily", "SELECT p.asset, p.date, m.macro_a, m.date AS macro_date FROM panel p ASOF LEFT JOIN macro_daily m ON p.date >= m.date"),
)
def jn6(spark, sf):
    series = roles.macro_daily(spark, sf).withColumn("macro_date", F.col("date"))
    out = joins.asof_join(roles.written_panel(spark, sf), series, "date", columns=["macro_a", "macro_date"])
    return out.select("asset", "date", "macro_a", "macro_date")


@query(
    "jn6_asof_keyed_forward",
    sql(
        "panel divs",
        "SELECT p.asset, p.date, d.ex_date AS next_ex_date, d.value AS next_value FROM panel p ASOF LEFT JOIN divs d ON p.asset = d.asset AND p.date <= d.ex_date",
    ),
)
def jn6_forward(spark, sf):
    events = roles.dividends(spark, sf).select(
        "asset", F.col("ex_date").alias("date"), F.col("ex_date").alias("next_ex_date"), F.col("value").alias("next_value")
    )
    out = joins.asof_join(
        roles.written_panel(spark, sf), events, "date", by=["asset"], columns=["next_ex_date", "next_value"], direction="forward"
    )
    return out.select("asset", "date", "next_ex_date", "next_value")


@query(
    "jn7_next_session",
    sql(
        "panel",
        """
SELECT p.asset, p.date, (SELECT min(q.date) FROM panel q WHERE q.date > p.date) AS execution_date FROM panel p""",
    ),
)
def jn7(spark, sf):
    return cal.next_session(roles.written_panel(spark, sf)).select("asset", "date", "execution_date")


@query(
    "jn8_holding_window",
    sql(
        "periods",
        "SELECT signal_date, execution_date, asset, round(period_return, 6) + 0e0 AS period_return, sessions_held, start_date, end_date FROM periods",
    ),
)
def jn8(spark, sf):
    return roles.periods(roles.market(spark, sf)).select(
        "signal_date", "execution_date", "asset", r6("period_return"), "sessions_held", "start_date", "end_date"
    )


@query(
    "jn9_range_compound",
    sql(
        "periods rb",
        """
SELECT p.signal_date, p.asset, round(product(1 + b.bench_return) - 1, 6) + 0e0 AS bench_period_return
FROM periods p LEFT JOIN rb b ON b.date BETWEEN p.start_date AND p.end_date GROUP BY 1, 2""",
    ),
)
def jn9(spark, sf):
    market = roles.market(spark, sf)
    out = joins.range_compound(materialise(roles.periods(market), "periods"), market.bench, "bench_return")
    return out.select("signal_date", "asset", r6("bench_period_return"))


def _versions(spark, sf):
    """The panel, and a second version of it in which some values changed or went missing."""
    a = roles.written_panel(spark, sf)
    volume = F.col("volume")
    b = a.select(
        "asset",
        "date",
        F.when(volume == 2, F.col("close") + 1).otherwise(F.col("close")).alias("close"),
        F.when(volume != 3, F.col("adj_close")).alias("adj_close"),
        "volume",
    )
    return a, b


@query(
    "jn10_compare_versions",
    sql(
        "panel",
        """
SELECT 'close' AS "column", (SELECT count(*) FROM panel) AS matched_keys, count(*) AS differing FROM panel WHERE volume = 2
UNION ALL SELECT 'adj_close', (SELECT count(*) FROM panel), count(*) FROM panel WHERE volume = 3
UNION ALL SELECT 'volume', (SELECT count(*) FROM panel), 0""",
    ),
)
def jn10(spark, sf):
    a, b = _versions(spark, sf)
    return versions.compare_tables(a, materialise(b, "version"), ["asset", "date"], ["close", "adj_close", "volume"])


@query(
    "jn10_changed_cells",
    sql(
        "panel",
        """
SELECT asset, date, 'close' AS "column", close AS before, close + 1 AS after FROM panel WHERE volume = 2
UNION ALL SELECT asset, date, 'adj_close', adj_close, NULL FROM panel WHERE volume = 3""",
    ),
)
def jn10_cells(spark, sf):
    a, b = _versions(spark, sf)
    cells = versions.changed_cells(a, materialise(b, "version"), ["asset", "date"], ["close", "adj_close", "volume"])
    return cells.select("asset", "date", "column", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"))


@query(
    "jn11_key_coverage",
    sql(
        "panel macro_daily",
        """
WITH a AS (SELECT DISTINCT date FROM panel), b AS (SELECT DISTINCT date FROM macro_daily)
SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b,
       (SELECT count(*) FROM a WHERE date IN (SELECT date FROM b)) AS in_both,
       (SELECT count(*) FROM a WHERE date NOT IN (SELECT date FROM b)) AS only_a,
       (SELECT count(*) FROM b WHERE date NOT IN (SELECT date FROM a)) AS only_b""",
    ),
)
def jn11(spark, sf):
    return joins.coverage(roles.panel(spark, sf), roles.macro_daily(spark, sf), ["date"])


# A quarterly retraining schedule over the whole calendar: the first model is trained on 27 months, and each
# is valid for the quarter after its training ends.
SCHEDULE_SQL = """(SELECT 'Q' || quarter(t) || ' ' || year(t) AS model_id, t AS train_end, last_day(t + INTERVAL 3 MONTH) AS valid_until
FROM (SELECT last_day(CAST(unnest(generate_series(a, b, INTERVAL 3 MONTH)) AS DATE)) AS t
      FROM (SELECT date_trunc('month', min(o_orderdate)) + INTERVAL 26 MONTH AS a, max(o_orderdate) AS b FROM orders))) s"""


def schedule(spark, sf):
    first = F.add_months(F.trunc(F.min("o_orderdate"), "month"), 26)
    span = roles.table(spark, sf, "orders").agg(first.alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    ends = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 3 MONTH"))).alias("t")).select(F.last_day("t").alias("t"))
    return ends.select(
        F.concat(F.lit("Q"), F.quarter("t"), F.lit(" "), F.year("t")).alias("model_id"),
        F.col("t").alias("train_end"),
        F.last_day(F.add_months("t", 3)).alias("valid_until"),
    )


@query(
    "jn12_schedule_lookup",
    sql(
        "rp_cal",
        f"""
SELECT c.date, arg_min(s.model_id, s.valid_until) AS model_id, min(s.valid_until) AS valid_until
FROM rp_cal c LEFT JOIN {SCHEDULE_SQL} ON c.date <= s.valid_until GROUP BY 1""",
    ),
)
def jn12(spark, sf):
    dates = cal.sessions(roles.market(spark, sf).returns).select("date")
    out = joins.schedule_lookup(dates, schedule(spark, sf))
    return out.select("date", "model_id", "valid_until")
