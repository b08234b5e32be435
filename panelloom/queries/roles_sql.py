"""SQL counterparts of the roles: name -> (roles it uses, SELECT text)."""

_MEAN = "CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100e0)"


def mean(column: str) -> str:
    return _MEAN.format(c=column)


CTES: dict[str, tuple[str, str]] = {
    "panel": (
        "",
        """
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date,
         arg_max(o_totalprice, o_orderkey) AS close, min(o_totalprice) AS adj_close, count(*) AS volume
  FROM orders GROUP BY 1, 2""",
    ),
    "bench": (
        "",
        f"""
  SELECT CAST(o_orderdate AS DATE) AS date, {mean('o_totalprice')} AS close FROM orders GROUP BY 1""",
    ),
    "shipped": (
        "",
        """
  SELECT l.*, o_orderpriority AS asset, CAST(l_shipdate AS DATE) AS date
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "divs": (
        "shipped",
        """
  SELECT asset, date AS ex_date, date + 10 AS payment_date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 1e6 AS value
  FROM shipped WHERE l_returnflag = 'R' GROUP BY asset, date""",
    ),
    "macro_daily": (
        "",
        f"""
  SELECT CAST(l_shipdate AS DATE) AS date, {mean('l_discount')} AS macro_a, {mean('l_quantity')} AS macro_b
  FROM lineitem GROUP BY 1""",
    ),
    "macro_monthly": (
        "",
        f"""
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {mean('l_tax')} AS macro_c,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS macro_d
  FROM lineitem GROUP BY 1""",
    ),
    "tr": (
        "panel divs",
        """
  SELECT asset, date, close, close_prev, volume, has_trading, dividend_value,
         (close - close_prev) / close_prev AS price_return,
         dividend_value / close_prev AS dividend_return,
         (close - close_prev) / close_prev + dividend_value / close_prev AS total_return
  FROM (SELECT p.asset, p.date, p.close, p.volume,
               lag(p.close) OVER (PARTITION BY p.asset ORDER BY p.date) AS close_prev,
               COALESCE(p.volume > 0, false) AS has_trading, COALESCE(d.value, 0e0) AS dividend_value
        FROM panel p LEFT JOIN divs d ON d.asset = p.asset AND d.ex_date = p.date)""",
    ),
    "br": (
        "bench",
        """
  SELECT date, close AS bench_close,
         (close - lag(close) OVER (ORDER BY date)) / lag(close) OVER (ORDER BY date) AS bench_return
  FROM bench""",
    ),
    "rp": (
        "shipped",
        f"""
  SELECT asset, date, {mean('l_discount')} - 0.05e0 AS total_return,
         ((max(l_orderkey) * 7919) % 1000) / 1000e0 AS prob
  FROM shipped GROUP BY asset, date""",
    ),
    "rb": (
        "",
        f"""
  SELECT CAST(l_shipdate AS DATE) AS date, {mean('l_discount')} - 0.05e0 AS bench_return
  FROM lineitem GROUP BY 1""",
    ),
    "rp_cal": (
        "rp",
        """
  SELECT date, row_number() OVER (ORDER BY date) AS session_idx, lead(date) OVER (ORDER BY date) AS next_session
  FROM (SELECT DISTINCT date FROM rp)""",
    ),
    "pred": (
        "rp rb rp_cal",
        """
  SELECT a.date AS signal_date, c.next_session AS execution_date, a.asset, a.prob,
         a.own > b.own AS target, a.own - b.own AS alpha
  FROM (SELECT asset, date, prob, CASE WHEN count(total_return) OVER w = 7
               THEN product(1 + total_return) OVER w - 1 END AS own
        FROM rp WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) a
  JOIN (SELECT date, CASE WHEN count(bench_return) OVER w = 7
               THEN product(1 + bench_return) OVER w - 1 END AS own
        FROM rb WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) b USING (date)
  JOIN rp_cal c USING (date)
  WHERE a.own IS NOT NULL AND b.own IS NOT NULL""",
    ),
    "rebal": (
        "pred",
        """
  SELECT * FROM pred WHERE signal_date IN (
    SELECT signal_date FROM (SELECT signal_date, row_number() OVER (ORDER BY signal_date) AS i
                             FROM (SELECT DISTINCT signal_date FROM pred)) WHERE (i - 1) % 7 = 0)""",
    ),
    "rp_idx": (
        "rp",
        """
  SELECT asset, date, total_return, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM rp""",
    ),
    "periods": (
        "rebal rp_idx",
        """
  SELECT signal_date, execution_date, asset, prob, target, alpha,
         CASE WHEN count(r.i) = 7 THEN product(1 + r.total_return) - 1 END AS period_return,
         count(r.i) AS sessions_held, min(r.date) AS start_date, max(r.date) AS end_date
  FROM (SELECT p.*, (SELECT count(*) FROM rp_idx x WHERE x.asset = p.asset AND x.date <= p.execution_date) AS e
        FROM rebal p) q
  LEFT JOIN rp_idx r USING (asset)
  WHERE r.i BETWEEN q.e + 1 AND q.e + 7
  GROUP BY ALL
  UNION ALL
  SELECT p.signal_date, p.execution_date, p.asset, p.prob, p.target, p.alpha, NULL, 0, NULL, NULL
  FROM rebal p WHERE NOT EXISTS (SELECT 1 FROM rp_idx x WHERE x.asset = p.asset AND x.date > p.execution_date)""",
    ),
    "scored": (
        "",
        """
  SELECT o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS date,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS segment,
         ((o_orderkey * 7919) % 1000) / 1000e0 AS prob, o_totalprice > 250000 AS label
  FROM orders""",
    ),
    "ranked_pred": (
        "pred",
        "SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY prob DESC, asset) AS rank FROM pred",
    ),
    "ranked_rebal": (
        "periods",
        "SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY prob DESC, asset) AS rank FROM periods",
    ),
    "weights": (
        "ranked_rebal",
        """
  SELECT 'top1' AS strategy, signal_date, asset, CASE WHEN rank = 1 THEN 1e0 ELSE 0e0 END AS weight FROM ranked_rebal
  UNION ALL SELECT 'top2', signal_date, asset, CASE WHEN rank <= 2 THEN 0.5e0 ELSE 0e0 END FROM ranked_rebal
  UNION ALL SELECT 'threshold', signal_date, asset, CASE WHEN prob >= 0.55e0
      THEN 1e0 / sum(CASE WHEN prob >= 0.55e0 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_date) ELSE 0e0 END FROM ranked_rebal
  UNION ALL SELECT 'equal_weight', signal_date, asset, 1e0 / count(*) OVER (PARTITION BY signal_date) FROM ranked_rebal
  UNION ALL SELECT 'random', signal_date, asset, CASE WHEN asset = arg_min(asset, md5('42|' || CAST(signal_date AS VARCHAR) || '|' || asset))
      OVER (PARTITION BY signal_date) THEN 1e0 ELSE 0e0 END FROM ranked_rebal""",
    ),
    "gross": (
        "weights periods",
        """
  SELECT strategy, signal_date, sum(weight * COALESCE(period_return, 0e0)) AS gross_return
  FROM weights JOIN periods USING (signal_date, asset) GROUP BY 1, 2""",
    ),
    "wgrid": (
        "weights",
        """
  SELECT g.strategy, g.signal_date, g.asset, COALESCE(w.weight, 0e0) AS weight,
         lag(COALESCE(w.weight, 0e0), 1, 0e0) OVER (PARTITION BY g.strategy, g.asset ORDER BY g.signal_date) AS prev_weight
  FROM (SELECT s.strategy, d.signal_date, a.asset FROM (SELECT DISTINCT strategy FROM weights) s,
        (SELECT DISTINCT signal_date FROM weights) d, (SELECT DISTINCT asset FROM weights) a) g
  LEFT JOIN weights w ON w.strategy = g.strategy AND w.signal_date = g.signal_date AND w.asset = g.asset""",
    ),
    "traded": (
        "wgrid",
        """
  SELECT strategy, signal_date, bought, sold, abs_change,
         CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY signal_date) = 1 THEN 1e0 ELSE abs_change * 0.5e0 END AS turnover
  FROM (SELECT strategy, signal_date, sum(greatest(weight - prev_weight, 0e0)) AS bought,
               sum(greatest(prev_weight - weight, 0e0)) AS sold, sum(abs(weight - prev_weight)) AS abs_change
        FROM wgrid GROUP BY 1, 2)""",
    ),
    "net": (
        "gross traded",
        """
  SELECT scenario, rate, strategy, signal_date, gross_return, turnover, turnover * rate AS cost,
         gross_return - turnover * rate AS net_return,
         100000e0 * product(1 + gross_return - turnover * rate) OVER (PARTITION BY scenario, strategy ORDER BY signal_date) AS capital,
         product(1 + gross_return - turnover * rate) OVER (PARTITION BY scenario, strategy ORDER BY signal_date) - 1 AS cumulative_return
  FROM gross JOIN traded USING (strategy, signal_date),
       (VALUES ('zero', 0e0), ('0.05%', 0.0005e0), ('0.10%', 0.001e0), ('0.20%', 0.002e0), ('0.30%', 0.003e0)) v(scenario, rate)""",
    ),
    "bcurve": (
        "periods rb",
        """
  SELECT signal_date, bench_period_return,
         100000e0 * product(1 + bench_period_return) OVER (ORDER BY signal_date) AS capital,
         product(1 + bench_period_return) OVER (ORDER BY signal_date) - 1 AS cumulative_return
  FROM (SELECT p.signal_date, COALESCE(product(1 + b.bench_return) - 1, 0e0) AS bench_period_return
        FROM (SELECT signal_date,
                     CASE WHEN arg_min(COALESCE(period_return, 'nan'::DOUBLE), asset) <> 'nan'::DOUBLE THEN arg_min(COALESCE(start_date, DATE '1900-01-01'), asset) END AS start_date,
                     CASE WHEN arg_min(COALESCE(period_return, 'nan'::DOUBLE), asset) <> 'nan'::DOUBLE THEN arg_min(COALESCE(end_date, DATE '1900-01-01'), asset) END AS end_date
              FROM periods GROUP BY signal_date) p
        LEFT JOIN rb b ON b.date BETWEEN p.start_date AND p.end_date
        GROUP BY p.signal_date)""",
    ),
    "line_rows": (
        "",
        """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id, l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date,
         ((l_orderkey * 7919 + l_linenumber * 31) % 1000) / 1000e0 AS prob, l_linestatus = 'F' AS label,
         l_quantity, l_discount, l_tax, l_extendedprice
  FROM lineitem""",
    ),
    "attr": (
        "line_rows",
        """
  SELECT row_id, asset, date, prob, label, 'l_quantity' AS feature, l_quantity AS value,
         0.0314159265e0 * (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) AS contribution FROM line_rows
  UNION ALL SELECT row_id, asset, date, prob, label, 'l_discount', l_discount,
         -4.1421356237e0 * (l_discount - (SELECT avg(l_discount) FROM lineitem)) FROM line_rows
  UNION ALL SELECT row_id, asset, date, prob, label, 'l_tax', l_tax,
         2.7182818284e0 * (l_tax - (SELECT avg(l_tax) FROM lineitem)) FROM line_rows
  UNION ALL SELECT row_id, asset, date, prob, label, 'l_extendedprice', l_extendedprice,
         0.0000161803398e0 * (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) FROM line_rows""",
    ),
}
