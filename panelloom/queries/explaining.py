"""Explanation queries over the attribution table of every line item (survey ids EX*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import explain as E
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.queries.windows import r6


def r9(name: str):
    """Nine digits: contributions of whole-number columns have few, and six would often be a tie."""
    return F.round(F.col(name), 9).alias(name)

_IMP = """
imp AS (SELECT feature, avg(abs(contribution)) AS importance, avg(contribution) AS mean_contribution, stddev_pop(contribution) AS std_contribution, count(*) AS rows FROM attr GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp)"""


@query(
    "ex1_global_importance",
    sql(
        "attr",
        f"WITH {_IMP.strip()} SELECT feature, round(importance, 9) + 0e0 AS importance, round(std_contribution, 9) + 0e0 AS std_contribution, rows, rank FROM ranked",
    ),
)
def ex1(spark, sf):
    df = E.global_importance(roles.attributions(spark, sf))
    return df.select("feature", r9("importance"), r9("std_contribution"), "rows", "rank")


@query(
    "ex2_group_importance",
    sql(
        "attr",
        f"""WITH {_IMP.strip()}
SELECT CASE WHEN feature IN ('l_quantity', 'l_extendedprice') THEN 'size' ELSE 'rate' END AS feature_group, count(*) AS features, round(sum(importance), 9) + 0e0 AS importance,
       round(sum(importance) / (SELECT sum(importance) FROM imp), 6) + 0e0 AS share FROM imp GROUP BY 1""",
    ),
)
def ex2(spark, sf):
    df = E.group_importance(roles.attributions(spark, sf), roles.GROUPS)
    return df.select("feature_group", "features", r9("importance"), r6("share"))


@query(
    "ex3_importance_by_asset",
    sql("attr", "SELECT asset, feature, round(avg(abs(contribution)), 9) + 0e0 AS importance, round(avg(contribution), 9) + 0e0 AS mean_contribution FROM attr GROUP BY 1, 2"),
)
def ex3(spark, sf):
    df = E.importance_by(roles.attributions(spark, sf), ["asset"])
    return df.select("asset", "feature", r9("importance"), r9("mean_contribution"))


@query(
    "ex3_importance_by_month",
    sql(
        "attr",
        "SELECT CAST(date_trunc('month', date) AS DATE) AS month, feature, round(avg(abs(contribution)), 9) + 0e0 AS importance, round(avg(contribution), 9) + 0e0 AS mean_contribution FROM attr GROUP BY 1, 2",
    ),
)
def ex3_month(spark, sf):
    df = E.importance_by(E.by_month(roles.attributions(spark, sf)), ["month"])
    return df.select("month", "feature", r9("importance"), r9("mean_contribution"))


_FLAGS = """
fl AS (SELECT *, prob >= 0.5e0 AS pred, (prob >= 0.5e0) = label AS correct, prob >= 0.5e0 AND label AS tp, prob < 0.5e0 AND NOT label AS tn,
              prob >= 0.5e0 AND NOT label AS fp, prob < 0.5e0 AND label AS fn FROM line_rows)"""


@query(
    "ex4_outcome_flags",
    sql("line_rows", f"WITH {_FLAGS.strip()} SELECT row_id, pred, correct, tp, tn, fp, fn FROM fl"),
)
def ex4(spark, sf):
    return E.outcome_flags(roles.line_rows(spark, sf)).select("row_id", "pred", "correct", "tp", "tn", "fp", "fn")


def _example(name: str, condition: str, order: str) -> str:
    return f"(SELECT '{name}' AS example, row_id AS \"row\", prob FROM fl WHERE {condition} ORDER BY {order}, row_id LIMIT 1)"


@query(
    "ex4_example_rows",
    sql(
        "line_rows",
        f"WITH {_FLAGS.strip()} "
        + " UNION ALL ".join(
            [
                _example("correct_high", "correct", "prob DESC"),
                _example("incorrect_high", "NOT correct", "prob DESC"),
                _example("borderline_tp", "tp", "abs(prob - 0.5e0)"),
                _example("borderline_tn", "tn", "abs(prob - 0.5e0)"),
                _example("confident_fp", "fp", "prob DESC"),
                _example("confident_fn", "fn", "prob"),
            ]
        ),
    ),
)
def ex4_examples(spark, sf):
    return E.example_rows(E.outcome_flags(roles.line_rows(spark, sf)))


@query(
    "ex5_correct_vs_incorrect",
    sql(
        "attr",
        """
WITH m AS (SELECT feature, avg(contribution) FILTER ((prob >= 0.5e0) = label) AS correct_mean, avg(contribution) FILTER ((prob >= 0.5e0) <> label) AS incorrect_mean,
       avg(contribution) FILTER (prob >= 0.5e0 AND NOT label) AS fp_mean, avg(contribution) FILTER (prob < 0.5e0 AND label) AS fn_mean FROM attr GROUP BY 1)
SELECT feature, round(correct_mean, 9) + 0e0 AS correct_mean, round(incorrect_mean, 9) + 0e0 AS incorrect_mean, round(fp_mean, 9) + 0e0 AS fp_mean, round(fn_mean, 9) + 0e0 AS fn_mean,
       round(correct_mean - incorrect_mean, 9) + 0e0 AS difference, round(abs(correct_mean - incorrect_mean), 9) + 0e0 AS abs_difference,
       row_number() OVER (ORDER BY abs(correct_mean - incorrect_mean) DESC, feature) AS rank FROM m""",
    ),
)
def ex5(spark, sf):
    df = E.correct_vs_incorrect(roles.attributions(spark, sf))
    return df.select("feature", *[r9(c) for c in df.columns if c not in ("feature", "rank")], "rank")


@query(
    "ex6_confident_errors",
    sql(
        "line_rows",
        f"""WITH {_FLAGS.strip()}
SELECT asset, count(*) FILTER (NOT correct) AS errors, count(*) FILTER (NOT correct AND (prob > 0.7e0 OR prob < 0.3e0)) AS confident_errors,
       round(avg(prob) FILTER (NOT correct AND (prob > 0.7e0 OR prob < 0.3e0)), 6) + 0e0 AS mean_prob,
       round(count(*) FILTER (NOT correct AND (prob > 0.7e0 OR prob < 0.3e0)) / CAST(count(*) FILTER (NOT correct) AS DOUBLE), 6) + 0e0 AS share_of_errors
FROM fl GROUP BY 1""",
    ),
)
def ex6(spark, sf):
    df = E.confident_errors(E.outcome_flags(roles.line_rows(spark, sf)))
    return df.select("asset", "errors", "confident_errors", r6("mean_prob"), r6("share_of_errors"))


@query(
    "ex7_concentration",
    sql(
        "attr",
        f"""WITH {_IMP.strip()}
SELECT round(max(CASE WHEN rank = 1 THEN importance END) / sum(importance), 6) + 0e0 AS top1_share, round(sum(CASE WHEN rank <= 3 THEN importance END) / sum(importance), 6) + 0e0 AS top3_share,
       max(CASE WHEN rank = 1 THEN feature END) AS top_feature FROM ranked""",
    ),
)
def ex7(spark, sf):
    df = E.concentration(E.global_importance(roles.attributions(spark, sf)))
    return df.select(r6("top1_share"), r6("top3_share"), "top_feature")


_LOCAL = """
SELECT row_id, 'raises' AS side, place, feature, value, round(contribution, 9) + 0e0 AS contribution
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY contribution DESC, feature) AS place FROM attr) WHERE place <= 2
UNION ALL SELECT row_id, 'lowers', place, feature, value, round(contribution, 9) + 0e0
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY contribution, feature) AS place FROM attr) WHERE place <= 2"""


@query("ex8_local_top_contributions", sql("attr", _LOCAL))
def ex8(spark, sf):
    df = E.linear_local_top(roles.line_rows(spark, sf), roles.LINEAR, ["row_id"], 2)
    return df.withColumn("contribution", F.round("contribution", 9))


@query("ex8_local_top_of_long_table", sql("attr", _LOCAL))
def ex8_long(spark, sf):
    df = E.local_top(roles.attributions(spark, sf), 2)
    return df.withColumn("contribution", F.round("contribution", 9))


@query(
    "ex9_linear_contributions",
    sql("attr", "SELECT row_id, feature, value, round(contribution, 9) + 0e0 AS contribution FROM attr"),
)
def ex9(spark, sf):
    return roles.attributions(spark, sf).select(
        "row_id", "feature", "value", F.round("contribution", 9).alias("contribution")
    )
