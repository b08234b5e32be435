"""Properties of the physical plans of all registered queries."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
FITS = {"ml2_logistic_regression", "ml3_random_forest", "ml4_boosted_trees", "ml5_temporal_search", "ml6_feature_ablation", "ml7_walk_forward_scores", "ml8_feature_versions"}


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in FITS])
def test_no_pairwise_join_and_no_python_udf(spark, name):
    text = plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "EvalPython" not in text


@pytest.mark.parametrize(
    "name", ["wn21_score_gap", "ag15_best_row_per_group", "st3_head_per_group", "src7_union_keep_first", "sp3_evaluation_gap"]
)
def test_first_n_per_key_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(spark, "prj7_predicates")
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "PushedFilters" in scan and "o_orderpriority" in scan.split("PushedFilters")[1]
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", plan(spark, "ag12_variation_coefficient")).group(1)
    assert sorted(c.split("#")[0] for c in columns.split(",")) == ["l_extendedprice", "l_partkey"]


@pytest.mark.parametrize(("name", "shuffles"), [("feature_table_v1_suppliers", 1), ("feature_table_v2_suppliers", 2)])
def test_feature_table_shuffles_the_panel_by_asset_once(spark, name, shuffles):
    """v2 adds one for its (asset, month) spine; nothing is shuffled by date."""
    text = plan(spark, name)
    assert len(re.findall(r"Exchange hashpartitioning\(asset#\d+, \d+\)", text)) == shuffles
    assert not re.findall(r"Exchange hashpartitioning\(date#\d+, \d+\)", text)


def test_top_n_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "st2_top_n")


@pytest.mark.parametrize("name", ["jn2_bucketed_tables", "wn1_bucketed_panel"])
def test_bucketed_tables_are_not_shuffled(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and "Bucketed: true" in text


def test_tiles_bound_the_plan_of_a_correlation_matrix(spark):
    """300 columns: 9 co-moments per node, null pairs as `corr` has them."""
    from pyspark.sql import functions as F

    from panelloom.operators import profiles

    df = spark.range(40).select(*[F.when(F.hash("id", F.lit(i)) % 9 != 0, F.rand(i)).alias(f"c{i}") for i in range(300)])
    text = profiles.corr_long(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and text.count("partial_corr(") <= 9 * 2
    few = df.select(df.columns[:8])
    want = few.agg(*[F.corr(a, b).alias(f"{a}|{b}") for i, a in enumerate(few.columns) for b in few.columns[i + 1 :]]).first()
    got = {f"{r.column_a}|{r.column_b}": r["corr"] for r in profiles.corr_long(few, few.columns).collect()}
    assert got.keys() == want.asDict().keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
