from pyspark.sql import functions as F

from panelloom.functions import aggregates as A
from panelloom.functions import scalars as S


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_flag_is_two_valued(frame):
    df = frame("v int", [(1,), (0,), (None,)])
    assert one(df, S.flag(F.col("v") > 0)) == [(True,), (False,), (False,)]


def test_safe_div(frame):
    df = frame("a double, b double", [(1.0, 2.0), (1.0, 0.0), (None, 1.0)])
    assert one(df, S.safe_div(F.col("a"), F.col("b"))) == [(0.5,), (None,), (None,)]


def test_band_edges(frame):
    df = frame("v double", [(0.9,), (1.0,), (2.0,), (None,)])
    got = one(df, S.band(F.col("v"), [1.0, 2.0], ["low", "mid", "high"]))
    assert got == [("low",), ("mid",), ("high",), (None,)]


def test_nonfinite(frame):
    df = frame("v double", [(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)])
    assert one(df, S.null_if_nonfinite(F.col("v"))) == [(1.0,), (None,), (None,), (None,), (None,)]


def test_mixed_dates_and_decimals(frame):
    df = frame("d string, n string", [("2031-04-05", "1.234,50"), ("05/04/2031", "0,25"), ("30/02/2031", "-"), ("x", "1.000.000")])
    got = one(
        df,
        S.parse_date_multi(F.col("d"), ["yyyy-MM-dd", "dd/MM/yyyy"]).cast("string"),
        S.parse_decimal_comma(F.col("n")),
    )
    assert got == [("2031-04-05", 1234.5), ("2031-04-05", 0.25), (None, None), (None, 1000000.0)]


def test_symbol(frame):
    df = frame("s string", [(" abcd11.SA ",), ("XYZ11",)])
    assert one(df, S.normalise_symbol(F.col("s"))) == [("ABCD11",), ("XYZ11",)]


def test_hash_slot_is_stable_and_in_range(spark):
    df = spark.range(1000).select(S.hash_slot(7, 5, F.col("id")).alias("s"))
    first = sorted(r.s for r in df.collect())
    again = sorted(r.s for r in df.repartition(3).collect())
    assert first == again and set(first) == {0, 1, 2, 3, 4}


def test_compound_survives_total_loss(frame):
    df = frame("r double", [(0.1,), (-1.0,), (0.5,), (None,)])
    assert one(df, A.compound(F.col("r"))) == [(-1.0,)]


def test_weighted_mean_ignores_weights_of_missing_values(frame):
    df = frame("v double, w int", [(1.0, 1), (3.0, 3), (None, 100)])
    assert one(df, A.weighted_mean(F.col("v"), F.col("w"))) == [(2.5,)]


def test_variation_needs_three(frame):
    df = frame("k string, v double", [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 2.0), ("b", 2.0)])
    got = df.groupBy("k").agg(A.variation_coefficient(F.col("v")).alias("cv")).orderBy("k").collect()
    assert [r.cv for r in got] == [None, 0.0]


def test_rounded_equals_the_decimal_rounding(frame):
    import random

    from pyspark.sql import functions as F

    from panelloom.functions.scalars import rounded

    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(3000)]
    values += [(2 * rng.randint(-(10**7), 10**7) + 1) / 2e6 for _ in range(1500)] + [rng.randint(-(10**9), 10**9) / 1e7 for _ in range(1500)]
    values += [0.0, -0.0, -1e-9, 1e-7, 5e-7, -5e-7, 1e300, float("inf"), float("-inf"), float("nan"), None]
    df = frame("x double", [(v,) for v in values])
    for digits in (6, 9):
        made = df.select("x", F.round("x", digits).alias("want"), rounded(F.col("x"), digits).alias("got"))
        wrong = [r for r in made.collect() if repr(r["want"]) != repr(r["got"])]
        assert not wrong, wrong[:5]
