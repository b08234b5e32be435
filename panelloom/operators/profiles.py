"""Table profiles. Each reads its input once: one aggregate over all columns, then unpivot."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.aggregates import null_count
from panelloom.functions.scalars import hash_order, month_start


def counts_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).orderBy(*keys)


def share_of_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts per key and their percentage of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("all_rows")).scalar()
    return counts.select(*keys, "rows", (F.col("rows") * 100.0 / total).alias("share_pct"))


def summary_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key: rows, and min, max, mean, sum of each column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.avg(c).alias(f"avg_{c}"),
            F.sum(c).alias(f"sum_{c}"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, rows, null_pct)."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[null_count(c).alias(c) for c in columns])
    return counts.unpivot(["rows"], columns, "column", "nulls").select(
        "column",
        "nulls",
        "rows",
        (F.col("nulls") * 100.0 / F.nullif(F.col("rows"), F.lit(0))).alias("null_pct"),
    )


def cardinality_profile(
    df: DataFrame, columns: Sequence[str], low: int = 10, approximate: bool = False
) -> DataFrame:
    """(column, distinct_values, is_constant, is_low_cardinality).

    Exact counts go through (column, value) pairs: the pairs are de-duplicated map-side, so a
    value that fills a third of the table costs one row per task in the shuffle.
    """
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        long = wide.unpivot([], list(columns), "column", "distinct_values")
    else:
        cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
            [], list(columns), "column", "value"
        )
        pairs = cells.groupBy("column", "value").agg(F.lit(1).alias("__one"))
        long = pairs.groupBy("column").agg(F.count("value").alias("distinct_values"))
    return long.select(
        "column",
        "distinct_values",
        (F.col("distinct_values") <= 1).alias("is_constant"),
        (F.col("distinct_values") < low).alias("is_low_cardinality"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, stddev, min, max) in one aggregate."""
    packed = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("stddev"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return packed.unpivot([], list(columns), "column", "s").select("column", "s.*")


def sketches(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(column, n, mean, stddev, least, most, lo, hi): one pass over df, one row per column.

    lo and hi are sketch values just under and over each probability.
    """
    margin = 3.0 / accuracy
    packed = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("stddev"),
                F.min(c).cast("double").alias("least"),
                F.max(c).cast("double").alias("most"),
                F.percentile_approx(F.col(c).cast("double"), [max(p - margin, 0.0) for p in probs], accuracy).alias("lo"),
                F.percentile_approx(F.col(c).cast("double"), [min(p + margin, 1.0) for p in probs], accuracy).alias("hi"),
            ).alias(c)
            for c in columns
        ]
    )
    return packed.unpivot([], list(columns), "column", "s").select("column", "s.*")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """(column, prob, quantile): interpolated quantiles, exact, in bounded memory per task.

    `percentile` would hold every distinct value of a column in one task. Here a mergeable
    sketch brackets each quantile to within 3/accuracy of the rank range, values under the
    bracket are only counted (map-side), and just the values inside it are ranked.
    """
    columns, probs = list(columns), list(probs)
    return _quantiles(df, sketches(df, columns, probs, accuracy), columns, probs, accuracy)


def _quantiles(
    df: DataFrame, sketched: DataFrame, columns: list[str], probs: list[float], accuracy: int
) -> DataFrame:
    margin = 3.0 / accuracy
    prob_array = F.array(*[F.lit(float(p)) for p in probs])
    brackets = (
        sketched.select(
            "column", "n", "least", "most",
            F.explode(F.arrays_zip(prob_array.alias("prob"), F.col("lo"), F.col("hi"))).alias("col"),
        )
        .select(
            "column",
            "n",
            F.col("col.prob").alias("prob"),
            # With few rows the margin is under one rank: the bracket is then the whole column.
            F.when((F.col("n") <= accuracy) | (F.col("col.prob") <= margin), F.col("least"))
            .otherwise(F.col("col.lo"))
            .alias("lo"),
            F.when((F.col("n") <= accuracy) | (F.col("col.prob") >= 1 - margin), F.col("most"))
            .otherwise(F.col("col.hi"))
            .alias("hi"),
        )
        .withColumn("rank", F.col("prob") * (F.col("n") - 1))
    )
    # Everything under a bracket falls into one NULL-valued row per task before the shuffle.
    kept = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .where(F.col("value").isNotNull())
        .join(brackets, "column")
        .where(F.col("value") <= F.col("hi"))
        .groupBy(
            "column", "prob", "rank", F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("value")
        )
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    w = (
        Window.partitionBy("column", "prob")
        .orderBy(F.col("value").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = kept.withColumn("upto", F.sum("copies").over(w))
    low = F.min(F.when(F.col("upto") > F.floor("rank"), F.col("value")))
    high = F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("value")))
    under = F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("upto"))), F.lit(0))
    # Should a sketch have missed its error bound, the job fails: no rank outside its bracket is used.
    inside = (F.col("under") <= F.floor("rank")) & (F.col("total") > F.ceil("rank"))
    quantile = F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))
    return (
        ranked.groupBy("column", "prob", "rank")
        .agg(low.alias("low"), high.alias("high"), under.alias("under"), F.max("upto").alias("total"))
        .select(
            "column",
            "prob",
            F.when(inside, quantile).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket"))).alias("quantile"),
        )
    )


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95),
    sketched: DataFrame | None = None,
) -> DataFrame:
    """describe() plus one quantile column per probability (p05, p25, ...).

    Two passes if `sketched` is the written result of `sketches` for the same arguments, else the first
    one is planned twice.
    """
    columns, probs, accuracy = list(columns), list(probs), 10_000
    names = [f"p{round(p * 100):02d}" for p in probs]
    sketched = sketches(df, columns, probs, accuracy) if sketched is None else sketched
    wide = _quantiles(df, sketched, columns, probs, accuracy).groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for p, name in zip(probs, names)
        ]
    )
    stats = sketched.select(
        "column", F.col("n").alias("count"), "mean", "stddev", F.col("least").alias("min"), F.col("most").alias("max")
    )
    return stats.join(wide, "column")


#: columns on either side of a tile of the correlation matrix; 9 co-moments fit one generated loop
TILE = 3
#: pairs up to which one aggregate without tiles holds them all
FEW_PAIRS = 16


def corr_long(
    df: DataFrame, columns: Sequence[str], min_abs: float | None = None
) -> DataFrame:
    """(column_a, column_b, corr) for every unordered pair of columns, over the rows where both are known.

    The columns of a row go into an array, and the row is exploded to the tiles of the matrix, pairs of blocks of
    TILE columns. Tiles are the groups of one aggregate that holds TILE * TILE co-moments, combined in each
    task before the shuffle, whatever the number of columns. A few pairs need no tiles.
    """
    columns = list(columns)
    if 0 < len(pairs := list(combinations(columns, 2))) <= FEW_PAIRS:
        whole = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
        long = whole.select(F.inline(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))
        return long if min_abs is None else long.where(F.abs("corr") > min_abs)
    blocks = range(-(-len(columns) // TILE))
    tiles = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in blocks for b in blocks if a <= b]
    if not tiles or len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double")
    cells = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"))
    tiled = cells.select("x", F.explode(F.array(*tiles)).alias("t")).select("x", "t.a", "t.b")
    places = [(i, j) for i in range(TILE) for j in range(TILE)]

    def value(block: str, i: int) -> Column:
        return F.get("x", F.col(block) * TILE + i)

    sums = tiled.groupBy("a", "b").agg(*[F.corr(value("a", i), value("b", j)).alias(f"c_{i}_{j}") for i, j in places])
    pairs = F.array(*[F.struct((F.col("a") * TILE + i).alias("i"), (F.col("b") * TILE + j).alias("j"), F.col(f"c_{i}_{j}").alias("corr")) for i, j in places])
    names = F.array(*map(F.lit, columns))
    long = sums.select(F.inline(pairs)).where((F.col("i") < F.col("j")) & (F.col("j") < len(columns)))
    named = long.select(F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), "corr")
    return named if min_abs is None else named.where(F.abs("corr") > min_abs)


def corr_with_target(df: DataFrame, columns: Sequence[str], target: Column) -> DataFrame:
    """(column, corr) of each column with the target."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), target.cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "corr")


def first_valid(df: DataFrame, asset: str, date: str, column: str) -> DataFrame:
    """Per asset: first date, first and last date with a known value, days to the first."""
    known = F.when(F.col(column).isNotNull(), F.col(date))
    return df.groupBy(asset).agg(
        F.min(date).alias("first_date"),
        F.min(known).alias("first_valid"),
        F.max(known).alias("last_valid"),
        F.datediff(F.min(known), F.min(date)).alias("days_to_valid"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def monthly_sum(events: DataFrame, key: str, date: str, value: str, out: str = "monthly_total") -> DataFrame:
    return events.groupBy(key, month_start(F.col(date)).alias("month")).agg(F.sum(value).alias(out))


def monthly_mean(df: DataFrame, date: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, month_start(F.col(date)).alias("month")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )


def best_by(df: DataFrame, keys: Sequence[str], metric: Column, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """The whole best row per key; ties go to the smallest `tie` values.

    Filtering row_number to 1 lets Spark keep one candidate per key and task before the shuffle.
    """
    order = metric.desc_nulls_last() if largest else metric.asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order, *tie)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each key under the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def seeded_sample(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """n rows in hash order of their key: the same rows for the same seed, on any layout. Each
    task keeps its own first n, so nothing but candidates is moved."""
    return df.orderBy(hash_order(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def nearest_to(df: DataFrame, column: str, target: float, n: int, tie: Sequence[str]) -> DataFrame:
    """n rows whose value lies closest to the target."""
    return df.where(F.col(column).isNotNull()).orderBy(F.abs(F.col(column) - target), *tie).limit(n)


def union_labelled(parts: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Stacks frames of one layout under a label column."""
    frames = [df.select(F.lit(name).alias(label), "*") for name, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def profile_parts(df: DataFrame, by: Sequence[str], columns: Sequence[str], accuracy: int = 800, registers: int = 14) -> DataFrame:
    """(*by, column, rows, known, least, most, values, ranks): mergeable profiles of numeric columns.

    One row per part of the table and column: exact counts and extremes, a sketch of the distinct
    values (2^`registers` counters, a standard error of 0.8 % at 14) and one of the ranks (an error of
    about 0.4 % of all rows at an `accuracy` of 800). Both have a bounded size and are built map-side,
    so a part that holds most rows costs one row per task in the shuffle. When a table grows, only its
    new parts need to be read. NULL and NaN are not known values; 0.0 and -0.0 are one value.
    """
    cells = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "column", "value")
    value = F.when(~F.isnan("value"), F.col("value") + F.lit(0.0))
    return cells.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("known"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.hll_sketch_agg(value.cast("string"), registers).alias("values"),
        F.kll_sketch_agg_double(value, accuracy).alias("ranks"),
    )


def merged_profile(parts: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, rows, known, least, most, distinct_values, p25, ...) from `profile_parts` of any
    parts: rows, known, least and most are exact, the rest is estimated. Without a known value the
    extremes and quantiles are NULL and distinct_values is 0."""
    merged = parts.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"),
        F.sum("known").alias("known"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_values"),
        F.kll_merge_agg_double(F.when(F.col("known") > 0, F.col("ranks"))).alias("__ranks"),
    )
    found = [
        F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("__ranks", F.lit(float(q)))).alias(f"p{round(q * 100):02d}")
        for q in quantiles
    ]
    return merged.select("*", *found).drop("__ranks")
