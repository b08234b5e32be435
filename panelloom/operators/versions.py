"""Two versions of a table, compared by a tree of checksums before any row is joined.

Rows are dealt to buckets by a hash of their key. A bucket has, per column and for the keys, a sum and an exclusive
or of row hashes: they don't depend on the order of rows and are combined in each task, so a version leaves one
small table whatever its size. Buckets that agree hold the same values; only the rows of the others are joined, and
only the columns that differ somewhere. The checks of a version may be written once and kept with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.sources.tables import materialise

BUCKETS = 4096
KEY = "__key"


def _pair(*values: Column) -> Column:
    """Order-free check of a group of rows: the sum of 31 bits of the row hashes, and their exclusive or."""
    told = [part for v in values for part in (v.isNull(), v)]  # a null leaves a hash as it is
    h = F.xxhash64(*told)
    return F.struct(F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"), F.bit_xor(h).alias("xor"))


def group_checks(df: DataFrame, by: Sequence[str], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, rows, __key, one pair per column) per group of `by`; a column's pair covers its values together with the keys."""
    key = [F.col(f"`{k}`") for k in keys]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), _pair(*key).alias(KEY), *[_pair(*key, F.col(f"`{c}`")).alias(c) for c in columns])


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).alias("__bucket")


def checks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """`group_checks` of the buckets of a version, as a written table of at most `buckets` rows."""
    return materialise(group_checks(df.withColumn("__bucket", bucket(keys, buckets)), ["__bucket"], keys, columns), "checks")


def _differing(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(__bucket, rows, keys_differ, d_<i> per column) of the buckets of either version."""
    left = a.select("__bucket", "rows", *[F.col(c).alias(f"__a{i}") for i, c in enumerate([KEY, *columns])])
    right = b.select("__bucket", *[F.col(c).alias(f"__b{i}") for i, c in enumerate([KEY, *columns])])
    apart = [~F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}")).alias("x") for i in range(len(columns) + 1)]
    names = ["keys_differ", *[f"d_{i}" for i in range(len(columns))]]
    return left.join(right, "__bucket", "full").select("__bucket", "rows", *[x.alias(n) for x, n in zip(apart, names)])


class Comparison:
    """What the checksums of two versions tell: buckets and columns that differ, and how many keys agree without a look at them."""

    def __init__(self, a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS, checks_a: DataFrame | None = None, checks_b: DataFrame | None = None):
        self.a, self.b, self.keys, self.columns, self.buckets = a, b, list(keys), list(columns), buckets
        checked = [given if given is not None else checks(df, keys, columns, buckets) for df, given in ((a, checks_a), (b, checks_b))]
        compared = _differing(*checked, self.columns)
        any_apart = F.col("keys_differ")
        for i in range(len(self.columns)):
            any_apart |= F.col(f"d_{i}")
        self.compared = materialise(compared.withColumn("apart", any_apart), "compared")
        # one row to the driver: it decides what has to be joined at all
        facts = self.compared.agg(
            F.coalesce(F.sum(F.when(~F.col("apart"), F.col("rows"))), F.lit(0)).alias("agreed"),
            F.count_if("apart").alias("apart"),
            *[F.count_if(F.col(f"d_{i}") | F.col("keys_differ")).alias(f"d_{i}") for i in range(len(self.columns))],
        ).first()
        self.agreed_keys, self.buckets_apart = facts["agreed"], facts["apart"]
        self.columns_apart = [c for i, c in enumerate(self.columns) if facts[f"d_{i}"]]

    def _rows(self, df: DataFrame, side: str) -> DataFrame:
        """Rows of the buckets that differ, with the columns that do; the bucket table has at most `buckets` rows."""
        own = df.select(*[F.col(f"`{k}`") for k in self.keys], *[F.col(f"`{c}`").alias(f"__{side}_{i}") for i, c in enumerate(self.columns_apart)], bucket(self.keys, self.buckets))
        return own.join(self.compared.where("apart").select("__bucket"), "__bucket", "left_semi").drop("__bucket")

    def joined(self) -> DataFrame:
        """Rows of both versions by shared key, of buckets that differ."""
        return self._rows(self.a, "a").join(self._rows(self.b, "b"), self.keys)

    def apart(self, i: int) -> Column:
        return ~F.col(f"__a_{i}").eqNullSafe(F.col(f"__b_{i}"))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(column, matched_keys, differing): null-safe differences of two versions on shared keys.

    A key is on one row of a version. Each version is read for its checksums; equal ones are not read again, of
    others only what differs, so a and b should be written tables.
    """
    spark, found = a.sparkSession, Comparison(a, b, keys, columns, buckets)
    if not found.buckets_apart:
        return spark.createDataFrame([(c, found.agreed_keys, 0) for c in found.columns], "column string, matched_keys long, differing long")
    counts = found.joined().agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(found.apart(i)).alias(f"__n{i}") for i in range(len(found.columns_apart))])
    place = {c: i for i, c in enumerate(found.columns_apart)}
    cells = [F.struct(F.lit(c).alias("column"), (F.col("__rows") + found.agreed_keys).alias("matched_keys"), (F.col(f"__n{place[c]}") if c in place else F.lit(0).cast("long")).alias("differing")) for c in found.columns]
    return counts.select(F.inline(F.array(*cells)))


def changed_cells(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(keys, column, before, after): every cell of a shared key that differs, values as text."""
    found = Comparison(a, b, keys, columns, buckets)
    if not found.columns_apart:
        return a.select(*found.keys, F.lit("").alias("column"), F.lit("").alias("before"), F.lit("").alias("after")).limit(0)
    cells = F.array(*[F.when(found.apart(i), F.struct(F.lit(c).alias("column"), F.col(f"__a_{i}").cast("string").alias("before"), F.col(f"__b_{i}").cast("string").alias("after"))) for i, c in enumerate(found.columns_apart)])
    return found.joined().select(*found.keys, F.inline(F.array_compact(cells)))


def publish_changed(df: DataFrame, target: str, partition_by: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """(partition columns, rows) of the partitions of df that were written to `target`.

    A partition is written if its rows are new or differ from what target has, as order-free checksums tell, and
    takes the place of the old one; files of all others, and of partitions that df does not have, stay as they are. Each
    side is read once for its checksums, and of df only the changed partitions once more.
    """
    spark, parts = df.sparkSession, list(partition_by)
    columns = [c for c in df.columns if c not in parts]
    new = group_checks(df, parts, columns, []).select(*parts, "rows", F.col(KEY).alias("__new"))
    try:
        old = spark.read.format(fmt).load(target)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        changed = new.drop("__new")
    else:
        old = old.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in df.dtypes])
        old = group_checks(old, parts, columns, []).select(*[F.col(p).alias(f"__{p}") for p in parts], F.col(KEY).alias("__old"))
        same = F.col("__new").eqNullSafe(F.col("__old"))
        for p in parts:
            same &= F.col(p).eqNullSafe(F.col(f"__{p}"))
        changed = new.join(old, same, "left_anti").drop("__new")
    changed = materialise(changed, "changed")
    named = changed.select(*[F.col(p).alias(f"__{p}") for p in parts])
    match = [F.col(p).eqNullSafe(F.col(f"__{p}")) for p in parts]
    rows = df.join(named, match, "left_semi").hint("rebalance", *parts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).format(fmt).save(target)
    return changed
