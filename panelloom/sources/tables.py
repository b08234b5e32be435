"""Table scans, sinks and named stages."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Only a session without `spark.checkpoint.dir` whose one process runs all tasks (local tests) falls
    back to a temporary folder of this machine; any other session without it is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="panelloom-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once under the scratch folder and returns the written table.

    For a small intermediate result that several branches of a query read: each branch would
    otherwise repeat the scans and shuffles below it, and a lost executor would repeat them
    again. Unlike checkpoint() the written table keeps column pruning and size statistics.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A short table known to the driver as an inline expression: one JVM task, no Python rows."""
    fields = [part.split() for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def publish(
    df: DataFrame,
    target: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    as_table: bool = False,
    **options: str,
) -> None:
    """Overwrites a path or table, schema included.

    With partition columns the rows are rebalanced on them first: adaptive execution then writes
    few, even files, and splits a partition that holds a third of the rows over several tasks.
    """
    ready = df.hint("rebalance", *partition_by) if partition_by else df
    writer = ready.write.mode("overwrite").format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if as_table:
        writer.option("overwriteSchema", "true").saveAsTable(target)
    else:
        writer.save(target)


def table_name(label: str) -> str:
    """A name of the catalog that no other run uses."""
    return f"{label}_{uuid.uuid4().hex}"


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, order: Sequence[str] = (), location: str | None = None) -> DataFrame:
    """Saves df as a table that is bucketed by keys and sorted in its buckets, and returns it.

    The layout is recorded in the catalog: joins, aggregates and windows by these keys of tables with the same number
    of buckets need no exchange. Rows are dealt to the buckets first, so each bucket is one sorted file.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *[c for c in order if c not in keys])
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def publish_sql(spark: SparkSession, name: str, sql: str, location: str) -> DataFrame:
    """Create-or-replace of a table from a query.

    The new version is written to a fresh location before the name moves to it, so a query may
    read the table that it replaces, and readers see the old version or the new one. Only a change of
    columns takes the name away for a moment, as a name keeps its columns.
    """
    new = spark.sql(sql)
    new.write.mode("errorifexists").parquet(location)
    if spark.catalog.tableExists(name) and spark.table(name).dtypes == new.dtypes:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=location, source="parquet")
    return spark.table(name)


def replace_column(df: DataFrame, fix: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """df with one column taken from `fix` by key; keys missing there get NULL, all other columns
    and the column order stay."""
    side = fix.select(*keys, F.col(column).alias("__new"))
    joined = df.join(side, list(keys), "left")
    return joined.select(*[F.col("__new").alias(c) if c == column else F.col(c) for c in df.columns])


def rewrite_with_backup(spark: SparkSession, df: DataFrame, source: str, backup: str, target: str) -> DataFrame:
    """Copies `source` to `backup`, writes df to `target`, and reads the target back.

    df may read from `source`; nothing is overwritten in place.
    """
    spark.read.parquet(source).write.mode("errorifexists").parquet(backup)
    df.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def register_stages(stages: dict[str, DataFrame]) -> None:
    """Each frame under a temp-view name, for SQL text that names its inputs."""
    for name, frame in stages.items():
        frame.createOrReplaceTempView(name)
