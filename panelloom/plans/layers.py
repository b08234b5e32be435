"""Raw files -> bronze (typed rows with lineage) -> silver (clean columns) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions.scalars import flag, normalise_symbol, parse_date_multi, parse_decimal_comma
from panelloom.sources import files

# File-name layouts of the raw folders.
PRICE_FILE = r"([^/]+)_cotacoes\.csv"
DIVIDEND_FILE = r"([^/]+)_dividendos\.csv"


def bronze_prices(spark: SparkSession, glob: str, key_pattern: str = PRICE_FILE) -> DataFrame:
    raw = files.read_panel_csv(spark, glob, schemas.PRICES_RAW)
    keyed = files.with_lineage(files.with_file_key(raw, key_pattern, "asset"))
    return files.rename_map(keyed, schemas.PRICES_RENAME).withColumns(
        {
            "asset": normalise_symbol(F.col("asset")),
            "date": parse_date_multi(F.col("date"), schemas.DATE_FORMATS),
        }
    )


def silver_prices(bronze: DataFrame) -> DataFrame:
    return bronze.where(F.col("date").isNotNull()).select(
        "asset", "date", "close", "adj_close", "volume", flag(F.col("volume") > 0).alias("has_trading")
    )


def bronze_dividends(spark: SparkSession, glob: str, key_pattern: str = DIVIDEND_FILE) -> DataFrame:
    """(asset, ex_date, paid_on, amount, restated) with lineage: the cells that later steps use.

    Dates are parsed in either format; one that fits neither stays NULL and is listed by
    `files.rejected_cells`. The amount is a number in one column or a text in another.
    """
    raw = files.with_lineage(files.with_file_key(files.read_panel_csv(spark, glob, schemas.DIVIDENDS_RAW), key_pattern, "key"))
    return raw.select(
        normalise_symbol(F.col("key")).alias("asset"),
        parse_date_multi(F.col("ed"), schemas.DATE_FORMATS).alias("ex_date"),
        parse_date_multi(F.col("pd"), schemas.DATE_FORMATS).alias("paid_on"),
        F.coalesce("v", parse_decimal_comma(F.col("sv"))).alias("amount"),
        F.col("adj").alias("restated"),
        "source_file",
        "ingestion_timestamp",
    )


def silver_dividends(bronze: DataFrame) -> DataFrame:
    return bronze.select("asset", "ex_date", F.col("paid_on").alias("payment_date"), F.col("amount").alias("value"), F.col("restated").alias("is_adjusted"))


def bronze_series(spark: SparkSession, glob: str) -> DataFrame:
    """Tidy one-row-per-date CSV files -> (date, close) with lineage."""
    raw = files.with_lineage(files.read_panel_csv(spark, glob, schemas.SERIES_TIDY))
    return raw.select(
        parse_date_multi(F.col("Data"), schemas.DATE_FORMATS).alias("date"),
        F.col("Fechamento").alias("close"),
        "source_file",
        "ingestion_timestamp",
    )


def silver_series(bronze: DataFrame) -> DataFrame:
    """(date, close), one row per date whatever the number of yearly files that hold it."""
    known = bronze.where(F.col("date").isNotNull() & F.col("close").isNotNull())
    return files.union_dedupe([known], ["date"], ["source_file", "close"]).select("date", "close")
