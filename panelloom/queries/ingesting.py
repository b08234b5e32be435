"""Source and sink queries (survey ids SRC*, SNK*).

Raw files are written from the given tables into a new folder under the shared scratch folder,
in the raw formats, and read back with the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom import schemas
from panelloom.functions import scalars as S
from panelloom.operators import features as feat
from panelloom.operators import versions
from panelloom.queries import roles
from panelloom.queries.registry import query, sql
from panelloom.queries.windows import _ma, r6, trail
from panelloom.sources import files, tables


def comma_text(column, digits: int):
    """1234.5 -> '1.234,50'."""
    return F.translate(F.format_number(column, digits), ",.", ".,")


def _price_files(spark, sf) -> str:
    """The panel as CSV files in the raw price layout, one folder per asset."""
    target = tables.scratch_dir(spark, "prices_csv")
    raw = roles.panel(spark, sf).select(
        "asset",
        F.date_format("date", "yyyy-MM-dd").alias("Date"),
        F.col("adj_close").alias("Adj Close"),
        F.col("close").alias("Close"),
        F.col("close").alias("High"),
        F.col("adj_close").alias("Low"),
        F.col("close").alias("Open"),
        F.col("volume").alias("Volume"),
    )
    tables.publish(raw, target, ["asset"], fmt="csv", header="true")
    return target


_PATH_KEY = r"asset=([^/]+)/"


def _decoded(column: str):
    """Folder names percent-encode the blank of '4-NOT SPECIFIED' once or twice, by platform."""
    return F.url_decode(F.url_decode(F.col(column)))


@query("src1_csv_glob", sql("panel", "SELECT date, adj_close, close, volume FROM panel"))
def src1(spark, sf):
    raw = files.read_panel_csv(spark, f"{_price_files(spark, sf)}/*/*.csv", schemas.PRICES_RAW)
    typed = files.rename_map(raw, schemas.PRICES_RENAME)
    return typed.select(S.parse_date_multi(F.col("date"), schemas.DATE_FORMATS).alias("date"), "adj_close", "close", "volume")


@query(
    "src1_rejected_cells",
    """
SELECT o_orderkey AS key, 'Close' AS "column", 'n/a' AS text FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'Date', '30/02/2001' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'Open', '1,5' FROM orders WHERE o_orderkey % 11 = 0""",
)
def src1_rejected(spark, sf):
    target, key = tables.scratch_dir(spark, "rejects_csv"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    raw = roles.table(spark, sf, "orders").select(
        F.when(key % 5 == 0, F.lit("30/02/2001")).otherwise(day).alias("Date"),
        F.lit("").alias("Adj Close"),
        F.when(key % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("Close"),
        F.col("o_totalprice").alias("High"),
        F.lit(None).cast("double").alias("Low"),
        F.when(key % 11 == 0, F.lit("1,5")).otherwise(F.lit(" 2.5 ")).alias("Open"),
        key.alias("Volume"),
    )
    tables.publish(raw, target, fmt="csv", header="true")
    parsers = {"Date": lambda c: S.parse_date_multi(c, schemas.DATE_FORMATS)}
    prices = T.StructType([T.StructField("Date", T.DateType()), *schemas.PRICES_RAW.fields[1:]])
    bad = files.rejected_cells(spark, f"{target}/*.csv", prices, parsers)
    return bad.select(F.element_at(F.split("record", ",(?=[^,]*$)"), 2).cast("long").alias("key"), "column", "text")


@query("src2_key_from_file_name", sql("panel", "SELECT asset, count(*) AS rows, min(close) AS min_close, max(close) AS max_close FROM panel GROUP BY 1"))
def src2(spark, sf):
    raw = files.read_panel_csv(spark, f"{_price_files(spark, sf)}/*/*.csv", schemas.PRICES_RAW)
    keyed = files.with_file_key(raw, _PATH_KEY, "asset")
    return keyed.groupBy(_decoded("asset").alias("asset")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("Close").alias("min_close"), F.max("Close").alias("max_close")
    )


@query(
    "src3_lineage_columns",
    sql("panel", "SELECT count(*) AS rows, count(*) AS with_source, count(*) AS with_timestamp, count(DISTINCT asset) AS source_folders, 1::BIGINT AS instants FROM panel"),
)
def src3(spark, sf):
    raw = files.read_panel_csv(spark, f"{_price_files(spark, sf)}/*/*.csv", schemas.PRICES_RAW)
    lined = files.with_lineage(raw)
    return lined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("source_file").alias("with_source"),
        F.count("ingestion_timestamp").alias("with_timestamp"),
        F.count_distinct(F.regexp_extract("source_file", _PATH_KEY, 1)).alias("source_folders"),
        F.count_distinct("ingestion_timestamp").alias("instants"),
    )


@query(
    "src4_rename_columns",
    "SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderpriority AS priority, o_totalprice AS total_price FROM orders",
)
def src4(spark, sf):
    mapping = {
        "o_orderkey": "order_key", "o_custkey": "customer_key", "o_orderpriority": "priority", "o_totalprice": "total_price",
    }
    return files.rename_map(roles.table(spark, sf, "orders").select(*mapping), mapping)


@query("src5_locale_parsing", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price FROM orders")
def src5(spark, sf):
    d = F.to_date("o_orderdate")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    raw = roles.table(spark, sf, "orders").select(
        "o_orderkey", mixed.alias("date_text"), comma_text(F.col("o_totalprice"), 2).alias("price_text")
    )
    return raw.select(
        "o_orderkey",
        S.parse_date_multi(F.col("date_text"), schemas.DATE_FORMATS).alias("date"),
        S.parse_decimal_comma(F.col("price_text")).alias("price"),
    )


@query(
    "src6_calendar_matrix",
    "SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value FROM orders GROUP BY 1",
)
def src6(spark, sf):
    d = F.to_date("o_orderdate")
    months = schemas.MATRIX_MONTHS
    name = F.element_at(F.array(*[F.lit(m) for m in months]), F.month(d))
    matrix = (
        roles.table(spark, sf, "orders")
        .select(
            F.year(d).alias("y"),
            F.dayofmonth(d).cast("string").alias("Dia"),
            name.alias("m"),
            roles.cents("o_totalprice").alias("c"),
        )
        .groupBy("y", "Dia")
        .pivot("m", months)
        .agg(F.sum("c"))
    )
    text = matrix.select("y", "Dia", *[comma_text(F.col(m) / 100.0, 2).alias(m) for m in months])
    footer = text.select("y").distinct().select("y", F.lit("MINIMO").alias("Dia"), *[F.lit("1,00").alias(m) for m in months])
    return files.unpivot_calendar(text.unionByName(footer), F.col("y"))


@query(
    "src7_union_keep_first",
    sql(
        "macro_daily",
        """
SELECT date, CASE WHEN year(date) <= 1998 THEN macro_a ELSE macro_b END AS value FROM macro_daily""",
    ),
)
def src7(spark, sf):
    daily = tables.materialise(roles.macro_daily(spark, sf), "daily")
    first = daily.where(F.year("date") <= 1998).select("date", F.col("macro_a").alias("value"))
    second = daily.select("date", F.col("macro_b").alias("value"))
    return files.union_dedupe([first, second], ["date"], ["value"])


@query("src8_macro_json", sql("macro_daily", "SELECT date, macro_a AS rate FROM macro_daily"))
def src8(spark, sf):
    target = tables.scratch_dir(spark, "macro_json")
    daily = roles.macro_daily(spark, sf)
    yearly = daily.groupBy(F.year("date").alias("y")).agg(
        F.to_json(
            F.collect_list(
                F.struct(F.date_format("date", "dd/MM/yyyy").alias("data"), F.col("macro_a").cast("string").alias("valor"))
            )
        ).alias("value")
    )
    # One text file per calendar year, each a single JSON array of at most 366 entries.
    yearly.write.partitionBy("y").text(target)
    return files.read_macro_json(spark, f"{target}/*/*.txt", "rate")


@query(
    "src9_embedded_payload",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS name FROM events",
)
def src9(spark, sf):
    payload = F.concat(
        F.lit('[{"k":'), F.get_json_object("props", "$.k"), F.lit(',"name":"'), F.col("event_type"), F.lit('"}]')
    )
    escaped = F.replace(payload, F.lit('"'), F.lit("&quot;"))
    pages = roles.table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit('<div id="results" class="x" value="'), escaped, F.lit('"></div>')).alias("html"),
    )
    return files.extract_embedded(pages, "html", r'(?s)id="results".*?value="([^"]+)"', "struct<k: bigint, name: string>", ["event_id"])


@query(
    "src9_unescaped_titles",
    # The references that titles hold; one cut off before its semicolon is decoded too.
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
       '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS title FROM pages""",
)
def src9_titles(spark, sf):
    raw = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return roles.table(spark, sf, "pages").select("page_id", files.unescape_html(raw).alias("title"))


@query("src10_table_scan", "SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1")
def src10(spark, sf):
    tables.register_stages({"orders_scan": roles.table(spark, sf, "orders")})
    return tables.table(spark, "orders_scan").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query("src11_normalised_symbol", "SELECT c_custkey, upper(c_name) AS symbol FROM customer")
def src11(spark, sf):
    dirty = F.concat(F.lit(" "), F.lower("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(".SA")).otherwise(F.lit("")))
    return roles.table(spark, sf, "customer").select("c_custkey", S.normalise_symbol(dirty).alias("symbol"))


@query(
    "src12_extend_series",
    sql(
        "macro_daily",
        "SELECT date, CASE WHEN year(date) >= 1999 THEN macro_b ELSE macro_a END AS value FROM macro_daily",
    ),
)
def src12(spark, sf):
    daily = tables.materialise(roles.macro_daily(spark, sf), "daily")
    old = daily.where(F.year("date") <= 2000).select("date", F.col("macro_a").alias("value"))
    new = daily.where(F.year("date") >= 1999).select("date", F.col("macro_b").alias("value"))
    return files.extend_series(old, new)


@query("snk1_publish_partitioned", sql("panel", "SELECT asset, date, close, volume FROM panel"))
def snk1(spark, sf):
    target = tables.scratch_dir(spark, "published")
    df = roles.panel(spark, sf).select("asset", "date", "close", "volume")
    tables.publish(df, target, ["asset"])
    return spark.read.schema(df.schema).parquet(target).select("asset", "date", "close", "volume")


@query(
    "snk1_publish_changed_partitions",
    sql("panel", "SELECT asset, date, CASE WHEN asset LIKE '1%' AND volume = 2 THEN close + 1 ELSE close END AS close, volume FROM panel"),
)
def snk1_changed(spark, sf):
    """A second version of the panel over a first one: only the partitions that differ are written."""
    target = tables.scratch_dir(spark, "published")
    first = tables.materialise(roles.panel(spark, sf).select("date", "close", "volume", "asset"), "panel")
    versions.publish_changed(first, target, ["asset"])
    moved = F.when(F.col("asset").startswith("1") & (F.col("volume") == 2), F.col("close") + 1).otherwise(F.col("close"))
    versions.publish_changed(first.withColumn("close", moved), target, ["asset"])
    return spark.read.schema(first.schema).parquet(target).select("asset", "date", "close", "volume")


@query("snk2_publish_unpartitioned", sql("bench", "SELECT date, close FROM bench"))
def snk2(spark, sf):
    target = tables.scratch_dir(spark, "published")
    df = roles.bench(spark, sf)
    tables.publish(df, target)
    return spark.read.schema(df.schema).parquet(target)


@query("snk3_create_table_as", "SELECT o_orderpriority AS priority, count(*) AS orders, max(o_totalprice) AS top_price FROM orders GROUP BY 1")
def snk3(spark, sf):
    tables.register_stages({"snk3_orders": roles.table(spark, sf, "orders")})
    text = "SELECT o_orderpriority AS priority, count(*) AS orders, max(o_totalprice) AS top_price FROM snk3_orders GROUP BY 1"
    return tables.publish_sql(spark, "snk3_priority", text, tables.scratch_dir(spark, "ctas"))


@query(
    "snk4_replace_column",
    sql(
        "panel bench",
        "SELECT p.asset, p.date, p.close, b.close AS adj_close, p.volume FROM panel p LEFT JOIN (SELECT * FROM bench WHERE year(date) <> 1997) b USING (date)",
    ),
)
def snk4(spark, sf):
    source, backup, target = (tables.scratch_dir(spark, n) for n in ("source", "backup", "target"))
    tables.publish(roles.panel(spark, sf), source)
    stored = spark.read.parquet(source)
    fix = roles.bench(spark, sf).where("year(date) <> 1997").withColumnRenamed("close", "adj_close")
    keyed = stored.select("asset", "date").join(fix, "date")
    fixed = tables.replace_column(stored, keyed, ["asset", "date"], "adj_close")
    return tables.rewrite_with_backup(spark, fixed, source, backup, target)


@query(
    "snk5_named_stages",
    sql(
        "tr br",
        f"""
SELECT a.asset, a.date, round(a.r, 6) + 0e0 AS return_30d, round(a.d, 6) + 0e0 AS price_vs_ma_7d, round(b.r, 6) + 0e0 AS bench_return_30d
FROM (SELECT asset, date, {trail('total_return', 30)} AS r, {_ma(7)} AS d FROM tr) a
LEFT JOIN (SELECT date, {trail('bench_return', 30, 'ORDER BY date')} AS r FROM br) b USING (date)""",
    ),
)
def snk5(spark, sf):
    cells = roles.prices(spark, sf)
    own = feat.trailing_returns(roles.total_returns(spark, sf, cells), (30,))
    tables.register_stages(
        {
            "stage_features": feat.technical_features(own, rsi=(), averages=(7,), betas=(), outperform=(), drawdowns=()),
            "stage_benchmark": feat.benchmark_trailing(roles.bench_returns(cells), (30,)),
        }
    )
    return spark.sql(
        """
SELECT f.asset, f.date, round(f.return_30d, 6) + 0e0 AS return_30d, round(f.price_vs_ma_7d, 6) + 0e0 AS price_vs_ma_7d,
       round(b.bench_return_30d, 6) + 0e0 AS bench_return_30d
FROM stage_features f LEFT JOIN stage_benchmark b ON f.date = b.date"""
    )
