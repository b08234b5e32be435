"""Raw files of every layout, written as small fixtures and read with the library's readers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions.scalars import parse_date_multi
from panelloom.plans import layers
from panelloom.sources import files, tables


def test_price_files(spark, tmp_path):
    head = "Date,Adj Close,Close,High,Low,Open,Volume\n"
    (tmp_path / "aaaa11_cotacoes.csv").write_text(head + "2026-01-02,9.5,10.0,10.5,9.0,9.8,100\n2026-01-05,9.6,10.1,10.5,9.0,9.8,0\n")
    (tmp_path / "BBBB11_cotacoes.csv").write_text(head + "02/01/2026,19.5,20.0,20.5,19.0,19.8,\nbroken,1,1,1,1,1,1\n")
    bronze = layers.bronze_prices(spark, str(tmp_path / "*.csv"))
    assert {"source_file", "ingestion_timestamp"} <= set(bronze.columns)
    rows = {(r.asset, r.date): r for r in layers.silver_prices(bronze).collect()}
    assert set(rows) == {("AAAA11", dt.date(2026, 1, 2)), ("AAAA11", dt.date(2026, 1, 5)), ("BBBB11", dt.date(2026, 1, 2))}
    assert [rows[k].has_trading for k in sorted(rows)] == [True, False, False]


def test_dividend_files(spark, tmp_path):
    (tmp_path / "AAAA11_dividendos.csv").write_text(
        "y,m,d,ad,ed,pd,et,etd,v,ov,sv,sov,adj\n"
        '1,2,3,,2031-03-09,17/03/2031,Kind A,Kind A,1.25,,"1,25000000",-,False\n'
        '1,2,3,,2031-02-08,31/02/2031,Kind B,Kind B,,,"2.000,75",-,True\n'
    )
    silver = layers.silver_dividends(layers.bronze_dividends(spark, str(tmp_path / "*_dividendos.csv")))
    rows = silver.orderBy("ex_date").collect()
    assert [(r.asset, r.ex_date, r.payment_date, r.value, r.is_adjusted) for r in rows] == [
        ("AAAA11", dt.date(2031, 2, 8), None, 2000.75, True),
        ("AAAA11", dt.date(2031, 3, 9), dt.date(2031, 3, 17), 1.25, False),
    ]


def test_other_header_is_refused(spark, tmp_path):
    (tmp_path / "cccc11_cotacoes.csv").write_text("Date,Close,Adj Close,High,Low,Open,Volume\n2026-01-02,10.0,9.5,10.5,9.0,9.8,100\n")
    with pytest.raises(Exception, match="(?i)header"):
        layers.bronze_prices(spark, str(tmp_path / "*.csv")).collect()


def test_rejected_cells(spark, tmp_path):
    head = "Date,Adj Close,Close,High,Low,Open,Volume\n"
    (tmp_path / "a.csv").write_text(head + "2031-01-02,x,1.0,,1.0,1.0,7\n2031-13-02,1.0,1.0,1.0,1.0,1.0,7.5\n02/01/2031, 1.0 ,1,1,1,1,1\n")
    parsers = {"Date": lambda c: parse_date_multi(c, schemas.DATE_FORMATS)}
    rows = files.rejected_cells(spark, str(tmp_path / "*.csv"), schemas.PRICES_RAW, parsers).collect()
    assert {(r.file.rsplit("/", 1)[1], r.column, r.text) for r in rows} == {("a.csv", "Adj Close", "x"), ("a.csv", "Date", "2031-13-02"), ("a.csv", "Volume", "7.5")}
    assert {r.record for r in rows if r.column == "Adj Close"} == {"2031-01-02,x,1.0,,1.0,1.0,7"}


def test_calendar_matrix_file(spark, tmp_path):
    body = ["Índice - 2031", "Dia;Jan;Fev;Mar;Abr;Mai;Jun;Jul;Ago;Set;Out;Nov;Dez", "", "2;;;;;;1.111,25;;;;;;", "30;1,5;9,99;;;;;;;;;;", "MINIMO;1,00;2,00;;;;;;;;;;", "MÁXIMO;1,00;;;;;;;;;;;"]
    path = tmp_path / "index.csv"
    path.write_bytes("\n".join(body).encode("latin-1"))
    got = sorted((r.date, r.value) for r in files.read_calendar_matrix(spark, str(path), 2031).collect())
    assert got == [(dt.date(2031, 1, 30), 1.5), (dt.date(2031, 6, 2), 1111.25)]


def test_macro_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"data": "05/02/2031", "valor": "0.25"}, {"data": "06/02/2031", "valor": "n/a"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"data": "07/02/2031", "valor": "1"}]))
    rows = files.read_macro_json(spark, str(tmp_path / "*.json"), "rate").orderBy("date").collect()
    assert [(r.date.day, r.rate) for r in rows] == [(5, 0.25), (6, None), (7, 1.0)]


def test_tidy_series_keeps_one_row_per_date(spark, tmp_path):
    (tmp_path / "s2025.csv").write_text("Data,Fechamento\n2025-12-30,100.5\n2025-12-31,101\n")
    (tmp_path / "s2026.csv").write_text("Data,Fechamento\n2025-12-31,999\n2026-01-02,102\n")
    rows = layers.silver_series(layers.bronze_series(spark, str(tmp_path / "*.csv"))).orderBy("date").collect()
    assert [r.close for r in rows] == [100.5, 101.0, 102.0]


def test_embedded_payload_with_entities(spark):
    page = '<html><input id="results" type="hidden"\n value="[{&quot;ed&quot;:&quot;2026-01-02&quot;,&quot;v&quot;:0.5,&quot;n&quot;:&quot;a&ccedil;&#227;o &amp;amp;&quot;},{&quot;v&quot;:1.5}]"></html>'
    df = spark.createDataFrame([(1, page), (2, "<html></html>"), (3, None)], "id int, html string")
    rows = files.extract_embedded(df, "html", r'(?s)id="results".*?value="([^"]+)"', "struct<ed: string, v: double, n: string>", ["id"])
    assert [tuple(r) for r in rows.collect()] == [(1, "2026-01-02", 0.5, "ação &amp;"), (1, None, 1.5, None)]


def test_extend_series_prefers_new_rows(frame):
    old = frame("date string, v int", [("2024-01-01", 1), ("2024-01-02", 2)], ["date"])
    new = frame("date string, v int", [("2024-01-02", 20), ("2024-01-03", 30)], ["date"])
    assert [r.v for r in files.extend_series(old, new).orderBy("date").collect()] == [1, 20, 30]


def test_publish_partitioned_and_replace(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("k"))
    target = str(tmp_path / "out")
    tables.publish(df, target, ["k"])
    tables.publish(df.where("id < 10"), target, ["k"])
    assert spark.read.parquet(target).count() == 10
    fixed = tables.replace_column(df, spark.createDataFrame([(5, "five")], "id long, k string"), ["id"], "k")
    assert fixed.columns == ["id", "k"] and fixed.where("k = 'five'").count() == 1 and fixed.where("k IS NULL").count() == 99


def test_publish_sql_may_read_what_it_replaces(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS loom_t")
    tables.publish_sql(spark, "loom_t", "SELECT 1 AS a", str(tmp_path / "v1"))
    out = tables.publish_sql(spark, "loom_t", "SELECT a + 1 AS a FROM loom_t", str(tmp_path / "v2"))
    assert [r.a for r in out.collect()] == [2]
    spark.sql("DROP TABLE loom_t")


def test_scratch_needs_a_shared_folder_off_local(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(ValueError):
        tables.scratch_dir(Session(spark_master="yarn"), "x")
    assert tables.scratch_dir(Session(spark_master="yarn", spark_checkpoint_dir="s3a://b/c/"), "x").startswith("s3a://b/c/x-")


def test_references_equal_the_library(spark):
    """Every name with and without its semicolon, every kind of number, and what only looks like a reference."""
    import html
    from html.entities import html5

    texts = [f"a &{n} b" for n in html5] + [f"&{n}x;&{n}" for n in html5 if not n.endswith(";")] + [f"&{n[:-1]}" for n in html5 if n.endswith(";")]
    codes = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**10, 2**64, 10**40]
    texts += [t for c in codes for t in (f"x&#{c};y", f"&#{c} z", f"&#x{c:x};", f"&#X{c:X}g", f"&#000{c};")]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg", "& amp;", "&amp;amp;", "&ampamp;", "&notit;", "&notin;", "&NotAName;", "&" + "a" * 40 + ";", "no reference", "&lt;p&gt; &quot;q&quot;", "tail &", "&#38;lt;", "&\tx;", "&amp&amp", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", files.unescape_html(F.col("t")).alias("u"))
    assert "Python" not in df.select("u")._jdf.queryExecution().optimizedPlan().toString().replace("LogicalRDD", "")
    wrong = [(r.t, r.u) for r in df.collect() if r.u != (None if r.t is None else html.unescape(r.t))]
    assert not wrong, wrong[:5]
