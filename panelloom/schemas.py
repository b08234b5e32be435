"""Explicit schemas of the raw files, so that no scan is spent on inference."""

from pyspark.sql import types as T

# Headings of the raw price files, in file order.
PRICES_RAW = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Adj Close", T.DoubleType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("Volume", T.LongType()),
    ]
)

PRICES_RENAME = {
    "Date": "date",
    "Adj Close": "adj_close",
    "Close": "close",
    "High": "high",
    "Low": "low",
    "Open": "open",
    "Volume": "volume",
}

# Headings of the raw event files, in file order.
DIVIDENDS_RAW = T.StructType(
    [
        T.StructField("y", T.IntegerType()),
        T.StructField("m", T.IntegerType()),
        T.StructField("d", T.IntegerType()),
        T.StructField("ad", T.StringType()),
        T.StructField("ed", T.StringType()),
        T.StructField("pd", T.StringType()),
        T.StructField("et", T.StringType()),
        T.StructField("etd", T.StringType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("ov", T.DoubleType()),
        T.StructField("sv", T.StringType()),
        T.StructField("sov", T.StringType()),
        T.StructField("adj", T.BooleanType()),
    ]
)

SERIES_TIDY = T.StructType(
    [T.StructField("Data", T.StringType()), T.StructField("Fechamento", T.DoubleType())]
)

MACRO_RAW = T.StructType(
    [T.StructField("data", T.StringType()), T.StructField("valor", T.StringType())]
)

# Month headings of the calendar-matrix files, in month order.
MATRIX_MONTHS = [
    "Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez",
]

CALENDAR_MATRIX = T.StructType(
    [T.StructField("Dia", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in MATRIX_MONTHS]
)

# Date formats met in the raw files.
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy"]
