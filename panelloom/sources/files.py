"""Raw files -> typed frames: CSV globs, calendar matrices, macro JSON, embedded payloads."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5 as entities

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom import schemas
from panelloom.functions.scalars import parse_date_multi, parse_decimal_comma


def read_panel_csv(
    spark: SparkSession, glob: str, schema: T.StructType, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """All files of a glob under an explicit schema: no inference scan.

    A file whose header names other columns, or the same ones in another order, is refused.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("enforceSchema", False)
        .csv(glob)
    )


def rejected_cells(
    spark: SparkSession, glob: str, schema: T.StructType, parsers: dict[str, Callable[[Column], Column]] | None = None, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """(file, record, column, text): every cell that holds text but no value of its column's type.

    `record` is the whole row as read, so that the row can be found in its file. `parsers` replaces the
    plain cast for columns with a format of their own. One scan, no shuffle; the typed readers turn
    exactly these cells to NULL.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = read_panel_csv(spark, glob, texts, sep, encoding).select("*", F.col("_metadata.file_path").alias("__file"))
    cells = []
    for field in schema.fields:
        text = F.col(f"`{field.name}`")
        value = (parsers or {}).get(field.name, lambda c, kind=field.dataType: F.trim(c).try_cast(kind))(text)
        bad = (F.trim(text) != "") & value.isNull()
        cells.append(F.when(bad, F.struct(F.lit(field.name).alias("column"), text.alias("text"))))
    record = F.array_join(F.array(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in schema.fields]), sep)
    found = raw.select(F.col("__file").alias("file"), record.alias("record"), F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    return found.select("file", "record", "cell.column", "cell.text")


def with_file_key(df: DataFrame, pattern: str, out: str) -> DataFrame:
    """Adds the first capture group of a regex on the source file's path."""
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def with_lineage(df: DataFrame) -> DataFrame:
    """Adds source_file and ingestion_timestamp (one instant per query)."""
    return df.withColumns(
        {"source_file": F.col("_metadata.file_path"), "ingestion_timestamp": F.current_timestamp()}
    )


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def read_macro_json(spark: SparkSession, path: str, value_name: str) -> DataFrame:
    """Arrays of {"data": "dd/MM/yyyy", "valor": "<number>"} -> (date, value_name).

    A file is one array and is parsed by one task; a glob of files spreads over tasks.
    """
    raw = spark.read.schema(schemas.MACRO_RAW).option("multiLine", True).json(path)
    return raw.select(
        parse_date_multi(F.col("data"), schemas.DATE_FORMATS).alias("date"),
        F.col("valor").try_cast("double").alias(value_name),
    )


def read_calendar_matrix(spark: SparkSession, path: str, year: int, encoding: str = "ISO-8859-1") -> DataFrame:
    """Day x month matrix file (title line, ';', decimal comma, footer rows) -> (date, value)."""
    raw = (
        spark.read.schema(schemas.CALENDAR_MATRIX)
        .option("sep", ";")
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return unpivot_calendar(raw, F.lit(year))


def unpivot_calendar(df: DataFrame, year: Column, day: str = "Dia") -> DataFrame:
    """(date, value) from a day x month matrix.

    Rows whose day is no number (titles, footers), empty cells and impossible dates (30 Feb) go.
    """
    months = schemas.MATRIX_MONTHS
    number = F.create_map(*[x for i, m in enumerate(months, 1) for x in (F.lit(m), F.lit(i))])
    long = df.select(year.cast("int").alias("__year"), F.col(day).try_cast("int").alias("__day"), *months).where(
        F.col("__day").isNotNull()
    ).unpivot(["__year", "__day"], list(months), "__month", "__text")
    text = F.format_string("%04d-%02d-%02d", F.col("__year"), number[F.col("__month")], F.col("__day"))
    return long.select(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date").alias("date"),
        parse_decimal_comma(F.col("__text")).alias("value"),
    ).where(F.col("date").isNotNull() & F.col("value").isNotNull())


def _prioritised(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [df.withColumn("__source", F.lit(i)) for i, df in enumerate(dfs)]
    )


def union_dedupe(dfs: Sequence[DataFrame], key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Stacks parts and keeps one row per key: the earliest part, then the smallest `order`.

    Deterministic, unlike dropDuplicates; the row_number = 1 filter keeps one candidate per key
    and task before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy("__source", *order)
    stacked = _prioritised(dfs).withColumn("__rn", F.row_number().over(w))
    return stacked.where("__rn = 1").drop("__rn", "__source")


def extend_series(old: DataFrame, new: DataFrame, key: Sequence[str] = ("date",)) -> DataFrame:
    """A stored series extended with newer rows; on a shared key the new row wins."""
    return union_dedupe([new, old], key)


# what numeric references to some code points stand for: those of the bytes 0x80 to 0x9F of Windows-1252 and two more
_REPLACED = {0x00: 0xFFFD, 0x0D: 0x0D} | {b: ord(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(0x80, 0xA0)}
#: references that need no list of names; that of the ampersand last, as what it leaves is not decoded again
_FREQUENT = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&apos;": "'", "&amp;": "&"}
_OTHERS = f"&(?!(?:{'|'.join(r[1:] for r in _FREQUENT)}))"


def _numeric(digits: Column, base: int) -> Column:
    """The character of a numeric reference; no character for code points that stand for none."""
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    # ten digits are over the last code point in either base, and more might not fit a number
    code = F.when(F.length(digits) < 10, F.conv(digits, base, 10).cast("long")).otherwise(F.lit(1 << 40))
    replaced = F.create_map(*[F.lit(v).cast("long") for pair in _REPLACED.items() for v in pair])
    code = F.coalesce(F.try_element_at(replaced, code), code)
    known = F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(0xFFFD)).otherwise(code)
    # controls of the replaced range that stand for themselves are characters, other controls and non-characters are none
    controls = known.between(0x01, 0x08) | known.between(0x0E, 0x1F) | known.isin(0x0B, 0x7F) | known.between(0xFDD0, 0xFDEF) | (known % 0x10000 >= 0xFFFE)
    return F.when(controls, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32"))


def unescape_html(text: Column) -> Column:
    """All HTML character references of a column, as `html.unescape` decodes them, with built-in functions only.

    The text is cut at its ampersands and each part decodes what it starts with: a decimal or hexadecimal
    number, a name, or a name of the old standard that needs no semicolon, the longest of them. An unknown
    name stays as it is. A text with no other references than the frequent ones is decoded by plain replacement.
    """
    by_name = F.from_json(F.lit(json.dumps(entities)), "map<string, string>")
    old = "|".join(sorted((n for n in entities if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([^\t\n\f <&#;]{1,32};?)", 1)
        short = F.regexp_extract(part, f"^({old})", 1)
        whole = F.try_element_at(by_name, name)

        def after(matched: Column) -> Column:
            return F.substring(part, F.length(matched) + 1, F.length(part))

        decimal, hexadecimal = (F.regexp_extract(part, pattern, 0) for pattern in ("^#[0-9]+;?", "^#[xX][0-9a-fA-F]+;?"))
        return (
            F.when(decimal != "", F.concat(_numeric(F.regexp_extract(decimal, "[0-9]+", 0), 10), after(decimal)))
            .when(hexadecimal != "", F.concat(_numeric(F.regexp_extract(hexadecimal, "^#[xX]([0-9a-fA-F]+)", 1), 16), after(hexadecimal)))
            .when(whole.isNotNull(), F.concat(whole, after(name)))
            .when(short != "", F.concat(F.try_element_at(by_name, short), after(short)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&")
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))
    plain = text
    for reference, character in _FREQUENT.items():
        plain = F.replace(plain, F.lit(reference), F.lit(character))
    return F.when(~text.contains("&"), text).when(~text.rlike(_OTHERS), plain).otherwise(joined)


def extract_embedded(df: DataFrame, html_col: str, pattern: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a JSON array held, entity-escaped, in an HTML attribute.

    `pattern` captures the attribute; documents without it yield nothing.
    """
    captured = df.select(*keep, F.regexp_extract(F.col(html_col), pattern, 1).alias("__raw")).where(
        F.col("__raw") != ""
    )
    parsed = captured.withColumn("__rows", F.from_json(unescape_html(F.col("__raw")), f"array<{schema}>"))
    return parsed.select(*keep, F.explode("__rows").alias("__row")).select(*keep, "__row.*")
