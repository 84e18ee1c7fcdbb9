"""Untyped rows from CSV, JSON and workbooks: (sheet, _row, cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources import workbook

DELIMITERS = (",", ";", "\t", "|")


def sniff_delimiter(line: str) -> str:
    """The delimiter that gives the first line most fields; the earlier wins ties."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def read_delimited(spark: SparkSession, path: str, sheet: str, delimiter: str | None = None) -> DataFrame:
    """Rows of a delimited file; empty fields are null, blank rows are left out.

    `_row` orders the rows of one file as they stand in it.
    """
    if delimiter is None:
        first = spark.read.text(path).first()
        delimiter = sniff_delimiter(first[0] if first else "")
    raw = spark.read.csv(path, sep=delimiter, header=False, multiLine=True, quote='"', escape='"', nullValue="", inferSchema=False)
    cells = F.array(*(F.col(c) for c in raw.columns))
    rows = raw.select(F.lit(sheet).alias("sheet"), F.monotonically_increasing_id().alias("_row"), cells.alias("cells"))
    return rows.where(F.exists("cells", lambda c: c.isNotNull()))


def read_json_records(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """Records of a JSON file: an array, or the list in its `rows` or `data` field.

    Nested values become JSON text; the first row holds the names.
    """
    raw = spark.read.json(path, multiLine=True)
    for field in ("rows", "data"):
        if field in raw.columns and dict(raw.dtypes)[field].startswith("array<struct"):
            raw = raw.select(F.inline(field))
            break
    text = [F.to_json(c).alias(c) if kind.startswith(("struct", "array", "map")) else F.col(c).cast("string").alias(c) for c, kind in raw.dtypes]
    rows = raw.select(*text).select(F.lit(sheet).alias("sheet"), (F.monotonically_increasing_id() + 1).alias("_row"), F.array(*raw.columns).alias("cells"))
    names = spark.createDataFrame([(sheet, 0, raw.columns)], "sheet string, _row long, cells array<string>")
    return names.unionByName(rows)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every sheet of the workbooks at `path` (workbook.py)."""
    return workbook.read_sheets(spark, path).select("sheet", "_row", "cells")


def kind_of_file(path: str) -> str:
    """csv, json or xlsx, by the name's ending; anything else is read as csv."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return ending if ending in ("json", "xlsx") else "csv"


def read_rows(spark: SparkSession, path: str, sheets: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows (sheet, _row, cells) of a file of any known kind, or a folder of workbooks
    (`kind` is then xlsx); the one sheet of a csv, tsv or json file is named like the file.
    `sheets`: only those whose names match."""
    kind, stem = kind or kind_of_file(path), path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if kind == "xlsx":
        return workbook.read_sheets(spark, path, sheets).select("sheet", "_row", "cells")
    if kind == "json":
        return read_json_records(spark, path, stem)
    return read_delimited(spark, path, stem, "\t" if path.lower().endswith(".tsv") else None)


def headers(rows: DataFrame, look: int = 12) -> DataFrame:
    """Rows (sheet, at, names): the header of each sheet.

    It is the row among the first `look` with the best score: two live cells or more,
    none numeric, and as many live cells below. Only the first rows of a sheet leave
    the tasks that read it.
    """
    order = Window.partitionBy("sheet").orderBy("_row")
    head = rows.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= look + 1)
    live = F.size(F.filter("cells", lambda c: c.isNotNull()))
    scored = head.withColumn("live", live).withColumn("below", F.coalesce(F.lead("live").over(order), F.lit(0)))
    numeric = F.exists("cells", lambda c: c.rlike(r"^\s*-?[0-9][0-9.,]*\s*$"))
    found = scored.where((F.col("_i") <= look) & (F.col("live") >= 2) & ~F.coalesce(numeric, F.lit(False)))
    return found.groupBy("sheet").agg(F.max_by(F.struct(F.col("_row").alias("at"), F.col("cells").alias("names")), F.struct(F.least("live", "below"), -F.col("_row"))).alias("h")).select("sheet", "h.at", "h.names")


def with_header(rows: DataFrame, look: int = 12, found: DataFrame | None = None) -> DataFrame:
    """Rows (sheet, _row, column, name, cell): cells under the header found (`headers`,
    where they are known). Cells beyond it get names of their own."""
    body = rows.join(headers(rows, look) if found is None else found, "sheet").where(F.col("_row") > F.col("at"))
    cell = body.select("sheet", "_row", F.posexplode("cells").alias("column", "cell"), "names")
    name = F.coalesce(F.get("names", F.col("column")), F.concat(F.lit("col"), F.col("column") + 1))
    return cell.select("sheet", "_row", "column", name.alias("name"), "cell")
