"""Tables as workbooks: one file a key, one sheet a name."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from typing import IO
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_workbook(file: IO[bytes], sheets: Iterable[tuple[str, Iterable[Iterable]]]) -> None:
    """Sheets (name, rows) as a workbook; rows are written as they come."""
    names = []
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        for i, (name, rows) in enumerate(sheets, 1):
            names.append(name)
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for k, row in enumerate(rows, 1):
                    part.write(f'<row r="{k}">{"".join(map(_cell, row))}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{targets}</Relationships>')


def export_workbooks(df: DataFrame, key: str, sheet: str, order: list[str], columns: list[str], folder: str) -> DataFrame:
    """Writes a workbook `key`.xlsx below `folder` for each key, with a sheet for each
    value of `sheet` and a header; returns (file). Rows stream through in order, so a task
    holds no sheet; what a key has must fit one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(base, recursive=True)
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)))
        row = next(rows, None)
        made = []
        while row is not None:
            name = row[0]

            def sheets(name=name):
                nonlocal row
                while row is not None and row[0] == name:
                    tab = row[1]

                    def lines(tab=tab):
                        nonlocal row
                        yield columns
                        while row is not None and row[:2] == (name, tab):
                            yield row[2:]
                            row = next(rows, None)

                    yield tab, lines()

            with system.open_output_stream(f"{base}/{name}.xlsx") as file:
                write_workbook(file, sheets())
            made.append(f"{name}.xlsx")
        yield pa.record_batch([pa.array(made, pa.string())], ["file"])

    narrow = df.select(F.col(key).cast("string").alias("_key"), F.col(sheet).cast("string").alias("_sheet"), *order, *columns)
    dealt = narrow.repartition("_key").sortWithinPartitions("_key", "_sheet", *order).select("_key", "_sheet", *columns)
    return dealt.mapInArrow(run, "file string")
