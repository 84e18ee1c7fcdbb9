"""Workbooks (.xlsx) as a Spark data source, by sheet and range of rows.

A workbook is a ZIP of XML parts. Planning lists the files; of those that may hold more
than a range it reads the directory and the list of sheets, several files at a time. A
task opens its files at random places (`pyarrow.fs`, so a local path or the address of an
object store or HDFS), inflates its own sheets and parses the rows that begin in its
ranges of a sheet's XML. What lies before a range is inflated and its row tags are
counted, nothing more, so that rows are numbered alike in every split.

Ranges are dealt to tasks in order, and those of one sheet that lie side by side are read
as one: a task inflates what lies before its first range only, and there are no more
tasks than the workbooks' size asks for, however many files, sheets or ranges there are.

Options: `path` of a file or a folder of them; `sheets` a regular expression that a
name must match, without regard to case; `rangeBytes` of XML a range (64 MB); `tasks`
that the ranges are dealt to, more if these had over 64 MB each (a task a range if unset).
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.cells import shared_parts, sheet_parts, row_cells

SCHEMA = "file string, sheet string, sheet_no int, _row long, cells array<string>"
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("_row", pa.int64()), ("cells", pa.list_(pa.string()))])
RANGE_BYTES = 64 << 20
_CHUNK, _LONGEST = 1 << 20, 64
#: What a byte of a file is taken to inflate to, and files opened at once.
_INFLATES, _OPEN = 16, 16
_ROW = re.compile(rb"<(?:\w{1,20}:)?row[\s>/]")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _listed(path: str) -> list[tuple[str, fs.FileInfo]]:
    """Addresses of the workbooks at `path`, in order, and what one listing tells of them."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.Directory:
        return [(path, info)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    base = path.rstrip("/")
    return sorted(((base + f.path[len(at.rstrip("/")) :], f) for f in found if f.type == fs.FileType.File and f.extension.lower() == "xlsx"), key=lambda x: x[0])


def files_of(path: str) -> list[str]:
    """Addresses of the workbooks at `path`, in order."""
    return [file for file, _ in _listed(path)]


def _book(path: str) -> zipfile.ZipFile:
    system, at = _open(path)
    return zipfile.ZipFile(system.open_input_file(at))


@lru_cache(maxsize=2)
def _shared(path: str, stamp: str) -> tuple[list[str], list[bool]]:
    """Of one version of a file; the ranges of a workbook that a worker reads share it."""
    with _book(path) as book:
        return shared_parts(book)


@dataclass
class SheetRange:
    """A range of a sheet; without a `part`, all sheets of a file that is not yet opened."""

    path: str
    stamp: str
    size: int
    sheet: str = ""
    sheet_no: int = 0
    part: str = ""
    start: int = 0
    end: int = 0


@dataclass
class Share(InputPartition):
    """What a task reads."""

    ranges: list[SheetRange] = field(default_factory=list)


def dealt(ranges: list[SheetRange], size: float) -> list[Share]:
    """Ranges in shares of about `size`, in order; those side by side in a sheet as one."""
    shares, filled = [], size
    for r in ranges:
        if not shares or filled + r.size / 2 > size:
            shares.append(Share())
            filled = 0
        own = shares[-1].ranges
        if own and r.part and (own[-1].path, own[-1].sheet_no, own[-1].end) == (r.path, r.sheet_no, r.start):
            own[-1] = replace(own[-1], size=own[-1].size + r.size, end=r.end)
        else:
            own.append(r)
        filled += r.size
    return shares


def rows_in(stream, start: int, end: int) -> Iterator[tuple[int, ElementTree.Element]]:
    """(number, row) of the rows whose tag begins in [start, end) of a sheet's XML."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    buffer, at, number, first, holder = b"", 0, 0, None, None
    head, feeding = True, False

    def ready() -> Iterator[tuple[int, ElementTree.Element]]:
        nonlocal first, holder
        parser.flush()  # The parser may keep short pieces back.
        for event, element in parser.read_events():
            name = element.tag.rsplit("}", 1)[-1]
            if event == "start" and name == "sheetData":
                holder = element
            elif event == "end" and name == "row":
                yield first, element
                first += 1
                holder.clear()

    while True:
        chunk = stream.read(_CHUNK)
        buffer += chunk
        sure = len(buffer) - (_LONGEST if chunk else 0)
        taken = 0
        for tag in _ROW.finditer(buffer):
            if tag.start() >= sure:
                break
            if head:
                parser.feed(buffer[: tag.start()])
                head, taken = False, tag.start()
            place = at + tag.start()
            if feeding and place >= end:
                parser.feed(buffer[taken : tag.start()])
                yield from ready()
                return
            if not feeding and start <= place < end:
                feeding, first, taken = True, number, tag.start()
            number += 1
            if not feeding and place >= end:
                return
        if sure > 0:
            if head or feeding:
                parser.feed(buffer[taken:sure])
                yield from ready()
            buffer, at = buffer[sure:], at + sure
        if not chunk:
            return


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("a workbook needs a path")
        self.path, self.sheets = options["path"], options.get("sheets")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.tasks = int(options.get("tasks", 0))

    def _sheets(self, book: zipfile.ZipFile) -> Iterator[tuple[int, str, str, int]]:
        """(number, name, part, bytes) of the sheets that are asked for."""
        for i, (sheet, part) in enumerate(sheet_parts(book)):
            if not self.sheets or re.match(self.sheets, sheet, re.IGNORECASE):
                yield i, sheet, part, book.getinfo(part).file_size

    def _ranges(self, listed: tuple[str, fs.FileInfo]) -> list[SheetRange]:
        path, info = listed
        stamp = f"{info.size} {info.mtime_ns}"
        if info.size and info.size * _INFLATES <= self.range_bytes:
            return [SheetRange(path, stamp, info.size * _INFLATES)]
        with _book(path) as book:
            return [SheetRange(path, stamp, min(self.range_bytes, size - k), sheet, i, part, k, min(k + self.range_bytes, size)) for i, sheet, part, size in self._sheets(book) for k in range(0, max(size, 1), self.range_bytes)]

    def partitions(self) -> list[Share]:
        with ThreadPoolExecutor(_OPEN) as opened:
            ranges = [r for some in opened.map(self._ranges, _listed(self.path)) for r in some]
        share = min(RANGE_BYTES, sum(r.size for r in ranges) / self.tasks) if self.tasks else 0
        return dealt(ranges, share) or [Share()]

    def read(self, split: Share) -> Iterator[pa.RecordBatch]:
        rows = []

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            return made

        for r in split.ranges:
            strings, dates = _shared(r.path, r.stamp)
            with _book(r.path) as book:
                for i, sheet, part, start, end in [(r.sheet_no, r.sheet, r.part, r.start, r.end)] if r.part else [(i, sheet, part, 0, size) for i, sheet, part, size in self._sheets(book)]:
                    with book.open(part) as stream:
                        for number, element in rows_in(stream, start, end):
                            cells = row_cells(element, strings, dates)
                            if any(c is not None for c in cells):
                                rows.append((r.path, sheet, i, number, cells))
                            if len(rows) >= 4096:
                                yield batch()
        if rows:
            yield batch()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))


def read_sheets(spark: SparkSession, path: str, sheets: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows file, sheet, sheet_no, _row, cells of the workbooks at `path`."""
    spark.dataSource.register(WorkbookSource)
    source = spark.read.format("workbook").option("rangeBytes", range_bytes).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    return (source.option("sheets", sheets) if sheets else source).load(path)


def sheet_names(path: str) -> list[str]:
    """From the directories alone."""
    out: list[str] = []
    for file in files_of(path):
        with _book(file) as book:
            out += [name for name, _ in sheet_parts(book)]
    return out
