"""The XML parts of a workbook: its sheets, what they share, and the cells of a row."""

from __future__ import annotations

import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def serial_to_iso(v: float) -> str:
    """A workbook's day number as text; numbers below 60 are a day late there."""
    at = datetime(1899, 12, 30) + timedelta(milliseconds=int((v + (1 if v < 60 else 0)) * 86_400_000 + 0.5))
    return at.strftime("%Y-%m-%d" if v == int(v) else "%Y-%m-%dT%H:%M:%S")


def column_index(reference: str) -> int:
    index = 0
    for c in reference:
        if not c.isalpha():
            break
        index = index * 26 + ord(c.upper()) - 64
    return index - 1


def _is_date(code: str) -> bool:
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def shared_parts(book: zipfile.ZipFile) -> tuple[list[str], list[bool]]:
    """The shared strings, and which styles are dates."""
    strings, dates = [], []
    names = set(book.namelist())
    if "xl/sharedStrings.xml" in names:
        strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()]
    if "xl/styles.xml" in names:
        root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
        formats = root.find(f"{_MAIN}cellXfs")
        for xf in formats if formats is not None else ():
            i = int(xf.get("numFmtId", "0"))
            dates.append(14 <= i <= 22 or 45 <= i <= 47 or i in own and _is_date(own[i]))
    return strings, dates


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    sheets = ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet")
    return [(s.get("name"), "xl/" + targets[s.get(f"{_REL}id")].removeprefix("/xl/")) for s in sheets]


def row_cells(row: ElementTree.Element, strings: list[str], dates: list[bool]) -> list[str | None]:
    """Texts of a row's cells at their columns; errors and blanks are null."""
    cells: list[str | None] = []
    for c in row.iter(f"{_MAIN}c"):
        at = column_index(c.get("r", "")) if c.get("r") else len(cells)
        cells += [None] * (at + 1 - len(cells))
        kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
        if kind == "s" and v is not None:
            cells[at] = strings[int(v)]
        elif kind == "inlineStr":
            cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        elif kind == "b":
            cells[at] = "TRUE" if v == "1" else "FALSE"
        elif kind != "e" and v:
            style = int(c.get("s", "0"))
            cells[at] = serial_to_iso(float(v)) if kind == "n" and style < len(dates) and dates[style] else v
    return [c or None for c in cells]
