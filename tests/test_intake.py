"""Files to rows in any split, and files to stored profiles."""

import io
import json
import zipfile

import pytest

from millrace.plans import intake, profile
from millrace.sources import readers, workbook
from millrace.sources.export import write_workbook


def telemetry(n, unit):
    return [("At", "Kind", "Load (t)"), *((f"2024-01-0{1 + i % 3}T00:{i % 60:02d}:{i // 60 % 60:02d}", "full" if i // 5 % 2 else "empty", float(unit + i % 7)) for i in range(n))]


@pytest.fixture
def book(tmp_path):
    """Sixteen data sheets, a long header comment, blank rows, and incidents last."""
    path = tmp_path / "mine.xlsx"
    sheets = [(f"Truck {k}", [*telemetry(40 + k, k), (None, None, None), ("2024-01-03T01:00:00", "<row r='9'> & \"é\"", 3.5)]) for k in range(16)]
    with open(path, "wb") as f:
        write_workbook(f, [*sheets, ("Anomalías", [("Caso", "Inicio", "Fin"), ("leak", "2024-01-02", "2024-01-02T12:00:00")])])
    return str(path)


@pytest.mark.parametrize("range_bytes", [97, 1000, 1 << 26])
def test_any_range_gives_the_same_rows(spark, book, range_bytes):
    got = {(r["sheet"], r["_row"]): r["cells"] for r in workbook.read_sheets(spark, book, range_bytes=range_bytes).collect()} if range_bytes > 97 else rows_by_hand(book, range_bytes)
    want = {(f"Truck {k}", i): [c if isinstance(c, str) else repr(c) for c in row] for k in range(16) for i, row in enumerate(telemetry(40 + k, k))}
    want |= {(f"Truck {k}", 42 + k): ["2024-01-03T01:00:00", "<row r='9'> & \"é\"", "3.5"] for k in range(16)}
    assert {k: v for k, v in got.items() if k[0] != "Anomalías"} == want and len(got) == len(want) + 2


def rows_by_hand(book, size):
    """Every range in turn, without Spark."""
    reader = workbook.WorkbookReader({"path": book, "rangeBytes": str(size)})
    found = [b.to_pylist() for split in reader.partitions() for b in reader.read(split)]
    rows = [r for part in found for r in part]
    assert len(rows) == len({(r["sheet"], r["_row"]) for r in rows})
    return {(r["sheet"], r["_row"]): r["cells"] for r in rows}


def test_rows_across_chunks(monkeypatch):
    """Tags that lie across the pieces in which a sheet is inflated."""
    monkeypatch.setattr(workbook, "_CHUNK", 70)
    xml = b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols/><sheetData>' + b"".join(b'<row r="%d"><c><v>%d</v></c></row>' % (i, i) for i in range(1, 300)) + b"</sheetData><rowBreaks/></worksheet>"
    for size in (1, 33, 500, 10**6):
        got = [(n, e[0][0].text) for a in range(0, len(xml), size) for n, e in workbook.rows_in(io.BytesIO(xml), a, a + size)] if size > 1 else None
        assert size == 1 or got == [(i, str(i + 1)) for i in range(299)]
    assert list(workbook.rows_in(io.BytesIO(b"<worksheet><sheetData/></worksheet>"), 0, 99)) == []


def test_names_select_sheets_and_nothing_is_nothing(spark, book, tmp_path):
    assert {r["sheet"] for r in workbook.read_sheets(spark, book, "truck 1").select("sheet").distinct().collect()} == {"Truck 1", *(f"Truck {k}" for k in range(10, 16))}
    assert workbook.read_sheets(spark, book, "none").count() == 0
    (tmp_path / "void").mkdir()
    assert workbook.read_sheets(spark, str(tmp_path / "void")).count() == 0
    assert workbook.sheet_names(book)[-1] == "Anomalías"


def test_workbook_to_profile(spark, book, tmp_path):
    facets = intake.profile_file(spark, book, "mine-1", str(tmp_path / "store"))
    sheets = {r["sheet"]: r for r in facets["sheets"].collect()}
    assert sheets["Anomalías"]["reference"] == "incidents" and not sheets["Anomalías"]["contributes"]
    assert all(sheets[f"Truck {k}"]["contributes"] for k in range(16)) and len(sheets) == 17
    cells = {(r["category"], r["value"]): r for r in facets["cells"].where("measure = 'Load (t)'").collect()}
    n = sum(41 + k for k in range(16))
    assert sum(r["n"] for (c, _), r in cells.items() if c == "Kind") == n
    held = sum(1 for k in range(16) for row in telemetry(40 + k, k)[1:] if row[0].startswith("2024-01-02"))
    assert sum(r["ex_n"] for (c, _), r in cells.items() if c == "Kind") == held > 0
    assert facets["incidents"].count() == 1 and facets["catalogue"].first()["units"] == 16
    assert profile.load_profile(spark, "mine-1", str(tmp_path / "store"), "sheets").count() == 17


@pytest.mark.parametrize("kind", ["csv", "tsv", "json"])
def test_tables_to_profile(spark, tmp_path, kind):
    rows = telemetry(30, 1)
    path = tmp_path / f"yard.{kind}"
    if kind == "json":
        path.write_text(json.dumps({"rows": [dict(zip(rows[0], r)) for r in rows[1:]]}))
    else:
        path.write_text("\n".join(("," if kind == "csv" else "\t").join(map(str, r)) for r in rows))
    facets = intake.profile_file(spark, str(path), f"yard-{kind}", str(tmp_path / "store"))
    assert [(r["sheet"], r["rows"], r["contributes"]) for r in facets["sheets"].collect()] == [("yard", 30, True)]
    m = facets["measures"].where("measure = 'Load (t)'").first()
    values = [r[2] for r in rows[1:]]
    assert (m["n"], m["lo"], m["hi"], m["sum"]) == (30, min(values), max(values), sum(values))
    assert {r["value"]: r["n"] for r in facets["cells"].collect()} == {"empty": 15, "full": 15}


def test_contributing(spark):
    rows = [("a", 10, False, False), ("b", 501, False, False), ("r", 9, True, True), ("t", 3, False, True)]
    schema = "sheet string, rows long, is_reference boolean, has_time boolean"
    assert {r["sheet"] for r in intake.contributing(spark.createDataFrame(rows, schema)).where("contributes").collect()} == {"b", "t"}
    assert {r["sheet"] for r in intake.contributing(spark.createDataFrame(rows[:1] + rows[2:3], schema)).where("contributes").collect()} == {"a"}
    assert intake.contributing(spark.createDataFrame([], schema)).count() == 0


def test_rows_beyond_the_header_and_a_broken_id(spark, tmp_path):
    with pytest.raises(ValueError):
        intake.profile_file(spark, "x.csv", "../up", str(tmp_path))
    with pytest.raises(ValueError):
        workbook.WorkbookReader({})
    assert readers.kind_of_file("a/B.XLSX") == "xlsx" and readers.kind_of_file("a.tsv") == "csv"
    with open(tmp_path / "w.xlsx", "wb") as f:
        write_workbook(f, [("One", [("Name", "Load"), ("x", 1, "more"), ("y", None)])])
    assert zipfile.is_zipfile(tmp_path / "w.xlsx")
    found = intake.sheets_of(readers.read_rows(spark, str(tmp_path / "w.xlsx")))
    assert [c["name"] for c in found[0].columns] == ["Name", "Load", "col3"]


def test_ranges_are_dealt_by_size_not_by_number(tmp_path, monkeypatch):
    """As few tasks for many ranges or files as for few; each row once, and of each sheet
    what lies before a task's first range is inflated only once a task."""
    for k in range(9):
        with open(tmp_path / f"b{k}.xlsx", "wb") as f:
            write_workbook(f, [(f"S{k}-{j}", telemetry(150 + j, k)) for j in range(3)])
    opened = []
    rows_in = workbook.rows_in
    monkeypatch.setattr(workbook, "rows_in", lambda stream, start, end: opened.append(start) or rows_in(stream, start, end))
    want = {(f"S{k}-{j}", i) for k in range(9) for j in range(3) for i in range(151 + j)}
    for size in (500, 5000, 1 << 26):
        reader = workbook.WorkbookReader({"path": str(tmp_path), "rangeBytes": str(size), "tasks": "6"})
        shares = reader.partitions()
        opened.clear()
        rows = [(r["sheet"], r["_row"]) for share in shares for b in reader.read(share) for r in b.to_pylist()]
        assert len(rows) == len(want) and set(rows) == want
        assert 4 <= len(shares) <= 8 and len(opened) < 27 + len(shares)
        assert size > 500 or any(opened)


def test_small_files_are_planned_unopened(tmp_path, monkeypatch):
    with open(tmp_path / "a.xlsx", "wb") as f:
        write_workbook(f, [("Keep", [("A", "B"), ("x", 1)]), ("Leave", [("A", "B"), ("y", 2)])])
    reader = workbook.WorkbookReader({"path": str(tmp_path), "sheets": "keep", "tasks": "4"})
    with monkeypatch.context() as closed:
        closed.setattr(workbook, "_book", lambda path: pytest.fail("opened"))
        shares = reader.partitions()
    assert [(r["sheet"], r["_row"], r["cells"]) for s in shares for b in reader.read(s) for r in b.to_pylist()] == [("Keep", 0, ["A", "B"]), ("Keep", 1, ["x", "1"])]


def test_layouts_of_many_sheets_are_one_join(spark, tmp_path, monkeypatch):
    """No sheet's name is in the plan of the facets, whatever the sheets look like; each
    column is taken where its sheet has it, the first of one name."""
    day = lambda i: f"2024-01-0{1 + i % 3}T00:00:{i:02d}"
    sheets = []
    for k in range(12):
        names = [("At", "Kind", "Load"), ("Load", "At", "Kind"), ("Kind", "Load", "At", "Load"), ("Kind", "Extra", "At", "Load")][k % 4]
        value = {"At": day, "Kind": lambda i: "ab"[i % 2], "Load": lambda i: float(i), "Extra": lambda i: 7.0}
        rows = [[value[n](i) for n in names] for i in range(20)]
        if k % 4 == 2:
            for r in rows:
                r[3] = 1000.0
        sheets.append((f"Yard {k}", [names, *rows]))
    sheets += [(f"Case {k}", [("Caso", "Inicio", "Fin"), (f"leak{k}", f"2024-01-0{2 + k}", f"2024-01-0{2 + k}T12:00:00")]) for k in range(2)]
    with open(tmp_path / "yards.xlsx", "wb") as f:
        write_workbook(f, sheets)
    plans = []
    facets_of = profile.profile
    monkeypatch.setattr(intake.profile, "profile", lambda df, *a: plans.append(df._jdf.queryExecution().analyzed().toString()) or facets_of(df, *a))
    facets = intake.profile_file(spark, str(tmp_path / "yards.xlsx"), "yards", str(tmp_path / "store"))
    assert plans and "Yard" not in plans[0] and "Union" not in plans[0] and "Join" not in plans[0]
    cells = {(r["value"], r["measure"]): r for r in facets["cells"].collect()}
    held = {v: sum(i % 3 > 0 for i in range(20) if "ab"[i % 2] == v) for v in "ab"}
    assert {k: (r["n"], r["mean"], r["ex_n"]) for k, r in cells.items()} == {("a", "Load"): (120, 9.0, 12 * held["a"]), ("b", "Load"): (120, 10.0, 12 * held["b"]), ("a", "Extra"): (30, 7.0, 3 * held["a"]), ("b", "Extra"): (30, 7.0, 3 * held["b"])}
    told = {r["sheet"]: r for r in facets["sheets"].collect()}
    assert facets["incidents"].count() == 2 and [s for s, r in told.items() if r["reference"]] and all(r["contributes"] == s.startswith("Yard") for s, r in told.items())
