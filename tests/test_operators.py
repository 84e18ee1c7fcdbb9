import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import crosstab, cycles, generator, ordered, risk, rollup
from millrace.sources import readers
from millrace.streaming.eventlog import edge_stream


def test_cycles_by_hand(spark):
    values = [0.0, 5.0, 10.0, 0.1, 0.0, 8.0, 0.0, 3.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "u string, i long, v double")
    got = cycles.label_cycles(df, "u", "v", ["i"]).orderBy("i").collect()
    assert [r["completes"] for r in got] == [False, False, False, True, False, False, True, False]
    assert [r["cycle"] for r in got] == [0, 0, 0, 0, 1, 1, 1, 2]
    assert [r["cycle_peak"] for r in got if r["completes"]] == [10.0, 8.0]


def test_edge_events(spark):
    ticks = [("k", 0, False), ("k", 10, True), ("k", 20, None), ("k", 30, False), ("k", 35, True), ("k", 90, False), ("k", 200, True)]
    df = spark.createDataFrame(ticks, "key string, at long, fires boolean")
    got = risk.edge_events(df, ["key"], "at", ["at"], cooldown=30).orderBy("at").collect()
    assert [(r["kind"], r["at"], r["held_ms"], r["suppressed"]) for r in got] == [("breach", 10, None, False), ("recovered", 30, 20, False), ("breach", 35, None, True), ("recovered", 90, 55, False), ("breach", 200, None, False)]


def test_event_stream(spark, tmp_path):
    ticks = [("k", 0, False, True), ("k", 10, True, True), ("k", 20, None, True), ("k", 30, False, True), ("k", 35, True, True), ("k", 40, True, False)]
    schema = "key string, at long, fires boolean, enabled boolean"
    (tmp_path / "in").mkdir()
    spark.createDataFrame(ticks[:3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = edge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cooldown=30)
    for i in range(2):
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
        if i == 0:
            spark.createDataFrame(ticks[3:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()
    assert [(r["kind"], r["at"], r["held_ms"], r["suppressed"]) for r in got] == [("breach", 10, None, False), ("recovered", 30, 20, False), ("breach", 35, None, True), ("silenced", 40, 5, False)]


def test_quarantine_with_open_and_overlapping_windows(spark):
    at = lambda *a: datetime(2024, *a)
    rows = spark.createDataFrame([(i, at(1, i + 1, 12)) for i in range(20)], "id long, ts timestamp_ntz")
    windows = spark.createDataFrame([(at(1, 2), at(1, 4)), (at(1, 3), at(1, 6)), (at(1, 18), None), (None, at(1, 1))], "start timestamp_ntz, end timestamp_ntz")
    got = {r["id"] for r in crosstab.quarantined_by(rows, "ts", windows).where("quarantined").collect()}
    assert got == {1, 2, 3, 4, 17, 18, 19}


def test_worst_of(spark):
    parts = {"performance": F.col("a"), "touchpoints": F.col("b")}
    df = spark.createDataFrame([(40.0, 40.0), (None, 7.2), (None, None), (500.0, 3.0)], "a double, b double")
    assert [tuple(r["w"]) for r in df.select(rollup.worst_of(parts).alias("w")).collect()] == [(40.0, "performance"), (7.0, "touchpoints"), (None, None), (100.0, "performance")]


def test_generator_is_addressable(spark):
    rows = [(u, i, "ab"[i // 3 % 2], 10.0 * (1 + i // 3 % 2) + u, datetime(2024, 1, 1, 0, i)) for u in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "u long, i long, s string, v double, ts timestamp_ntz")
    found = ordered.runs(df, "u", "s", "ts", ["i"], "v")
    states, units = generator.build_plan(df, "u", "s", "v", found)
    whole = {(r["unit"], r["at"]): r["value"] for r in generator.generate(states, units, 0, 3600, 60, "x").collect()}
    part = {(r["unit"], r["at"]): r["value"] for r in generator.generate(states, units, 1200, 1800, 60, "x").collect()}
    assert len(whole) == 2 * 61
    assert part and all(whole[k] == v for k, v in part.items())


def test_in_context_window(spark):
    windows = [{"name": "night", "dim": "hour", "start": 0, "end": 6}, {"name": "wet", "dim": "road", "values": ["Wet", "Ice"]}]
    df = spark.createDataFrame([(5, "dry"), (6, "WET"), (7, "dry")], "h int, road string")
    assert [r[0] for r in df.select(risk.in_context_window(windows, F.col("h"), {"road": F.col("road")})).collect()] == ["night", "wet", None]


def test_delimited_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"a;\nb"\n;\n3;\n')
    got = readers.read_delimited(spark, str(tmp_path / "a.csv"), "a").orderBy("_row").collect()
    assert [r["cells"] for r in got] == [["x", "y"], ["1", "a;\nb"], ["3", None]]
    (tmp_path / "b.json").write_text('{"rows": [{"k": 1, "n": {"z": true}}, {"k": 2}]}')
    got = readers.read_json_records(spark, str(tmp_path / "b.json"), "b").orderBy("_row").collect()
    assert [r["cells"] for r in got] == [["k", "n"], ["1", '{"z":true}'], ["2", None]]


def _workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Load (ton)</t></is></c></row><row r="2"><c r="A2" s="1"><v>45292.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>7.5</v></c><c r="D2" t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="T1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Timestamp</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbook_and_header(spark, tmp_path):
    _workbook(tmp_path / "w.xlsx")
    rows = readers.read_workbook(spark, str(tmp_path / "w.xlsx"))
    got = rows.orderBy("_row").collect()
    assert [r["cells"] for r in got] == [["Timestamp", None, "Load (ton)"], ["2024-01-01T12:00:00", "TRUE", "7.5", None]]
    cells = {(r["name"], r["cell"]) for r in readers.with_header(rows).collect()}
    assert {("Timestamp", "2024-01-01T12:00:00"), ("col2", "TRUE"), ("Load (ton)", "7.5"), ("col4", None)} == cells


def test_recognisers_pair_words_of_one_language():
    from millrace.operators.references import recognise

    assert recognise(["Caso", "Inicio"], 5).kind == "incidents"
    assert recognise(["Case", "Start"], 5).kind == "incidents"
    assert recognise(["Caso", "Start of day"], 5) is None
    assert recognise(["Case", "Inicio"], 5) is None


def test_latest_of_events_at_one_time(spark):
    from millrace.operators import risk

    rows = [(1, 5, 1, "breach"), (1, 5, 2, "recovered"), (2, 5, 1, "recovered"), (2, 5, 2, "breach")]
    events = spark.createDataFrame(rows, "unit long, at long, event_id long, kind string")
    assert [r["unit"] for r in risk.live_state(events, ["unit"], ["at", "event_id"]).collect()] == [2]
    newest = risk.newest(events, ["unit"], ["at", "event_id"], 1).collect()
    assert {(r["unit"], r["kind"]) for r in newest} == {(1, "recovered"), (2, "breach")}


def test_settings_are_checked():
    import pytest

    from millrace.operators import surface

    assert surface.checked_setting("prox_urgent", "0.2")["prox_urgent"] == 0.2
    for key, value in (("nothing", "1"), ("prox_urgent", "2"), ("cooldown_ms", "-1"), ("cooldown_ms", "x")):
        with pytest.raises(ValueError):
            surface.checked_setting(key, value)


def test_responses_by_surface(spark):
    from pyspark.sql import functions as F

    from millrace.operators import surface

    df = spark.createDataFrame([("alarm",), ("note",)], "kind string")
    got = {r["kind"]: r["r"] for r in df.withColumn("r", surface.new_response("risk", F.col("kind"))).collect()}
    assert got["alarm"]["channels"] == [] and got["note"] is None
