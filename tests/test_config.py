import pytest
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.operators import config, references, roles
from millrace.plans import profile

CONFIG = """kind,kbr,name,unit,format,direction,target,notes,dimension,measure,denominator,aggregation,rank,op,value,response,channels
# a comment
channel,,Ops Team,,,,,,,,,,,,,ops@example.com,email
kbr,,Fuel per Ton,gal/ton,count,down,"1,5",x,,,,,,,,,
answer,Fuel per Ton,By shift,,,,,,shift,fuel rate,,mean,min,,,,
answer,Fuel per Ton,By nothing,,,,,,galaxy,fuel rate,,mean,,,,,
condition,Fuel per Ton,Too much,,,,,,,,,,,gt,"1,200",call,Ops Team; Nobody
other,,x,,,,,,,,,,,,,,
"""


def test_config_tables(spark):
    t = config.tables(config.config_frame(spark, CONFIG, "a.csv"))
    assert {k: v.count() for k, v in t.items()} == {"channel": 1, "kbr": 1, "answer": 2, "risk": 0, "condition": 1, "anomrule": 0}
    assert t["kbr"].first()["target"] == 1.5
    kept, dangling = config.resolve_channels(t["condition"], t["channel"])
    row = kept.first()
    assert (row["op"], row["threshold"], row["channels"]) == ("gt", 1200.0, ["Ops Team"])
    assert [r["label"] for r in dangling.collect()] == ["Nobody"]
    js = config.parse_config('{"kbrs": [{"name": "A", "target": 3}], "channels": [{"name": "B"}]}', "a.json")
    assert [(r["kind"], r["name"], r["target"]) for r in js] == [("kbr", "A", "3"), ("channel", "B", None)]


def test_binding(spark):
    columns = spark.createDataFrame([("Shift ID",), ("Fuel Consumption Rate",), ("Pit Position",), ("Rate of Fuel Use",)], "column string").coalesce(1)
    spoken = spark.createDataFrame([("shift id",), ("shift",), ("pit-position",), ("consumption",), ("fuel rate",), ("galaxy",)], "name string")
    got = {r["name"]: (r["column"], r["tier"]) for r in config.bind_names(spoken, columns).collect()}
    assert got == {"shift id": ("Shift ID", 1), "shift": ("Shift ID", 2), "pit-position": ("Pit Position", 3), "consumption": ("Fuel Consumption Rate", 4), "fuel rate": ("Fuel Consumption Rate", 5), "galaxy": (None, None)}
    answers = config.tables(config.config_frame(spark, CONFIG, "a.csv"))["answer"]
    assert [(q.dimension, q.measure, q.rank) for q in config.questions(answers, {"shift": "Shift ID", "fuel rate": "Fuel Consumption Rate"})] == [("Shift ID", "Fuel Consumption Rate", "min")]


@pytest.mark.parametrize("live, want", [(["Tons moved", "FUEL-PER-TON"], ["FUEL-PER-TON", None]), (["x", "y"], ["x", "y"]), (["x"], [None, None])])
def test_match_results(spark, live, want):
    declared = spark.createDataFrame([(0, "Fuel per Ton"), (1, "Other")], "ordinal long, name string")
    found = config.match_results(declared, spark.createDataFrame(list(enumerate(live)), "ordinal long, name string"))
    assert [r["live"] for r in found.orderBy("ordinal").collect()] == want


def test_formats(spark):
    rows = [("Fuel cost", None, "currency"), ("Idle hours", "h", "time"), ("Variación", None, "percentage"), ("Load", "%", "percentage"), ("Trips", None, "count")]
    df = spark.createDataFrame(rows, "n string, u string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", config.suggest_format(F.col("n"), F.col("u"))).collect())


def test_references(spark):
    header = ["Parámetro", "Unidad", "Correcto", "Fuera", "Crítico", "Persistencia"]
    rec = references.recognise(header, 3)
    assert rec.kind == "thresholds" and references.recognise(header, 501) is None
    rows = [("Speed", "mph", "4-12", ">12-18", ">18", ">120 s"), ("Temp", "F", "<200", "200-220", ">220", "2 min"), ("Oil", None, ">30", ">20", "<20", None)]
    got = references.reference_rows(spark.createDataFrame(rows, header), rec).orderBy("param").collect()
    t = {r["param"]: r["thresholds"].asDict() for r in got}
    assert (t["Speed"]["dir"], t["Speed"]["glo"], t["Speed"]["ghi"], t["Speed"]["ylo"], t["Speed"]["yhi"]) == ("within", 4, 12, 4, 18)
    assert (t["Temp"]["dir"], t["Temp"]["g"], t["Temp"]["y"], t["Temp"]["r"]) == ("lte", 200, 220, 220)
    assert (t["Oil"]["dir"], t["Oil"]["g"], t["Oil"]["y"], t["Oil"]["r"]) == ("gte", 30, 20, 20)
    assert {r["param"]: r["persist_sec"] for r in got} == {"Speed": 120, "Temp": 120, "Oil": None}
    header = ["Camión", "Caso", "Inicio", "Fin", "Zona"]
    rec = references.recognise(header, 3)
    rows = [("T1", "a", "2024-01-01 10:00:00", None, None), ("T1", "b", None, None, "Rampa Norte; toda la mina"), (None, "c", None, None, "Toda")]
    incidents = references.reference_rows(spark.createDataFrame(rows, "`Camión` string, Caso string, Inicio string, Fin string, Zona string"), rec)
    assert {r["label"]: (r["quarantine"], r["zone_terms"]) for r in incidents.collect()} == {"a": ("window", []), "b": ("zone", ["rampa norte"]), "c": ("none", [])}
    df = spark.createDataFrame([("RAMPA NORTE 3",), ("sur",)], "place string")
    assert [r["quarantined"] for r in references.in_zone([F.col("place")], incidents, df).collect()] == [True, False]


def test_match_thresholds():
    measures = [("Engine Speed", "rpm"), ("Ground Speed", "mph"), ("Oil Pressure", None)]
    assert references.match_thresholds([("ground-speed", "mph"), ("Speed", "rpm"), ("pressure", "psi"), ("nothing", None)], measures) == {"ground-speed": "Ground Speed", "Speed": "Engine Speed", "pressure": "Oil Pressure"}


def test_roles_and_plan(spark):
    names = ["Timestamp", "Unit ID", "Road Condition", "val: Load (ton)", "Note"]
    rows = [("s", i, c, names[c], v) for i in range(20) for c, v in enumerate((f"2024-01-01 00:00:{i:02d}", "T1", "dry", f"1,{i:03d}.5", None))]
    cells = spark.createDataFrame(rows, "sheet string, _row long, column int, name string, cell string")
    found = roles.column_roles(cells)
    got = {r["name"]: (r["type"], r["role"], r["unit"]) for r in found.collect()}
    assert got == {"Timestamp": ("datetime", "time", None), "Unit ID": ("category", "who", None), "Road Condition": ("category", "ctx", None), "val: Load (ton)": ("number", "val", "ton"), "Note": ("empty", "ctx", None)}
    plan = roles.plan_of(found, "s")
    assert (plan.time, plan.measures, plan.categories) == ("Timestamp", ["val: Load (ton)"], ["Unit ID", "Road Condition"])
    table = roles.typed_table(cells, found, "s")
    assert dict(table.dtypes)["val: Load (ton)"] == "double" and table.where("_row = 3").first()["val: Load (ton)"] == 1003.5


def test_profile_is_replaced_by_dataset(spark, tmp_path):
    rows = [(u, i, f"2024-01-01 0{i % 10}:00:00", "ab"[i % 2], float(i)) for u in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "u long, i long, t string, s string, v double").withColumn("t", coerce.parse_time(F.col("t")))
    facets = profile.profile(df, "u", "t", ["i"], "s", ["s"], ["v"])
    for dataset in ("one", "two", "one"):
        profile.store_profile(facets, dataset, str(tmp_path))
    assert profile.load_profile(spark, "one", str(tmp_path), "measures").count() == 1
    assert spark.read.parquet(f"{tmp_path}/measures").count() == 2
    with pytest.raises(ValueError):
        profile.check_dataset_id("../x")
