from pyspark.sql import functions as F

from millrace.operators import config
from millrace.plans import texts


def test_magnitude(spark):
    rows = [(1234.0, None, "count", "1,234"), (1.5, "ton", "count", "1.50 ton"), (0.123, None, "percentage", "12.3 %"), (None, "x", "count", "—"), (2.0, "gal", "count", "2.00 gal")]
    df = spark.createDataFrame(rows, "v double, u string, k string, want string")
    assert [r["got"] for r in df.select(texts.magnitude(F.col("v"), F.col("u"), F.col("k")).alias("got")).collect()] == [r[3] for r in rows]


def test_member_label(spark):
    df = spark.createDataFrame([("2024-05-01 - Unit 7",), ("Unit 7",)], "n string")
    assert {r[0] for r in df.select(texts.member_label(F.col("n"))).collect()} == {"Unit 7"}


def test_template_reads_back(spark):
    results = spark.createDataFrame([("Fuel, total", "gal")], "name string, unit string")
    candidates = spark.createDataFrame([("shift", "fuel", 0.5), ("unit", "fuel", 0.7)], "category string, measure string, cv double")
    rows = texts.config_template(spark, results, candidates, each=1).toPandas()
    again = config.parse_config(rows.to_csv(index=False), "t.csv")
    assert [(r["kind"], r["kbr"], r["name"], r["dimension"]) for r in again] == [("channel", None, "Operations", None), ("kbr", None, "Fuel, total", None), ("answer", "Fuel, total", "fuel by unit", "unit")]
