from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.functions.rounding import half_up


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_times(spark):
    at = lambda t: str(one(spark, coerce.parse_time(F.col("t")), t=t))
    assert at("2024-03-05") == "2024-03-05 00:00:00"
    assert at("2024-03-05T10:20:30.5+02:00") == "2024-03-05 10:20:30"
    assert at("5/3/2024 10:20") == "2024-03-05 10:20:00"
    assert at("2024-13-05") == "None"
    assert at("yesterday") == "None"


def test_persistence(spark):
    parse = lambda t: tuple(one(spark, coerce.parse_persistence(F.col("t")), t=t))
    assert parse(">120 s") == (120, ">120 s")
    assert parse("45") == (45, None)
    assert parse("2 min") == (120, None)
    assert parse("1.5 h") == (5400, None)
    assert parse("Por ciclo") == (None, "Por ciclo")


def test_units_roles_and_names(spark):
    assert one(spark, coerce.unit_key(F.col("u")), u="Deg F") == "f"
    assert one(spark, coerce.units_agree(F.col("a"), F.col("b")), a="tons", b="t")
    assert one(spark, coerce.units_agree(F.col("a"), F.col("b")), a="", b="mph")
    assert not one(spark, coerce.units_agree(F.col("a"), F.col("b")), a="psi", b="mph")
    assert one(spark, coerce.rate_seconds(F.col("u")), u="gal/h") == 3600
    assert one(spark, coerce.rate_seconds(F.col("u")), u="gal") is None
    assert one(spark, coerce.declared_role(F.col("h")), h="Val: speed") == "val"
    assert one(spark, coerce.declared_role(F.col("h")), h="speed") is None
    assert one(spark, coerce.words_only(F.col("t")), t=" Posición (X)-1 ") == "posicion x 1"
    assert one(spark, coerce.fill_template(F.col("t"), {"a": F.lit(3)}), t="{{a}} of {{b}}") == "3 of {{b}}"


def test_half_up(spark):
    got = spark.createDataFrame([(-0.0005,), (0.0005,), (float("nan"),), (None,)], "x double").select(half_up("x").alias("y")).collect()
    assert [r["y"] for r in got] == [0.0, 0.001, None, None]
