"""The fleet queries generate every user of events."""

import os

import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["fleet_series", "fleet_kpi", "fleet_incidents"])
def test_every_unit_is_generated(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    units = {r["user_id"] for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
    assert any(u % 10 for u in units)
    assert {r["unit"] for r in catalogue.QUERIES[name](spark, SF).select("unit").distinct().collect()} == units
