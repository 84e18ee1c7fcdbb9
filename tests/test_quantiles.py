import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles as m


@pytest.mark.parametrize("bins,direct", [(64, 4), (1024, 100_000)])
def test_against_numpy(spark, bins, direct):
    draw = random.Random(bins)
    groups = {"ties": [float(draw.randrange(4)) for _ in range(300)], "normal": [draw.gauss(0, 1) for _ in range(257)], "one": [3.5], "same": [2.0] * 50, "wide": [10.0 ** draw.randrange(-300, 300) * draw.choice([-1, 1]) for _ in range(120)], "huge": [-1.7e308, 1.7e308, 0.0, 5.0, 6.0], "endless": [float("-inf"), 1.0, 2.0, 3.0, float("inf")]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("nothing", None)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.05, 0.25, 0.5, 0.95]
    got = {r["k"]: r["q"] for r in m.quantiles(df, ["k"], at, bins, direct).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        want = [np.quantile(np.array(vs), p) if k not in ("huge", "endless") else None for p in at]
        assert k in ("huge", "endless") or got[k] == pytest.approx(want, rel=1e-12, abs=1e-300)
    assert got["huge"][2] == 5.0 and got["endless"][2] == 2.0


def test_medians_both_ways(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), (F.hash("id") % 1000 / 7.0).alias("v"))
    small, large = ({r["k"]: r["median"] for r in m.medians(df, ["k"], most=n).collect()} for n in (10**6, 10))
    want = {k: statistics.median(r["v"] for r in df.where(F.col("k") == k).collect()) for k in range(3)}
    assert small == pytest.approx(want) and large == pytest.approx(want)


def test_nothing(spark):
    assert m.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], [0.5]).count() == 0


def test_no_aggregate_keeps_values(spark):
    """What a pass groups by is a bin: bins times ranges rows, however many values."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.rand(1).alias("v"))
    got = m.order_statistics(df, ["k"], [("a", 100_000, 0.0, 1.0, 0, 200_000)], bins=64, direct=100)["a", 100_000]
    assert got == sorted(r["v"] for r in df.collect())[100_000]


def test_groups_in_turns(spark, monkeypatch):
    monkeypatch.setattr(m, "GROUPS", 4)
    df = spark.range(300).select((F.col("id") % 11).alias("k"), F.col("id").cast("double").alias("v"))
    got = {r["k"]: r["q"][0] for r in m.quantiles(df, ["k"], [0.5]).collect()}
    assert got == {k: statistics.median(range(k, 300, 11)) for k in range(11)}
