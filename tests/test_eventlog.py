"""The stream gives the events of the batch, in micro-batches of any size."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import risk
from millrace.streaming import eventlog

SCHEMA = "key string, at long, seq long, fires boolean, enabled boolean"


def some_ticks(n=400):
    draw = random.Random(3)
    return [(draw.choice("abc"), i // 3 * 10, i, draw.choice([True, False, None, True, False]), draw.random() > 0.15) for i in range(n)]


def streamed(spark, folder, files, **options):
    """Each list of ticks is a micro-batch of its own."""
    (folder / "in").mkdir(parents=True)
    events = None
    for k, ticks in enumerate(files):
        spark.createDataFrame(ticks, SCHEMA).repartition(2).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))
        events = eventlog.replay(eventlog.edge_stream(source, **options), str(folder), "t", 12 if "live_ms" in options else None)
    return sorted(((r["key"], r["at"], r["seq"], r["kind"], r["held_ms"], r["suppressed"]) for r in events.collect()), key=repr)


@pytest.mark.parametrize("size", [400, 130])
def test_micro_batches_of_any_size(spark, tmp_path, size):
    ticks = some_ticks()
    batch = risk.edge_events(spark.createDataFrame(ticks, SCHEMA), ["key"], "at", ["at", "seq"], cooldown=60, enabled="enabled")
    want = sorted(((r["key"], r["at"], r["seq"], r["kind"], r["held_ms"], r["suppressed"]) for r in batch.collect()), key=repr)
    assert {w[3] for w in want} == {"breach", "recovered", "silenced"}
    assert streamed(spark, tmp_path, [ticks[i : i + size] for i in range(0, 400, size)], cooldown=60) == want


def test_late_ticks_are_told_and_change_nothing(spark, tmp_path):
    files = [[("k", 10, 0, True, True), ("k", 30, 0, None, True)], [("k", 20, 0, False, True), ("k", 40, 0, False, True)]]
    assert streamed(spark, tmp_path, files) == [("k", 10, 0, "breach", None, False), ("k", 20, 0, "late", None, False), ("k", 40, 0, "recovered", 30, False)]


def test_a_key_has_a_time_to_live(spark, tmp_path):
    """The second breach begins anew: the state that fired is gone."""
    files = [[("k", 10, 0, True, True)], [("k", 20, 0, True, True)]]
    got = streamed(spark, tmp_path, files, live_ms=1)
    assert [g[3] for g in got] == ["breach", "breach"]


def test_silenced_by_hand(spark):
    rows = [("k", 0, True, False), ("k", 10, True, True), ("k", 20, None, False), ("k", 30, False, True), ("k", 40, True, True), ("k", 50, False, None)]
    df = spark.createDataFrame(rows, "key string, at long, fires boolean, enabled boolean")
    got = risk.edge_events(df, ["key"], "at", ["at"], enabled="enabled").orderBy("at").collect()
    assert [(r["at"], r["kind"], r["held_ms"]) for r in got] == [(10, "breach", None), (20, "silenced", 10), (40, "breach", None), (50, "silenced", 10)]
    assert got == risk.edge_events(df.select("*", F.lit(1).alias("_x")), ["key"], "at", ["at"], enabled="enabled").orderBy("at").collect()
