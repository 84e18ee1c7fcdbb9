"""Deterministic series from a profile: any instant, any order, the same value.

A unit walks through the states of its cycle; each state has a mean length and a
level learnt from runs, each unit a level against the fleet. Noise is a hash of
(seed, unit, instant), so nothing is stored and nothing depends on what was
generated before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import half_up


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts' text."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def build_plan(df: DataFrame, unit: str, state: str, measure: str, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, units): each state's place, length and level; each unit's level.

    Both are aggregates: one row a state, one row a unit.
    """
    length = runs.groupBy(F.col("state")).agg(half_up(F.avg(F.col("end") - F.col("start")) + 60).alias("dwell"))
    level = df.groupBy(F.col(state).alias("state")).agg(half_up(F.avg(measure)).alias("level"), half_up(F.min(measure)).alias("lo"), half_up(F.max(measure)).alias("hi"))
    place = Window.orderBy("state")
    states = length.join(level, "state").withColumn("until", F.sum("dwell").over(place)).withColumn("since", F.col("until") - F.col("dwell")).withColumn("cycle", F.sum("dwell").over(Window.partitionBy(F.lit(0))))
    fleet = df.agg(F.avg(measure).alias("fleet"))
    units = df.groupBy(F.col(unit).alias("unit")).agg(F.avg(measure).alias("m")).crossJoin(F.broadcast(fleet)).select("unit", half_up(F.greatest(F.lit(0.4), F.least(F.lit(2.5), F.col("m") / F.col("fleet"))), 6).alias("factor"))
    return states, units


def generate(states: DataFrame, units: DataFrame, start: int, end: int, step: int, seed: str, noise: float = 0.1) -> DataFrame:
    """Values of every unit at start, start + step, ... (seconds, end included)."""
    grid = units.withColumn("at", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step)))).withColumn("offset", uniform(seed, "offset", F.col("unit")))
    inside = F.col("at") + F.floor(F.col("offset") * F.col("cycle"))
    placed = grid.join(states, (F.pmod(inside.cast("double"), F.col("cycle")) >= F.col("since")) & (F.pmod(inside.cast("double"), F.col("cycle")) < F.col("until")))
    jitter = 1 + noise * (2 * uniform(seed, F.col("unit"), F.col("at")) - 1)
    value = F.greatest("lo", F.least("hi", F.col("level") * F.col("factor") * jitter))
    return placed.select("unit", F.col("at").cast("long").alias("at"), "state", half_up(value).alias("value"))


def auto_step(start: int, end: int, grain: int, points: int = 4000) -> int:
    """A multiple of the grain that gives about `points` steps."""
    return max(1, round((end - start) / points / grain)) * grain


def schedule_factors(df: DataFrame, window: Column, measure: str) -> DataFrame:
    """How a clock window moves the level: its mean against all, held to 0.5 to 2."""
    means = df.groupBy(window.alias("window")).agg(F.count(measure).alias("n"), F.sum(measure).alias("s"))
    every = Window.partitionBy(F.lit(0))
    factor = (F.col("s") / F.col("n")) / (F.sum("s").over(every) / F.sum("n").over(every))
    return means.select("window", "n", half_up(F.greatest(F.lit(0.5), F.least(F.lit(2.0), factor)), 6).alias("factor"))


def incident_factors(series: DataFrame, incidents: DataFrame) -> DataFrame:
    """Multiplies values (unit, at, value) by the incidents (unit or null for all,
    start, end, magnitude, shape) that are open: a step adds its magnitude at once,
    a ramp grows to twice of it on average.

    Incidents come from a reference table of a few hundred rows at most.
    """
    open_now = (incidents["unit"].isNull() | (incidents["unit"] == series["unit"])) & (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end"))
    progress = (F.col("at") - F.col("start")) / F.greatest(F.col("end") - F.col("start"), F.lit(1))
    factor = 1 + F.col("magnitude") * F.when(F.col("shape") == "ramp", 2 * progress).otherwise(1.0)
    hit = series.join(F.broadcast(incidents), open_now, "left").select(series["unit"].alias("unit"), "at", "value", F.coalesce(factor, F.lit(1.0)).alias("factor"))
    return hit.groupBy("unit", "at", "value").agg(F.product("factor").alias("factor")).select("unit", "at", half_up(F.col("value") * F.col("factor")).alias("value"), half_up("factor", 6).alias("factor"))
