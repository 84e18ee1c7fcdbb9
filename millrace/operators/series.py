"""Cycles of a generated series: jittered states, completed cycles, smooth noise.

A cycle keeps its length; how it is divided among its states varies from cycle to
cycle, by hashes of seed, unit, cycle and state. So any cycle can be looked up by its
number, and nothing is walked from the beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import half_up
from millrace.operators.generator import uniform


def normal(*parts: Column | str) -> Column:
    """About standard normal, within three: the sum of three hashed uniforms."""
    total = sum((uniform(*parts, str(i)) for i in (1, 2)), uniform(*parts, "0"))
    return 2.0 * (total - 1.5)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def cycle_numbers(states: DataFrame, units: DataFrame, start: int, end: int, seed: str) -> DataFrame:
    """(unit, offset, cycle, k): the cycles of each unit that touch [start, end].

    `states` has one row a state, each with the length of the whole cycle.
    """
    length = states.agg(F.max("cycle").alias("cycle"))
    placed = units.crossJoin(F.broadcast(length)).withColumn("offset", uniform(seed, "offset", F.col("unit")) * F.col("cycle"))
    number = lambda at: F.floor((F.lit(float(at)) + F.col("offset")) / F.col("cycle"))
    return placed.withColumn("k", F.explode(F.sequence(number(start), number(end))))


def jittered_states(states: DataFrame, cycles: DataFrame, seed: str) -> DataFrame:
    """(unit, k, state, since, until): where each state of a cycle lies, in seconds.

    A state's length varies by its `cv`, by two deviations at most and never below
    0.15 of the mean; then all are stretched to the cycle's length. States are few.
    """
    varied = 1 + clamp(normal(seed, F.col("unit"), F.col("k"), F.col("state")), -2.0, 2.0) * F.col("cv")
    drawn = cycles.join(F.broadcast(states.drop("cycle"))).withColumn("d", F.greatest(0.15 * F.col("dwell"), F.col("dwell") * varied))
    inside = Window.partitionBy("unit", "k")
    upto = inside.orderBy("state")
    scale = F.col("cycle") / F.sum("d").over(inside)
    begin = F.col("k") * F.col("cycle") - F.col("offset")
    placed = drawn.withColumn("_until", begin + F.sum("d").over(upto) * scale).withColumn("_since", F.col("_until") - F.col("d") * scale)
    return placed.select("unit", "k", "state", F.col("_since").alias("since"), F.col("_until").alias("until"))


def completed_cycles(placed: DataFrame, terminal: str, quantities: DataFrame, start: int, end: int, seed: str) -> DataFrame:
    """(unit, k, at, quantity): cycles whose terminal state ends within [start, end].

    A cycle counts once, where it discharges; one that is still under way does not.
    Its quantity varies about the unit's (unit, mean, sd) and is not below zero.
    """
    done = placed.where((F.col("state") == terminal) & F.col("until").between(float(start), float(end)))
    carried = done.join(quantities, "unit")
    drawn = F.greatest(F.lit(0.0), F.col("mean") + clamp(normal(seed, "quantity", F.col("unit"), F.col("k")), -2.5, 2.5) * F.col("sd"))
    return carried.select("unit", "k", half_up("until").alias("at"), half_up(drawn).alias("quantity"))


def ratio_kpi(series: DataFrame, completed: DataFrame, step: float, unit_sec: float) -> DataFrame:
    """By unit: the integrated rate over the quantity of completed cycles. Both are of
    the same units; without a quantity there is no ratio."""
    rate = series.groupBy("unit").agg((F.sum("value") * step / unit_sec).alias("integrated"))
    moved = completed.groupBy("unit").agg(F.count("*").alias("cycles"), F.sum("quantity").alias("quantity"))
    joined = rate.join(moved, "unit", "left")
    return joined.select("unit", half_up(half_up("integrated", 6)).alias("integrated"), F.coalesce("cycles", F.lit(0)).cast("long").alias("cycles"), half_up(F.coalesce("quantity", F.lit(0.0))).alias("quantity"), half_up(F.col("integrated") / F.nullif(F.col("quantity"), F.lit(0.0)), 6).alias("per_quantity"))


def smooth_noise(at: Column, step: int, *parts: Column | str) -> Column:
    """Noise without jumps: a draw at each step, and a smooth way from one to the next."""
    i = F.floor(at / step)
    t = at / step - i
    before, after = normal(*parts, i), normal(*parts, i + 1)
    return before + (after - before) * t * t * (3 - 2 * t)


def scheduled_values(df: DataFrame, ts: str, value: Column) -> DataFrame:
    """(hour, value): what a dimension that goes by the clock mostly is at each hour."""
    counted = df.groupBy(F.hour(ts).cast("long").alias("hour"), value.alias("value")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("hour").orderBy(F.desc("n"), "value")
    return counted.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("hour", "value")


def apply_schedule(series: DataFrame, schedule: DataFrame, factors: DataFrame) -> DataFrame:
    """A series (unit, at, value) times the factor of the clock window it is in.

    A day has 24 hours, so both tables are small."""
    by_hour = schedule.join(factors.select(F.col("window").alias("value"), "factor"), "value").select("hour", F.col("value").alias("window"), "factor")
    hour = F.pmod(F.floor(F.col("at") / 3600), F.lit(24))
    joined = series.withColumn("hour", hour).join(F.broadcast(by_hour), "hour")
    return joined.select("unit", "at", "window", half_up(F.col("value") * F.col("factor")).alias("value"))


def overlapping(incidents: DataFrame, start: int, end: int) -> DataFrame:
    """Incidents of which some part lies in the range."""
    return incidents.where((F.col("end") >= start) & (F.col("start") <= end))


def _shares_word(text: Column, name: Column) -> Column:
    return F.exists(F.split(text, " "), lambda w: (F.length(w) > 3) & F.contains(name, w))


def vote_for_measure(variables: DataFrame, measures: list[tuple[str, bool]], norm) -> DataFrame:
    """The rate measure that most incident variables (variable) name: by the same words,
    else one name in the other, else a shared word of over three letters."""
    v = norm(F.col("variable"))
    candidates = []
    for place, (name, is_rate) in enumerate(measures):
        m = norm(F.lit(name))
        word = _shares_word(v, m)
        tier = F.when(v == m, 1).when((v != "") & (F.contains(m, v) | F.contains(v, m)), 2).when(word, 3)
        candidates.append(F.struct(tier.alias("tier"), F.lit(place).alias("place"), F.lit(name).alias("measure"), F.lit(is_rate).alias("rate")))
    best = F.array_min(F.filter(F.array(*candidates), lambda c: c["tier"].isNotNull()))
    votes = variables.select(best.alias("b")).where("b IS NOT NULL AND b.rate").groupBy("b.measure", "b.place").agg(F.count("*").alias("votes"))
    return votes.orderBy(F.desc("votes"), "place").limit(1).select("measure", "votes")


def standardised_factors(df: DataFrame, level: str, state: str, measure: str) -> DataFrame:
    """How a level moves a measure, on one weighting of the states that all levels have:
    its standardised mean over that of all, held to 0.5 to 2. Needs two such states."""
    cells = df.groupBy(F.col(level).alias("level"), F.col(state).alias("state")).agg(F.count(measure).alias("n"), F.avg(measure).alias("m"))
    levels = cells.agg(F.count_distinct("level").alias("levels"))
    common = cells.groupBy("state").agg(F.count("*").alias("have"), F.sum("n").alias("w")).crossJoin(F.broadcast(levels)).where("have = levels").select("state", "w")
    each = cells.join(common, "state").groupBy("level").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("std"), F.sum("n").alias("n"), F.count("*").alias("states"))
    every = Window.partitionBy(F.lit(0))
    overall = F.sum(F.col("std") * F.col("n")).over(every) / F.sum("n").over(every)
    return each.where("states >= 2").select("level", "n", half_up(clamp(F.col("std") / overall, 0.5, 2.0), 6).alias("factor"))
