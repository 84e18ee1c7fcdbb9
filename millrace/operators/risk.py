"""Risk conditions: firing, edge-triggered events, severity, proximity, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import half_up

#: Ticks that make a breach sustained, and the excess that makes it critical.
SUSTAINED_TICKS = 20
CRITICAL_EXCESS = 0.2
URGENT, WARNING = 0.1, 0.2
#: Milliseconds of one tick at each speed, and ticks of a cooldown.
SPEED_MS = (4000, 2500, 1500, 800, 280)
COOLDOWN_TICKS = 15


def cooldown_ms(speed: int | None = None) -> int:
    return SPEED_MS[min(max((3 if speed is None else speed) - 1, 0), len(SPEED_MS) - 1)] * COOLDOWN_TICKS


def fires(op: Column | str, value: Column, threshold: Column) -> Column:
    """gt, gte, lte or lt (the default); null if value or threshold is missing."""
    op = F.lit(op) if isinstance(op, str) else op
    return F.when(op == "gt", value > threshold).when(op == "gte", value >= threshold).when(op == "lte", value <= threshold).otherwise(value < threshold)


def edge_events(ticks: DataFrame, key: list[str], at: str, order: list[str], fired: str = "fires", cooldown: int = 0, enabled: str | None = None) -> DataFrame:
    """Events where a condition starts or stops to fire: breach, recovered and silenced.

    `at` is in milliseconds. A tick on which the condition is not armed (null) keeps the
    state; one on which it is not `enabled` silences it if it fires. `held_ms` is how long
    a breach lasted that is over; a breach within `cooldown` of the one before is marked
    suppressed, and still listed.
    """
    ordered = Window.partitionBy(*key).orderBy(*order)
    on = F.lit(True) if enabled is None else F.coalesce(F.col(enabled), F.lit(False))
    armed = ticks.withColumn("_on", on).withColumn("_fires", F.when(F.col("_on"), F.col(fired)).otherwise(False)).where("_fires IS NOT NULL")
    before = F.coalesce(F.lag("_fires").over(ordered), F.lit(False))
    edges = armed.withColumn("_before", before).where("_fires <> _before")
    kind = F.when(F.col("_fires"), "breach").when(F.col("_on"), "recovered").otherwise("silenced")
    named = edges.select(*key, *[c for c in order if c not in key and c != at], at, kind.alias("kind"))
    held = F.when(F.col("kind") != "breach", F.col(at) - F.lag(at).over(ordered))
    events = named.withColumn("held_ms", held)
    last = F.lag(at).over(Window.partitionBy(*key, "kind").orderBy(*order))
    return events.withColumn("suppressed", (F.col("kind") == "breach") & F.coalesce(F.col(at) - last < cooldown, F.lit(False)))


def newest(events: DataFrame, key: list[str], order: list[str], n: int = 200) -> DataFrame:
    """The `n` newest events of each key; `order` is theirs, time first."""
    last = Window.partitionBy(*key).orderBy(*map(F.desc, order))
    return events.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= n).drop("_rank")


def live_state(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keys whose latest event is a breach. Of events at one time the last in `order`
    counts, whatever its kind."""
    latest = events.groupBy(*key).agg(F.max_by("kind", F.struct(*order)).alias("kind"), F.max(order[0]).alias("since"))
    return latest.where("kind = 'breach'").drop("kind")


def flapping(events: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Times fired, longest breach, and whether that is often enough to be flapping."""
    fired = F.count_if(F.col("kind") == "breach")
    return events.groupBy(*key).agg(fired.alias("times_fired"), F.coalesce(F.max("held_ms"), F.lit(0)).alias("longest_ms"), (fired >= least).alias("flapping"))


def severity(value: Column, threshold: Column, ticks: Column, upper: bool = True) -> Column:
    """critical if sustained, or if the excess is a fifth of the threshold."""
    excess = F.when(threshold > 0, (value - threshold if upper else threshold - value) / threshold).otherwise(0.0)
    return F.when((ticks > SUSTAINED_TICKS) | (excess >= CRITICAL_EXCESS), "critical").otherwise("warning")


def proximity(value: Column, upper: Column | None = None, lower: Column | None = None) -> Column:
    """struct(state, proximity): breach, or how near the nearest threshold is."""
    breach, near = F.lit(False), F.lit(1.0)
    if upper is not None:
        breach = breach | F.coalesce(value > upper, F.lit(False))
        near = F.least(near, F.when(upper > 0, (upper - value) / upper))
    if lower is not None:
        breach = breach | F.coalesce(value < lower, F.lit(False))
        near = F.least(near, F.when(lower > 0, (value - lower) / lower))
    state = F.when(value.isNull(), None).when(breach, "breach").when(near <= URGENT, "urgent").when(near <= WARNING, "warning").otherwise("clear")
    return F.struct(state.alias("state"), F.when(value.isNotNull(), F.when(breach, 0.0).otherwise(near)).alias("proximity"))


def consecutive(df: DataFrame, key: list[str], order: list[str], flag: str) -> DataFrame:
    """Adds ticks: how many rows in a row, up to this one, have the flag."""
    ordered = Window.partitionBy(*key).orderBy(*order)
    island = df.withColumn("_island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(ordered))
    inside = Window.partitionBy(*key, "_island").orderBy(*order)
    return island.withColumn("ticks", F.sum(F.when(F.col(flag), 1).otherwise(0)).over(inside)).drop("_island")


def peer_deviation(df: DataFrame, member: str, measure: str, limit: float, direction: str = "up") -> DataFrame:
    """Each member's mean against the median member, and whether it is out by `limit`."""
    means = df.groupBy(member).agg(F.avg(measure).alias("m"))
    middle = means.agg(F.median("m").alias("peer_median"))
    pct = (F.col("m") - F.col("peer_median")) / F.nullif(F.col("peer_median"), F.lit(0.0))
    signed = pct if direction == "up" else -pct
    return means.crossJoin(F.broadcast(middle)).select(member, half_up("m").alias("mean"), half_up("peer_median").alias("peer_median"), half_up(pct, 6).alias("deviation"), (signed >= limit).alias("breached"))


def in_context_window(windows: list[dict], hour: Column, values: dict[str, Column]) -> Column:
    """Name of the first window that holds: hours [start, end), numeric bands with
    both ends, or a list of values without regard to case; null if none does."""
    found = F.lit(None).cast("string")
    for w in reversed(windows):
        if w["dim"] == "hour":
            inside = (hour >= w["start"]) & (hour < w["end"])
        elif "values" in w:
            inside = F.lower(values[w["dim"]]).isin([v.lower() for v in w["values"]])
        else:
            inside = values[w["dim"]].between(w["lo"], w["hi"])
        found = F.when(inside, F.lit(w["name"])).otherwise(found)
    return found


def surface(items: DataFrame, tolerance: int) -> DataFrame:
    """What is shown: nothing suppressed, and only critical at a high tolerance."""
    return items.where(~F.col("suppressed") & (F.lit(tolerance < 67) | (F.col("severity") == "critical")))
