"""Operators over ordered rows of a unit: runs, transitions, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import epoch_seconds, half_up


def runs(df: DataFrame, unit: str, state: str, ts: str, order: list[str], measure: str) -> DataFrame:
    """Contiguous runs of one state: unit, run, state, rows, start, end, sums.

    Blank states are skipped and do not end a run.
    """
    ordered = Window.partitionBy(unit).orderBy(*order)
    live = df.where(F.col(state).isNotNull() & (F.col(state) != ""))
    changed = live.withColumn("_new", F.coalesce((F.lag(state).over(ordered) != F.col(state)).cast("int"), F.lit(1)))
    numbered = changed.withColumn("run", F.sum("_new").over(ordered))
    return numbered.groupBy(unit, "run").agg(F.first(state).alias("state"), F.count("*").alias("rows"), F.min(epoch_seconds(ts)).alias("start"), F.max(epoch_seconds(ts)).alias("end"), F.sum(measure).alias("total"), F.max(measure).alias("peak"))


def durations(found: DataFrame, unit: str) -> DataFrame:
    """For each state: runs and their length up to where the next run begins."""
    following = Window.partitionBy(unit).orderBy("run")
    timed = found.withColumn("sec", (F.coalesce(F.lead("start").over(following), F.col("end")) - F.col("start")).cast("double"))
    return timed.groupBy("state").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"), half_up(F.sum("sec")).alias("total_sec"), half_up(F.avg("sec")).alias("mean_sec"), half_up(F.coalesce(F.stddev_samp("sec"), F.lit(0.0))).alias("sd_sec"), half_up(F.avg("peak")).alias("mean_peak"))


def transitions(found: DataFrame, unit: str) -> DataFrame:
    """How often one state follows another, over all units."""
    following = Window.partitionBy(unit).orderBy("run")
    pairs = found.select(F.col("state").alias("from_state"), F.lead("state").over(following).alias("to_state")).where("to_state IS NOT NULL")
    return pairs.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def cycle_shape(df: DataFrame, unit: str, measure: str, order: list[str]) -> DataFrame:
    """Shares of rows near zero and near the greatest value so far."""
    upto = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v, top = F.col(measure), F.col("_top")
    seen = df.where(v.isNotNull()).withColumn("_top", F.max(measure).over(upto))
    low, high = (top > 0) & (v <= top * 0.005), (top > 0) & (v > top * 0.005) & (v >= top * 0.9)
    return seen.groupBy(unit).agg(half_up(F.count_if(low) / F.count("*")).alias("zero_share"), half_up(F.count_if(high) / F.count("*")).alias("plateau_share"))


def running_top(df: DataFrame, unit: str, measure: str, order: list[str]) -> DataFrame:
    upto = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_top", F.max(measure).over(upto))
