"""Hour-of-day rhythm and clock schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import half_up


def hour_rhythm(df: DataFrame, ts: str, measure: str, least_hours: int = 4) -> DataFrame:
    """Mean of each hour of the day, its index against the mean of hours, and how
    far the hours spread; nothing with fewer than `least_hours` live hours."""
    hours = df.groupBy(F.hour(ts).cast("long").alias("hour")).agg(F.count("*").alias("n"), F.avg(measure).alias("m"))
    everything = Window.partitionBy(F.lit(0))
    level = F.avg("m").over(everything)
    spread = (F.max("m").over(everything) - F.min("m").over(everything)) / level
    return hours.withColumn("live", F.count("*").over(everything)).select("hour", "n", half_up("m").alias("mean"), half_up(F.col("m") / level).alias("hour_index"), half_up(spread).alias("amplitude"), "live").where(F.col("live") >= least_hours).drop("live")


def hour_winners(df: DataFrame, ts: str, value: Column) -> DataFrame:
    """For each hour the most frequent value and its share of the hour's rows."""
    counted = df.groupBy(F.hour(ts).cast("long").alias("hour"), value.cast("string").alias("value")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("hour").orderBy(F.desc("n"), "value")
    ranked = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("hour"))).withColumn("rank", F.row_number().over(best))
    return ranked.where("rank = 1").select("hour", "value", "share")


def clock_schedule(df: DataFrame, ts: str, values: dict[str, Column], share: float = 0.8) -> DataFrame:
    """Which of `values` follow the clock: the winner of every live hour has `share`."""
    found = None
    for name, value in values.items():
        distinct = df.agg(F.count_distinct(value).alias("distinct_values"))
        least = hour_winners(df, ts, value).agg(F.min("share").alias("m"), F.count("*").alias("hours"))
        row = least.crossJoin(distinct).select(F.lit(name).alias("category"), "hours", "distinct_values", half_up("m").alias("least_share"), ((F.col("m") >= share) & F.col("distinct_values").between(2, 60)).alias("scheduled"))
        found = row if found is None else found.unionByName(row)
    return found
