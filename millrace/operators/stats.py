"""Column summaries: numbers, frequent values, fill and type, grain."""

from __future__ import annotations

from math import isnan

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.coerce import cell_kind
from millrace.functions.rounding import epoch_seconds, half_up
from millrace.operators.quantiles import quantiles

QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def unpivot_measures(df: DataFrame, measures: list[str], keep: list[str] = []) -> DataFrame:
    """Rows (keep..., measure, v); nulls are left out."""
    typed = df.select(*keep, *(F.col(m).cast("double").alias(m) for m in measures))
    return typed.unpivot(keep, measures, "measure", "v").where("v IS NOT NULL")


def numeric_summary(df: DataFrame, measures: list[str], exact: bool = True) -> DataFrame:
    """One row a measure: count, sum, mean, sample deviation, range, quantiles, cv.

    Exact quantiles are interpolated and found in a few passes of fixed memory
    (quantiles.py); `exact=False` takes them from a sketch, in the one pass that gives
    all the rest.
    """
    long = unpivot_measures(df, measures)
    at = list(QUANTILES.values())
    sketch = [] if exact else [F.percentile_approx("v", F.array(*map(F.lit, at)), 10_000).alias("q")]
    summed = long.groupBy("measure").agg(F.count("*").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"), *sketch)
    if exact:  # A row a measure: what the first pass found also begins the search.
        rows = summed.collect()
        sizes = None if any(isnan(r["hi"]) for r in rows) else [(r["measure"], r["n"], r["lo"], r["hi"]) for r in rows]
        summed = df.sparkSession.createDataFrame(rows, summed.schema).coalesce(1).join(F.broadcast(quantiles(long, ["measure"], at, sizes=sizes)), "measure", "left")
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean"))
    return summed.select("measure", "n", *(half_up(c).alias(c) for c in ("sum", "mean", "sd", "lo", "hi")), *(half_up(F.col("q")[i]).alias(p) for i, p in enumerate(QUANTILES)), half_up(cv).alias("cv"))


def top_values(df: DataFrame, columns: list[str], k: int = 12) -> DataFrame:
    """The `k` most frequent values of each column, with its distinct count."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value").where("value IS NOT NULL")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(by_count)).withColumn("distinct_values", F.count("*").over(Window.partitionBy("column"))).where(F.col("rank") <= k)


def fill_and_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells, fill ratio and the type that over 80 % of live cells have."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "cell")
    kind = long.withColumn("kind", cell_kind(F.col("cell")))
    counts = kind.groupBy("column").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(a) for k, a in (("blank", "missing"), ("number", "numbers"), ("time", "times"))))
    live = F.col("n") - F.col("missing")
    inferred = F.when(live == 0, "empty").when(F.col("times") > 0.8 * live, "datetime").when(F.col("numbers") > 0.8 * live, "number").otherwise("category")
    return counts.select("column", "n", "missing", "numbers", "times", half_up(live / F.col("n")).alias("fill"), inferred.alias("type"))


def grain(df: DataFrame, unit: str, ts: str, order: list[str], most: int = 31 * 86400) -> DataFrame:
    """The modal positive step of each unit's rows in seconds, its share, and gaps."""
    rows = Window.partitionBy(unit).orderBy(*order)
    steps = df.select(unit, (epoch_seconds(ts) - F.lag(epoch_seconds(ts)).over(rows)).alias("step")).where((F.col("step") > 0) & (F.col("step") < most))
    counted = steps.groupBy(unit, "step").agg(F.count("*").alias("n"))
    return counted.groupBy(unit).agg(F.max_by("step", F.struct("n", -F.col("step"))).alias("grain_sec"), half_up(F.max("n") / F.sum("n")).alias("regularity"), (F.sum("n") - F.max("n")).alias("gaps"))
