"""Declared questions: a dimension, a measure, how to combine and how to rank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.functions.rounding import half_up


@dataclass(frozen=True)
class Question:
    """`aggregation`: mean, sum, count, ratio (by `denominator`) or deviation of the mean."""

    dimension: str
    measure: str
    aggregation: str = "mean"
    denominator: str | None = None
    rank: str = "max"
    by_magnitude: bool = False
    top: int = 10


def members(df: DataFrame, q: Question) -> DataFrame:
    """One row a member: member, value, n. Members without a value are left out."""
    named = df.where(F.col(q.dimension).isNotNull()).groupBy(F.col(q.dimension).cast("string").alias("member"))
    n = F.count(q.measure).alias("n")
    if q.aggregation == "ratio":
        found = named.agg(F.sum(q.measure).alias("num"), F.sum(q.denominator).alias("den"), n).where("den <> 0")
        return found.select("member", (F.col("num") / F.col("den")).alias("value"), "n").where("value IS NOT NULL")
    combine = {"sum": F.sum, "count": F.count}.get(q.aggregation, F.avg)
    found = named.agg(combine(q.measure).cast("double").alias("value"), n).where("value IS NOT NULL")
    if q.aggregation == "deviation":
        middle = found.agg(F.median("value").alias("middle")).where("middle <> 0")
        found = found.crossJoin(F.broadcast(middle)).select("member", ((F.col("value") - F.col("middle")) / F.col("middle")).alias("value"), "n")
    return found


def answer(df: DataFrame, q: Question) -> DataFrame:
    """The ranking: position, member, value, n, and how far the next member is behind.

    Sorting is a top-k, so all members never meet in one task. Values that
    agree to six decimals tie, and ties go by name, so the order of summing never shows.
    """
    size = half_up(F.abs("value") if q.by_magnitude else F.col("value"), 6)
    key = F.asc("size") if q.rank == "min" else F.desc("size")
    top = members(df, q).withColumn("size", size).orderBy(key, "member").limit(q.top + 1)
    order = Window.orderBy(key, "member")
    ranked = top.withColumn("position", F.row_number().over(order)).withColumn("gap", F.col("value") - F.lead("value").over(order))
    return ranked.where(F.col("position") <= q.top).select("position", "member", half_up("value").alias("value"), "n", half_up("gap").alias("gap"))


def count_answer(df: DataFrame, q: Question) -> DataFrame:
    """The total over all members."""
    return members(df, q).agg(half_up(F.sum("value")).alias("total"), F.count("*").alias("members"))


def question_candidates(df: DataFrame, categories: list[str], measures: list[str]) -> DataFrame:
    """Pairs of category and measure by how much members differ (cv of their means);
    a category of one member gives none."""
    typed = df.select(*(F.col(c).cast("string").alias(c) for c in categories), *(F.col(m).cast("double").alias(m) for m in measures))
    long = typed.unpivot(measures, categories, "category", "member").where("member IS NOT NULL")
    each = long.unpivot(["category", "member"], measures, "measure", "v").groupBy("category", "measure", "member").agg(F.avg("v").alias("m")).where("m IS NOT NULL")
    spread = each.groupBy("category", "measure").agg(F.count("*").alias("members"), F.abs(F.stddev_samp("m") / F.avg("m")).alias("cv"), (F.max("m") - F.min("m")).alias("range")).where("members >= 2")
    return spread.select("category", "measure", "members", half_up("cv", 6).alias("cv"), half_up("range").alias("range"))


def families(df: DataFrame, label: Column, measures: list[str]) -> DataFrame:
    """Rows and sums by family of labels."""
    return df.groupBy(label.alias("family")).agg(F.count("*").alias("n"), *(half_up(F.sum(m)).alias(f"sum_{m}") for m in measures))


def shortlist(candidates: DataFrame, taken: DataFrame, n: int = 5) -> DataFrame:
    """The best candidates whose category and measure no one has taken yet."""
    return candidates.join(taken, ["category", "measure"], "left_anti").orderBy(F.desc("cv"), "category", "measure").limit(n)


def cells(sources: dict[str, DataFrame]) -> DataFrame:
    """Members of several sources (each member, value, n) under one schema."""
    named = [df.select(F.lit(name).alias("dim"), "member", half_up("value").alias("value"), "n") for name, df in sources.items()]
    return reduce(DataFrame.unionByName, named)


def dimensions(sources: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(id, kind, members) of what can be ranked over: a table, a column, and the kind
    of answer, which a context's column name tells where it is not given."""
    counted = []
    for name, (df, column, kind) in sources.items():
        told = F.lit(kind) if kind else coerce.kind_of_column(F.lit(name.removeprefix("context:")))
        counted.append(df.agg(F.lit(name).alias("id"), told.alias("kind"), F.count_distinct(column).alias("members")))
    return reduce(DataFrame.unionByName, counted)
