"""Rollups: effect sizes, integrated rates, rosters, catalogues, composites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import epoch_seconds, half_up
from millrace.operators.quantiles import medians
from millrace.operators.stats import unpivot_measures


def effect_sizes(df: DataFrame, categories: list[str], measures: list[str], min_rows: int = 500) -> DataFrame:
    """Eta squared of each category over each measure: the share of a measure's
    variation that lies between the category's values."""
    long = unpivot_measures(df, measures, categories).unpivot(["measure", "v"], categories, "category", "value").where("value IS NOT NULL")
    cells = long.groupBy("category", "measure", "value").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("var"))
    total = cells.groupBy("category", "measure").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    off = cells.select("category", "measure", F.col("n").alias("k"), "m", "var").join(total, ["category", "measure"])
    parts = off.groupBy("category", "measure").agg(F.first("n").alias("n"), F.first("cells").alias("cells"), F.sum(F.col("k") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum(F.col("k") * F.col("var")).alias("within"))
    usable = parts.where((F.col("n") >= min_rows) & (F.col("cells") >= 2))
    return usable.select("category", "measure", "n", "cells", half_up(F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0)), 6).alias("eta2"))


def mean_runs(df: DataFrame, unit: str, order: list[str], categories: list[str]) -> DataFrame:
    """Rows (category, mean_run_rows): how long runs of one value are, over all units.

    A unit is sorted once for all categories: a run begins where a value differs from
    the last one that was there, and only the number of beginnings counts.
    """
    ordered = Window.partitionBy(unit).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    value = {c: F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`").cast("string")) for c in categories}
    marked = df.select(*(v.alias(f"v{i}") for i, v in enumerate(value.values())), *((v.isNotNull() & ~v.eqNullSafe(F.last(v, ignorenulls=True).over(before))).alias(f"f{i}") for i, v in enumerate(value.values())))
    counted = marked.agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(categories))), *(F.count_if(f"f{i}").alias(f"r{i}") for i in range(len(categories))))
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), (F.col(f"n{i}") / F.nullif(F.col(f"r{i}"), F.lit(0))).alias("mean_run_rows")) for i, c in enumerate(categories)))
    return counted.select(F.inline(pairs)).where("mean_run_rows IS NOT NULL")


def state_scores(effects: DataFrame, lengths: DataFrame, long_run: float = 60.0, keep: int | None = None) -> DataFrame:
    """Each category's greatest effect size, weakened if its runs (mean_runs) are short;
    the best `keep` of them, ties by name."""
    best = effects.groupBy("category").agg(F.max("eta2").alias("eta2")).join(lengths, "category")
    scored = best.select("category", "eta2", half_up("mean_run_rows").alias("mean_run_rows"), half_up(F.col("eta2") * F.least(F.lit(1.0), F.col("mean_run_rows") / long_run), 6).alias("score"))
    return scored if keep is None else scored.orderBy(F.desc("score"), "category").limit(keep)


def choose_state(df: DataFrame, unit: str, order: list[str], categories: list[str], measures: list[str], min_rows: int = 1) -> str | None:
    """The category that acts most like a state: its values tell measures apart and last."""
    if not categories or not measures:
        return None
    found = state_scores(effect_sizes(df, categories, measures, min_rows), mean_runs(df, unit, order, categories), keep=1).first()
    return found["category"] if found else None


def integrate_rate(df: DataFrame, unit: str, measure: str, grain_sec: float, unit_sec: float) -> DataFrame:
    """What a rate adds up to, each row standing for one grain of time."""
    return df.groupBy(unit).agg(F.count(measure).alias("n"), half_up(F.sum(measure) * grain_sec / unit_sec).alias("integrated"))


def rosters(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct members of each source; equal rosters keep the shortest name."""
    named = [df.select(F.lit(name).alias("roster"), F.col(column).cast("string").alias("member")) for name, (df, column) in sources.items()]
    lists = reduce(DataFrame.unionByName, named).where("member IS NOT NULL").distinct().groupBy("roster").agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members"), F.count("*").alias("n"))
    return lists.groupBy("members", "n").agg(F.min_by("roster", F.struct(F.length("roster"), "roster")).alias("roster")).select("roster", "n", "members")


def equal_rosters(members: DataFrame, listed: int = 120) -> DataFrame:
    """Rows (roster, n, kept_as, members): which rosters (roster, member) are the same set.

    Equal sets keep the shortest name, ties by name; `members` are the first `listed` by
    name. Sets are compared by fingerprints that do not depend on order, so no row holds a
    roster; where these agree, the members themselves are joined and counted. Null members
    do not count, repeated ones once; a roster without members has no row.
    """
    distinct = members.select(F.col("roster"), F.col("member").cast("string").alias("member")).where("roster IS NOT NULL AND member IS NOT NULL").distinct()
    prints = [F.bit_xor(F.xxhash64(F.lit(seed), "member")).alias(f"_f{seed}") for seed in (1, 2)]
    sized = distinct.groupBy("roster").agg(F.count("*").alias("n"), *prints)
    shortest = F.struct(F.length("roster"), "roster")
    like = Window.partitionBy("n", "_f1", "_f2")
    named = sized.withColumn("_as", F.min_by("roster", shortest).over(like)).drop("_f1", "_f2")
    doubtful = named.where(F.col("roster") != F.col("_as"))
    ours = doubtful.join(distinct, "roster").select("roster", "n", "_as", "member")
    theirs = distinct.select(F.col("roster").alias("_as"), "member")
    shared = ours.join(theirs, ["_as", "member"]).groupBy("roster", "n").agg(F.count("*").alias("_shared")).where("_shared = n").select("roster", F.lit(True).alias("_same"))
    kept = named.join(shared, "roster", "left").withColumn("kept_as", F.when(F.col("_same"), F.col("_as")).otherwise(F.col("roster")))
    return kept.join(first_members(distinct, listed), "roster").select("roster", "n", "kept_as", "members")


def first_members(members: DataFrame, listed: int) -> DataFrame:
    """Rows (roster, members): the first `listed` distinct members by name, in order.

    Buckets of a roster keep their first ones before a roster is put together, so no task
    sorts a whole roster.
    """
    first = lambda df, keys: df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("member"))).where(F.col("_k") <= listed).drop("_k")
    bucketed = members.withColumn("_bucket", F.pmod(F.xxhash64("member"), F.lit(64)))
    few = first(first(bucketed, ["roster", "_bucket"]), ["roster"])
    return few.groupBy("roster").agg(F.sort_array(F.collect_list("member")).alias("members"))


def measure_catalogue(df: DataFrame, unit: str, measures: list[str]) -> DataFrame:
    """Each measure over all units, with the median and spread of units' means."""
    per = unpivot_measures(df, measures, [unit]).groupBy("measure", unit).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    mean = F.col("s") / F.col("n")
    whole = per.groupBy("measure").agg(F.sum("n").alias("n"), F.count("*").alias("units"), half_up(F.sum("s")).alias("sum"), half_up(F.sum("s") / F.sum("n")).alias("mean"), half_up(F.min("lo")).alias("lo"), half_up(F.max("hi")).alias("hi"), half_up(F.stddev_samp(mean)).alias("sd_of_unit_means"))
    return whole.join(medians(per.select("measure", mean.alias("v")), ["measure"]), "measure").withColumn("median_of_unit_means", half_up("median")).drop("median")


#: What a touchpoint's status adds to risk, and how weights count.
STATUS_RISK = {"red": 100.0, "amber": 55.0, "yellow": 55.0, "green": 8.0}
WEIGHTS = {"HVY": 3.0, "MED": 2.0, "LGT": 1.0}


def _lookup(values: dict[str, float], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def touchpoint_risk(df: DataFrame, key: str, status: Column, weight: Column) -> DataFrame:
    """Weighted mean risk by `key`; statuses without a score count for nothing."""
    scored = df.select(key, _lookup(STATUS_RISK, status).alias("r"), F.coalesce(_lookup(WEIGHTS, weight), F.lit(2.0)).alias("w")).where("r IS NOT NULL")
    return scored.groupBy(key).agg(F.count("*").alias("n"), (F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("risk"))


def worst_of(parts: dict[str, Column]) -> Column:
    """struct(pct, driver): the greatest part, clamped to 0..100; the first wins ties.

    Parts that are null are absent, which is not zero.
    """
    clamped = {k: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(v + 0.5).cast("double")))) for k, v in parts.items()}
    worst = F.greatest(*clamped.values()) if len(clamped) > 1 else next(iter(clamped.values()))
    driver = F.coalesce(*(F.when(v == worst, F.lit(k)) for k, v in clamped.items()))
    return F.struct(worst.alias("pct"), driver.alias("driver"))


def cycle_model(cycles: DataFrame, unit: str) -> DataFrame:
    """What completed cycles (unit, rows, total, sec) have in common: over units with
    at least two of them."""
    per = cycles.groupBy(unit).agg(F.count("*").alias("k"), F.sum("rows").alias("r"), F.sum("total").alias("t"), F.sum("sec").alias("s")).where("k >= 2")
    return per.agg(F.count("*").alias("units"), F.sum("k").alias("cycles"), half_up(F.sum("r") / F.sum("k")).alias("mean_rows"), half_up(F.sum("s") / F.sum("k")).alias("mean_sec"), half_up(F.sum("t") / F.sum("k")).alias("mean_total"))


def shift_medians(df: DataFrame, shift: str, member: str, measure: str) -> DataFrame:
    """Each shift's median over its members' means, and how far above the lowest."""
    means = df.groupBy(shift, member).agg(F.avg(measure).alias("m"))
    spread = means.groupBy(shift).agg(F.count("*").alias("members"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    middle = spread.join(medians(means.select(shift, F.col("m").alias("v")), [shift]).withColumnRenamed("median", "med"), shift)
    lowest = middle.agg(F.min("med").alias("lowest"))
    return middle.crossJoin(F.broadcast(lowest)).select(shift, "members", half_up("med").alias("median"), half_up("lo").alias("lo"), half_up("hi").alias("hi"), half_up((F.col("med") - F.col("lowest")) / F.nullif(F.col("lowest"), F.lit(0.0)), 6).alias("above_lowest"))


def coverage(df: DataFrame, unit: str, ts: str) -> DataFrame:
    """One row: rows, units, first and last second, days covered."""
    sec = epoch_seconds(ts)
    return df.agg(F.count("*").alias("rows"), F.count_distinct(unit).alias("units"), F.min(sec).alias("first_sec"), F.max(sec).alias("last_sec"), F.count_distinct(F.floor(sec / 86400)).alias("days"))
